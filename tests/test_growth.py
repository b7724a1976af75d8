"""What is dealt, sent and broadcast stays small as tables grow."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, languages
from lodestone.plans import flows, table_functions


def kept(monkeypatch, module):
    """The tables that ``module`` stores, by name, before they are written."""
    seen, real = {}, module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: (seen.setdefault(name, df), real(df, name))[1])
    return seen


def test_texts_and_not_their_tokens_are_dealt(spark, monkeypatch):
    seen = kept(monkeypatch, languages)
    files = spark.createDataFrame([(1, "x", "a b a"), (2, "y", "b c")], "key int, lang string, content string")
    model = languages.language_model(files)
    got = languages.classified(files.select("key", "content", F.lit(None).cast("array<string>").alias("candidates")), model, "key")
    assert {(r.key, r.lang) for r in got.collect()} == {(1, "x"), (2, "y")}
    assert seen["file-tokens"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_vocabularies_are_stored(spark, monkeypatch):
    seen = kept(monkeypatch, flows)
    bags = spark.createDataFrame([("a", "d", 1), ("a", "e", 2), ("b", "e", 1)], "token string, document string, value long")
    rows = {r.document: r.tokens for r in flows.repos2bow(bags, least=2).collect()}
    assert rows == {"d": [0], "e": [0]} and "words" in seen


def test_a_table_function_gets_what_its_kind_reads(spark):
    nodes = spark.createDataFrame([("d", 0, None, 0, "Root", "t", ["IDENTIFIER"], ["t"])], "document string, node_id long, parent_id long, post long, internal_type string, token string, roles array<string>, words array<string>")
    for kind, columns in {"id": 7, "lit": 6, "uast2seq": 4, "graphlet": 5}.items():
        table_functions.sql_bag(nodes, kind)
        assert len(spark.table("lodestone_nodes").columns) == columns


def test_gradients_are_summed_up_by_tasks(spark, monkeypatch):
    from pyspark.ml import classification

    class Stop(Exception):
        pass

    def made(**options):
        assert options["aggregationDepth"] > 4
        raise Stop

    monkeypatch.setattr(classification, "LogisticRegression", made)
    df = spark.createDataFrame([([1.0], "a"), ([0.0], "b")], "v array<double>, role string")
    with pytest.raises(Stop):
        evaluation.role_quality(df, "v", "role")
