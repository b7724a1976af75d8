"""Parsers and extractors from SQL against the DataFrames, and failures as rows."""

import pytest

from lodestone.functions import tokens
from lodestone.operators import trees
from lodestone.plans import table_functions as tf
from lodestone.sources import nodes as sources

CODE = [("a.py", "def getUser(name):\n    return find_user(name, 'x', 3) or [y for y in name]\n"), ("bad.py", "def f(:\n"), ("b.py", "import os\nclass A:\n    x = 1\n"), ("none.py", None), ("empty.py", ""), ("deep.py", "(" * 5000 + ")" * 5000)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CODE, "path string, content string").repartition(3)


def test_parsing_from_sql_with_errors(spark, files):
    tf.register(spark)
    files.createOrReplaceTempView("code_files")
    got = spark.sql("SELECT n.* FROM code_files, LATERAL parse_python(path, content) n").collect()
    errors = {r.document: r.error for r in got if r.error}
    assert set(errors) == {"bad.py", "deep.py"} and errors["bad.py"].startswith("SyntaxError")
    want = sources.parsed(files, "path", "content", sources.python_tree).collect()
    assert sorted(tuple(r)[:2] for r in got if not r.error) == sorted(tuple(r)[:2] for r in want)
    assert sorted(map(repr, (tuple(r)[:-1] for r in got if not r.error))) == sorted(repr(tuple(r)) for r in want)
    pages = spark.sql("SELECT count(*) AS n, count(error) AS e FROM VALUES ('p', '<p>one<b>two</b>') AS t(id, html), LATERAL parse_html(id, html)").first()
    assert pages.n > 3 and pages.e == 0


@pytest.mark.parametrize("kind, make, namespace", [("id", lambda n: trees.identifier_bag(n, tokens.split_identifier), "i."), ("lit", lambda n: trees.literal_bag(n, tokens.hashed_token), "l."), ("uast2seq", trees.sequence_bag, "s."), ("graphlet", trees.graphlet_bag, "g.")])
def test_bags_from_sql_are_those_of_the_tables(spark, files, kind, make, namespace):
    nodes = sources.parsed(files, "path", "content", sources.python_tree)
    got = tf.sql_bag(tf.with_words(nodes, tokens.split_identifier), kind).collect()
    want = trees.with_namespace(make(nodes), namespace).collect()
    assert len(want) > 2 and sorted((r.token, r.document, r.value) for r in got) == sorted((r.token, r.document, r.value) for r in want)
    assert not any(r.error for r in got)


def test_bad_trees_are_rows(spark):
    rows = [
        ("good", 1, None, 1, "File", None, ["FILE"]), ("good", 2, 1, 0, "Name", "aName", ["IDENTIFIER"]),
        ("orphan", 1, 7, 0, "Name", "b", ["IDENTIFIER"]), ("untyped", 1, None, 0, None, "c", ["IDENTIFIER"]), ("twice", 1, None, 0, "A", None, None), ("twice", 2, None, 0, "B", None, None),
    ]
    nodes = tf.with_words(spark.createDataFrame(rows, "document string, node_id long, parent_id long, post long, internal_type string, token string, roles array<string>"), tokens.split_identifier)
    got = {(r.document, r.token): r.error for r in tf.sql_bag(nodes, "graphlet").collect()}
    assert set(got) == {("good", "g.None_File_Name"), ("good", "g.File_Name"), ("orphan", None), ("untyped", None), ("twice", None)}
    assert "no node 7" in got["orphan", None] and "without number" in got["untyped", None] and "two nodes" in got["twice", None]
    assert [r.error for r in tf.sql_bag(nodes.where("document = 'good'"), "nothing").collect()] == ["ValueError: no bag 'nothing': ['graphlet', 'id', 'lit', 'uast2seq']"]


def test_nodes_come_in_batches_of_many_documents(spark):
    """A document that goes on in the next batch is one, with what is wrong with it; PARTITION BY gives the same bags."""
    columns = "document string, node_id long, parent_id long, post long, internal_type string, token string, roles array<string>"
    rows = [(f"d{d}", i, 0 if i else None, (i - 1) % 5, "T", ["aName", "", None, "bName", "aName"][i], [["IDENTIFIER"], ["IDENTIFIER", "LITERAL"], ["IDENTIFIER"], ["LITERAL"], None][(i + d) % 5]) for d in range(6) for i in range(5)]
    rows += [("e", 1, None, 7, "T", "x", ["IDENTIFIER"]), ("e", 2, None, 7, "T", "y", ["IDENTIFIER"]), ("f", 1, None, 0, "T", "x", ["IDENTIFIER"]), ("f", 2, 1, None, "T", "y", None), (None, 1, None, 0, "T", "x", ["IDENTIFIER"])]
    nodes = tf.with_words(spark.createDataFrame(rows, columns), tokens.split_identifier)
    good = nodes.where("document is null or document < 'e'")
    made = {"id": trees.identifier_bag(good, tokens.split_identifier), "lit": trees.literal_bag(good, tokens.hashed_token), "uast2seq": trees.sequence_bag(good)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for kind, want in made.items():
                df = tf.sql_bag(nodes, kind)
                assert "ArrowEvalPythonUDTF" in df._jdf.queryExecution().executedPlan().toString()
                for got in (df.collect(), spark.sql(f"SELECT * FROM tree_bag('{kind}', TABLE(lodestone_nodes) PARTITION BY document ORDER BY post)").collect()):
                    assert {r.document: r.error for r in got if r.error} == {"e": "ValueError: two nodes at place 7", "f": "ValueError: a node without number, place or type"}
                    bag = {(r.document, r.token[2:]): r.value for r in got if not r.error}
                    assert len(bag) == sum(not r.error for r in got) and bag == {(r.document, r.token): r.value for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
