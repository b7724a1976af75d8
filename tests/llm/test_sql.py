"""Queries whose whole result SQL can say, and the widths of counts."""

import os
import re

import numpy as np
import pytest

from lodestone.llm import entry, language_model

SF = "/root/testdata/sf0.001"


def cells(df):
    text = df[sorted(df.columns)].map(lambda x: re.sub(r"\.0$", "", "None" if x is None or x != x else str(x)))
    return sorted(map(tuple, text.values))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = cells(con.execute(entry.ORACLE_SQL[name]).df())
    assert len(want) > 1 and cells(entry.QUERIES[name](spark, SF).toPandas()) == want


def test_counts_of_any_width(tmp_path):
    model = language_model.Model(language_model.Vocabulary(str(tmp_path), 3), str(tmp_path))
    for name, counts in (("narrow", [0, 1, 2**32 - 1]), ("wide", [0, 2**32, 7 << 40]), ("none", [])):
        language_model.put_counts(f"{tmp_path}/{name}", np.array(counts, np.int64))
        assert model.counts_file(name).tolist() == counts
    vocabulary = language_model.Vocabulary(str(tmp_path), 0)
    vocabulary.save(0, np.array([9, 4], np.uint64), c=np.array([5, 6 << 33]))
    vocabulary.base = {0: 0}
    assert [x.tolist() for x in vocabulary.ids(np.array([4, 9, 5], np.uint64))] == [[0, 1, -1], [6 << 33, 5, 0]]


def test_too_many_words_fail(spark, monkeypatch):
    monkeypatch.setattr(language_model, "IDS", 3)
    with pytest.raises(OverflowError):
        language_model.train(spark.createDataFrame([("a b c",)], "text string"))
