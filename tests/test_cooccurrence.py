"""Co-occurrences of contexts that are dealt into blocks."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import matrices


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_same_cells_however_contexts_are_dealt(spark, block):
    rng = np.random.default_rng(0)
    words = [(int(c), f"w{int(t)}") for c, t in zip(rng.integers(0, 4, 400) ** 2, rng.integers(0, 25, 400))]
    words += [(50, "alone"), (51, "twice"), (51, "twice"), (None, "w1"), (52, None), (52, "w2")]
    want = collections.Counter()
    for context in {c for c, _ in words if c is not None}:
        n = collections.Counter(t for c, t in words if c == context and t is not None)
        for a, x in n.items():
            for b, y in n.items():
                want[a, b] += x * (y - (a == b))
    df = spark.createDataFrame(words, "context int, token string").where("token is not null")
    got = {(r.row, r.col): r.weight for r in matrices.cooccurrence(df, block=block).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_no_key_of_a_heavy_context_has_more_than_its_share(spark):
    n = spark.range(30_000).select(F.when(F.col("id") < 20_000, "heavy").otherwise(F.concat(F.lit("light"), (F.col("id") % 500).cast("string"))).alias("context"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), F.lit(1).alias("n"))
    for side in matrices.dealt(n, 1000):
        keys = side.groupBy("context", "first", "second").count()
        heavy = keys.where("context = 'heavy'").agg(F.count("*").alias("keys"), F.max("count").alias("most"), F.sum("count").alias("rows")).first()
        assert heavy.keys == 400 and heavy.most < 1300 and heavy.rows == 20_000 * 20
        assert keys.where("context <> 'heavy'").agg(F.max("count")).first()[0] == 20
