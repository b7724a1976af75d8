"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): component is the least node reachable.

    Each round attaches the neighbours of a node to the least of them. A round
    ships one row for each edge, the minimum of a node is summed up before the
    shuffle, and the edges of a node of very many neighbours are joined to that
    one minimum (a join that Spark may split), never collected. Each round is
    written to the shared folder, so that a lost executor costs one round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = edges.sparkSession
    old = Scratch(spark)
    edges = old.written(edges, "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        spent = Scratch(spark)
        large = spent.written(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = Scratch(spark)
        edges = new.written(small.select("e.a", "e.b").where("a <> b").distinct(), "small")
        spent.drop()
        old.drop()
        old = new
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    down = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    made = written(down.unionByName(tops).groupBy("node").agg(F.min("component").alias("component")), "components")
    old.drop()
    return made
