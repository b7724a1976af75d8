"""Trees are dealt by document once, and what is made of them agrees with SQL."""

import os
import re

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES
from lodestone.session import portions

from test_queries import SF, cells

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shuffles(df):
    """Shuffles of the plan; one that is used again counts each time."""
    return len(re.findall(r"Exchange (?:hash|range|SinglePartition)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name, most", [("bag_id", 2), ("bag_lit", 2), ("bag_seq", 2), ("bag_graphlet", 2), ("random_walk_bag", 2), ("id_sequence", 2), ("bag_children", 7), ("cooc", 6), ("cooc_trees", 6)])
def test_trees_are_dealt_once(spark, name, most):
    assert shuffles(QUERIES[name](spark, SF)) <= most


def test_partitions_grow_with_the_rows(spark):
    least = spark.sparkContext.defaultParallelism
    assert [portions(spark.range(n), 10) for n in (0, 1, 10 * least, 10 * least + 1, 100 * least)] == [least, least, least, least + 1, 10 * least]


@pytest.mark.parametrize("name", ["nodes_table", "bag_id", "bag_lit", "bag_children", "child_histogram", "quant_levels", "random_walk_bag", "id_line_distance", "cooc_merge_saturated", "mode_repo"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in os.listdir(SF):
        duck.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    got, want = cells(QUERIES[name](spark, SF).toPandas()), cells(duck.execute(ORACLE_SQL[name]).df())
    assert len(got) > 1 and got == want


def test_nodes_without_a_parent_in_the_table(spark):
    from lodestone.operators import trees

    rows = [("d", 1, None, "Root"), ("d", 2, 1, "B"), ("d", 3, 1, "A"), ("e", 5, 99, "Lost"), ("e", 6, 5, "Leaf")]
    nodes = spark.createDataFrame(rows, "document string, node_id long, parent_id long, internal_type string")
    got = {(r.document, r.token): r.value for r in trees.graphlet_bag(nodes).collect()}
    assert got == {("d", "None_Root_A_B"): 1, ("d", "Root_A"): 1, ("d", "Root_B"): 1, ("e", "None_Lost_Leaf"): 1, ("e", "Lost_Leaf"): 1}
    assert sorted((r.document, r.internal_type, r.n_children) for r in trees.child_counts(nodes).collect()) == [("d", "A", 0), ("d", "B", 0), ("d", "Root", 2), ("e", "Leaf", 0), ("e", "Lost", 1)]
