"""Walks and trees of orders, a document at a time."""

import hashlib
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import tokens, walks
from lodestone.operators import frequencies, matrices, trees
from lodestone.plans import flows
from lodestone.queries import QUERIES
from lodestone.sources.nodes import order_nodes

from test_queries import SF

SCHEMA = "document string, node_id long, parent_id long, internal_type string"


def operators(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name} [")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_walks_are_sorted_once(spark):
    df = QUERIES["random_walk_bag"](spark, SF)
    assert operators(df, "Window") == 1 and operators(df, "Sort") <= 3


def walked(rows, p, q, n_walks, n_steps, lengths):
    """The bag by plain loops, every draw made."""
    kind = {(d, i): k for d, i, _, k in rows}
    children = {}
    for d, i, up, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        children.setdefault((d, up), []).append(i)
    bag = Counter()
    for d, i, _, _ in rows:
        for walk in range(n_walks):
            draw = lambda step, what: int(hashlib.md5(f"7/{d}/{i}/{walk}/{step}/{what}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
            at = before = i
            path = [i]
            for step in range(1, n_steps):
                up = next(u for e, j, u, _ in rows if (e, j) == (d, at))
                below = children.get((d, at), [])
                near = below + ([up] if kind.get((d, up)) is not None else [])
                back = (1 / p) / (1 / p + len(below) / q)
                to = at if not near else before if step > 1 and draw(step, "back") / 2**32 < back else near[draw(step, "next") % len(near)]
                before, at = at, to
                path.append(at)
            kinds = [kind[d, j] for j in path]
            for n in lengths:
                for k in range(n_steps - n + 1):
                    bag[d, ">".join(x for x in kinds[k : k + n] if x is not None)] += 1
    return dict(bag)


def test_walks_are_those_of_plain_loops(spark, monkeypatch):
    rows = [("a", 0, None, "R"), ("a", 1, 0, "G"), ("a", 2, 0, "H"), ("a", 100, 1, "L"), ("a", 101, 1, "M"), ("a", 2**60, 2, "L>M"), ("b", -3, 99, "Lost"), ("b", 5, -3, "L"), ("c", 1, None, None), ("c", 2, 1, "L"), ("c", 3, 1, "M"), ("d", 1, None, "One")]
    rows += [(f"e{k}", i, (i - 1) // 3 if i else None, "ABC"[i * k % 3]) for k in range(20) for i in range(40)]
    nodes = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for lengths in ((2, 3), (1, 5, 9)):
        got = {(r.document, r.token): r.value for r in trees.random_walk_bag(nodes, lengths, n_walks=3, n_steps=6, seed=7).collect()}
        assert got == walked(rows, 0.79, 0.82, 3, 6, [n for n in lengths if n <= 6])


def test_parts_end_where_documents_do():
    rows = [(d, k == 0) for d, n in enumerate((3, 1, 9, 2, 2)) for k in range(n)]
    batches = [pa.RecordBatch.from_pydict({"document": [d for d, _ in rows[i : i + 2]], "starts": [s for _, s in rows[i : i + 2]]}) for i in range(0, len(rows), 2)]
    parts = [p["document"].to_pylist() for p in walks.whole_documents(iter(batches), 4)]
    assert sum(parts, []) == [d for d, _ in rows] and all(set(a).isdisjoint(b) for a, b in zip(parts, parts[1:])) and len(parts) > 1


def test_lines_of_an_order_are_gathered_once(spark):
    orders = spark.createDataFrame([(1, "1-URGENT"), (2, None), (None, "5-LOW"), (3, "5-LOW")], "o_orderkey long, o_orderpriority string")
    lines = [(1, 2, "N", "O", 9), (1, 1, "R", "F", 3), (1, 1, "A", "O", 2), (1, 1, None, None, None), (2, None, None, "F", None), (2, None, "N", None, 8), (2, 4, None, "O", 1), (None, 1, "N", "O", 1)]
    nodes = order_nodes(orders, spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_partkey long"))
    # lines are gathered and joined to their orders: two sorts of the join, and one sum
    assert operators(nodes, "Sort") <= 2 and nodes._jdf.queryExecution().executedPlan().toString().count("Aggregate(") == 2
    got = sorted((r.document, r.pre, r.post, r.node_id, r.parent_id, r.internal_type, r.token, r.line) for r in nodes.collect())
    assert got == [
        ("o1", 0, 4, 0, None, "Order", "orderURGENT", 1), ("o1", 1, 1, 1, 0, "GroupA", "groupAName", None), ("o1", 2, 0, 100, 1, "LineF", "lineAStatusFpart2", 4),
        ("o1", 3, 3, 2, 0, "GroupN", "groupNName", 4), ("o1", 4, 2, 101, 2, "LineO", "lineNStatusOpart2", None),
    ] + [r for r in got if r[0] == "o2"]
    assert [r[:6] for r in got if r[0] == "o2"] == [("o2", 0, 4, 0, None, "Order"), ("o2", 1, 1, 1, 0, None), ("o2", 2, 0, 100, 1, "LineO"), ("o2", 3, 3, 2, 0, "GroupN"), ("o2", 4, 2, 101, 2, "LineF")]


def grown(spark, documents, n, seed):
    """Random trees, some of whose nodes are identifiers without a token or below what is not in the table."""
    rng, rows = random.Random(seed), []
    for d in range(documents):
        paths = [()]
        for i in range(1, n):
            up = rng.randrange(i)
            paths.append((*paths[up], up))
        rows += [(None if d == 3 else f"d{d}", i, rng.choice(["aName", "nameOf", "", None, "x_y_name", "longerIdentifiers", "y"]), rng.choice([["IDENTIFIER"], ["IDENTIFIER", "NAME"], ["LITERAL"], None]), [99, *p] if d == 4 else list(p)) for i, p in enumerate(paths)]
    rows += [("one", 7, "aName", ["IDENTIFIER"], []), ("lost", 7, "aNameName", ["IDENTIFIER"], [1, 2])]
    return spark.createDataFrame(rows, "document string, node_id long, token string, roles array<string>, ancestors array<long>").repartition(3)


@pytest.mark.parametrize("block", [2, 1000])
def test_contexts_with_the_same_identifiers_meet_once(spark, monkeypatch, block):
    nodes, split = grown(spark, 8, 30, 1), tokens.split_identifier
    same = nodes.where("document = 'd0'").withColumn("document", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.concat(F.lit("copy"), k.cast("string")))))
    nodes = nodes.unionByName(same)
    want = {tuple(r) for r in matrices.cooccurrence(matrices.tree_contexts(nodes, split), context=("document", "at")).collect()}
    found = matrices.Contexts(nodes, split)
    assert {tuple(r) for r in found.cooccurrence(block=block).collect()} == want and len(want) > 10
    made = found.alike.groupBy("whole").agg(F.count("*").alias("rows"), F.sum("times").alias("times")).collect()
    assert all(r.rows < r.times / 4 for r in made) and {r.times for r in made if r.whole} == {nodes.where("document is not null and array_contains(roles, 'IDENTIFIER')").select("document").distinct().count()}
    df = {tuple(r) for r in frequencies.document_frequency(flows.stemmed_bag(trees.identifier_bag(nodes.where("document is not null"), split))).collect()}
    assert {tuple(r) for r in matrices.Contexts(nodes, split, tokens.STEM_ABOVE).document_frequency().collect()} == df and "" in {t for t, _ in df}


def test_distances_of_alike_identifiers_are_counted_once(spark):
    nodes, split = grown(spark, 6, 40, 2), tokens.split_identifier
    for most in (1, 2, 3, 10):
        want = {tuple(r) for r in trees.tree_distances(nodes, split, most).groupBy("first", "second", "distance").agg(F.count("*").alias("n")).collect()}
        df = trees.tree_distance_counts(nodes, split, most)
        assert {tuple(r) for r in df.collect()} == want and operators(df, "Join") == 0
    assert len(want) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_identifiers_of_orders_meet_where_they_are(spark):
    plan = QUERIES["id_tree_distance"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "points" not in plan and len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line]) <= 4


def test_documents_alike_are_weighed_once(spark):
    """Rows of all documents, as from the bags of each; the order of extractors and what is null do not matter."""
    rng = random.Random(5)
    schema = "document string, node_id long, parent_id long, internal_type string, token string, roles array<string>"
    rows = [(f"d{d}", i, rng.randrange(i) if i else None, rng.choice("ABC"), rng.choice(["aName", "nameOfIdentifiers", "", None, "x_y"]), rng.choice([["IDENTIFIER"], ["LITERAL"]])) for d in range(12) for i in range(1 + d % 6)]
    rows += [(f"copy{k}", *r[1:]) for r in rows if r[0] == "d5" for k in range(40)] + [("lost", 3, 77, "A", "aName", ["IDENTIFIER"]), ("lost", 4, 3, "B", None, ["IDENTIFIER"])]
    nodes = spark.createDataFrame(rows, schema).repartition(3)
    want = flows.repos2bow(flows.bags_of(nodes, ["id", "graphlet", "children"]), least=2)
    found = flows.Features(nodes)
    got = flows.repos2bow(found.bags(["children", "id", "graphlet"]), least=2, found=found)
    cells = lambda df: sorted((r.document, r.tokens, [round(v, 9) for v in r["values"]]) for r in df.collect())
    assert cells(got) == cells(want) and len(cells(got)) > 45
    assert found.documents.count() == len({r[0] for r in rows}) and found.counts.count() <= 13 and found.counts.agg(F.max("times")).first()[0] >= 41
