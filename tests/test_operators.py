import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import tokens
from lodestone.operators import frequencies, matrices, relational, trees
from lodestone.plans.pipeline import Node
from lodestone.session import memory_settings
from lodestone.sources import nodes as node_sources
from lodestone.sources.files import load_parquet


def test_frequencies(spark):
    rng = random.Random(11)
    rows = [(rng.choice("uvwxyz"), f"file{rng.randrange(7)}", rng.randint(1, 9)) for _ in range(90)]
    bags = spark.createDataFrame(rows, "token string, document string, value long")
    sums, files = Counter(), {}
    for token, document, value in rows:
        sums[document, token] += value
        files.setdefault(token, set()).add(document)
    tf = {(r.document, r.token): r.value for r in frequencies.term_frequency(bags).collect()}
    assert tf == sums
    df = frequencies.document_frequency(bags)
    assert {r.token: r.freq for r in df.collect()} == {t: len(x) for t, x in files.items()}
    everywhere = max(files, key=lambda t: len(files[t]))
    weighted = frequencies.tf_idf(frequencies.term_frequency(bags), df, len(files[everywhere]))
    own = weighted.where(F.col("token") == everywhere)
    assert own.count() == len(files[everywhere]) and own.where("value <> 0").count() == 0


def test_greatest_breaks_ties_by_token(spark):
    rows = [("pear", 9), ("fig", 4), ("apple", 4), ("lime", 4), ("Fig", 4), ("kiwi", 2)]
    df = spark.createDataFrame(rows, "token string, freq long")
    for n in range(1, 8):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
        assert sorted(map(tuple, frequencies.greatest(df, n).collect())) == sorted(want)
    with pytest.raises(ValueError):
        frequencies.greatest(df, 0)
    with pytest.raises(ValueError):
        frequencies.pruned(df, 0)


def test_index_is_dense_and_ordered(spark):
    words = [f"w{random.Random(3).random()}-{i}" for i in range(500)] + ["é", "Z", "a"]
    got = frequencies.indexed(spark.createDataFrame([(w,) for w in words * 2], "token string")).collect()
    assert {r.token: r.token_id for r in got} == {w: i for i, w in enumerate(sorted(words))}
    assert frequencies.indexed(spark.createDataFrame([], "token string")).count() == 0


# Levels that other implementations give for these histograms.
@pytest.mark.parametrize("histogram, want", [
    ({1: 100, 2: 90, 3: 10, 5: 10, 6: 5, 7: 5}, [1, 2, 3, 7]),
    ({1: 10, 2: 10, 3: 10, 5: 10, 6: 10, 7: 10}, [1, 3, 6, 7]),
    ({1: 100, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1}, [1, 2, 7, 7]),
    ({1: 10, 2: 15, 3: 5, 5: 15, 6: 10, 7: 10}, [1, 2, 5, 7]),
])
def test_quantization(spark, histogram, want):
    df = spark.createDataFrame([("t", n, f) for n, f in histogram.items()], "internal_type string, n_children int, freq long")
    assert trees.quantization_levels(df, 3).first().levels == want


def test_cooccurrence_is_brute_force(spark):
    rng = random.Random(1)
    contexts = {c: [rng.choice("abcd") for _ in range(rng.randint(0, 7))] for c in range(20)}
    want = Counter(p for own in contexts.values() for p in permutations(own, 2))
    words = spark.createDataFrame([(c, w) for c, own in contexts.items() for w in own], "context int, token string")
    assert {(r.row, r.col): r.weight for r in matrices.cooccurrence(words).collect()} == dict(want)


def test_merged_cooccurrences_saturate(spark):
    big = spark.createDataFrame([("a", "b", 2**31 - 5), ("b", "a", 1)], "row string, col string, weight long")
    bad = spark.createDataFrame([("a", "b", -1)], "row string, col string, weight long")
    got = {(r.row, r.col): r.weight for r in matrices.merged_cooccurrences([big, big, bad]).collect()}
    assert got == {("a", "b"): 2**31 - 1, ("b", "a"): 2}


def test_python_trees(spark):
    source = "def outer(a):\n    def inner():\n        return a\n    return inner\nx = outer(1)\n"
    files = spark.createDataFrame([("d", source), ("bad", "def ("), (None, "x = 1"), ("empty", "")], "document string, content string")
    nodes = node_sources.parsed(files, "document", "content", node_sources.python_tree).cache()
    assert {r.document for r in nodes.select("document").distinct().collect()} == {"d"}
    assert [r.document for r in node_sources.unparsed(files, "document", "content", nodes).collect()] == ["bad"]
    rows = sorted(nodes.collect(), key=lambda r: r.pre)
    assert sorted(r.post for r in rows) == list(range(len(rows)))
    assert trees.outermost_functions(nodes).select("name").collect()[0].name == "outer+inner"
    plain = lambda t: tokens.split_identifier(t, single_shot=True, least=1)
    assert trees.identifier_sequence(nodes, plain).first().sequence.split() == ["outer", "a", "inner", "a", "inner", "x", "outer"]
    roles = {(r.token, r.roles) for r in trees.role_pairs(nodes).collect()}
    assert ("outer", "FUNCTION | IDENTIFIER | NAME") in roles
    walks = {r.token.removeprefix("r."): r.value for r in trees.random_walk_bag(nodes, lengths=(2,), n_walks=3, n_steps=5).collect()}
    kinds, up = {r.node_id: r.internal_type for r in rows}, {r.node_id: r.parent_id for r in rows}
    steps = {f"{kinds[a]}>{kinds[b]}" for a, p in up.items() if p is not None for a, b in ((a, p), (p, a))}
    assert set(walks) <= steps and sum(walks.values()) == len(rows) * 3 * 4


def test_walks_of_a_single_node_stay(spark):
    nodes = spark.createDataFrame([("d", 1, None, "Leaf"), ("e", 1, 99, "Root"), ("e", 2, 1, "Leaf")], "document string, node_id long, parent_id long, internal_type string")
    got = {(r.document, r.token): r.value for r in trees.random_walk_bag(nodes, lengths=(3,), n_walks=1, n_steps=4).collect()}
    assert got == {("d", "Leaf>Leaf>Leaf"): 2, ("e", "Root>Leaf>Root"): 2, ("e", "Leaf>Root>Leaf"): 2}


def test_languages(spark):
    df = spark.createDataFrame([("en",), ("de",), (None,)], "lang string")
    n = lambda *a: relational.languages(*a)(df).count()
    assert [n(["en"]), n(["en"], True), n([]), n([], True), n(None)] == [1, 1, 0, 3, 3]


def test_pipeline(spark):
    root = Node("read")
    keep, drop = root.link(("keep", lambda df: df.where("id < 3")), ("drop", lambda df: df.where("id >= 3")))
    count = keep.link(("count", lambda df: df.agg(F.count("*").alias("n"))))
    df = spark.range(10)
    assert count.run(df).first().n == 3 and [n.name for n in count.path()] == ["read", "keep", "count"]
    assert set(root.explode(df)) == {"read", "keep", "drop", "count"}
    assert '"keep 1" -> "count 1"' in root.graph()
    drop.link(("count", lambda df: df.agg(F.count("*").alias("n"))))
    assert {k: v.first().n for k, v in root.explode(df).items() if k.startswith("count")} == {"count": 3, "count 2": 7}
    root.unlink(drop)
    assert drop.parent is None and root.children == [keep]


def test_settings():
    assert memory_settings("1G, 2G,3G")["spark.driver.memory"] == "2G"
    with pytest.raises(ValueError):
        memory_settings("1G")


def test_load_parquet_wants_paths(spark):
    with pytest.raises(ValueError):
        load_parquet(spark, {"a": 1})


def test_tree_distances_are_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for d in range(3):
        paths = [()]
        for i in range(1, 60):
            up = rng.randrange(i) if d else max(0, i - 2)
            paths.append((*paths[up], up))
        rows += [(f"d{d}", i, p[-1] if p else None, i, i, "T", rng.choice(["ab", "cd", "ef", ""]), ["IDENTIFIER"], 1, 0, list(p)) for i, p in enumerate(paths)]
    schema = "document string, node_id long, parent_id long, pre long, post long, internal_type string, token string, roles array<string>, line int, col int, ancestors array<long>"
    plain = lambda t: tokens.split_identifier(t, single_shot=True, least=1)
    for most in (2, 5, 10):
        want = Counter()
        for x in rows:
            for y in rows:
                if x[0] == y[0] and x[1] < y[1] and x[6] and y[6] and x[6] != y[6]:
                    u, v = x[10], y[10]
                    n = min(len(u), len(v))
                    i = next((k for k in range(n) if u[k] != v[k]), max(n - 1, 0))
                    if len(u) + len(v) - 2 * i < most:
                        want[x[0], max(x[6], y[6]), min(x[6], y[6]), len(u) + len(v) - 2 * i] += 1
        got = Counter(tuple(r) for r in trees.tree_distances(spark.createDataFrame(rows, schema), plain, most).select("document", "first", "second", "distance").collect())
        assert got == want


def test_shards_are_dealt_by_falling_sums(spark):
    cooc = spark.createDataFrame([(t, str(k), 1) for t, n in (("a", 3), ("b", 7), ("c", 3), ("d", 1)) for k in range(n)], "row string, col string, weight long")
    words = spark.createDataFrame([(t,) for t in "abcde"], "token string")
    got = {r.token: (r.sums, r.shard) for r in matrices.shards(cooc, words, 2).collect()}
    assert got == {"b": (7, 0), "a": (3, 1), "c": (3, 0), "d": (1, 1), "e": (0, 0)}


def test_swivel_loss(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "token string, embedding array<double>")
    cells = spark.createDataFrame([("a", "b", 1.0, 2.0), ("b", "a", -1.5, 1.0)], "row string, col string, target double, confidence double")
    assert matrices.swivel_loss(vectors, cells).first().loss == pytest.approx((0.5 * 2 * 2.5**2 + 0) / 2)


def test_repositories_are_read_from_any_folder(tmp_path):
    """In a session of its own, started where the package cannot be imported from."""
    import os
    import subprocess
    import sys

    (tmp_path / "repos" / "one").mkdir(parents=True)
    (tmp_path / "repos" / "one" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "repos" / "one" / "b.bin").write_bytes(b"\0\1")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lodestone.sources.files import read_repositories
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", sorted((r.path, r.is_binary) for r in read_repositories(spark, {str(tmp_path / "repos")!r}).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS [('a.py', False), ('b.bin', True)]" in said.stdout, said.stderr[-2000:]
