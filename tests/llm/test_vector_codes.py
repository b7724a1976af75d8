"""Vector codes against plain Lloyd rounds in Python integers, and what a round touches."""

import hashlib

import numpy as np
import pytest

from lodestone.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, codebooks) of rows (vec_id, vector, label), part by part."""
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((gap(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, xs in held.items():
                books[p][e] = tuple(sum(x) // len(xs) for x in zip(*xs))
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by[label], sha) for (i, _, label), f, err in zip(kept, found, errors)), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def coded(spark, rows, **how):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, V.compressed(df, **how).collect()), key=repr)


@pytest.mark.parametrize("entries", [256, 7, 1])
def test_same_as_plain_rounds(spark, entries):
    rng = np.random.default_rng(entries)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.3, size=8)).astype(np.float32).tolist(), i % 3 if i % 5 else None) for i in range(150)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[9][1], None), (200, rows[0][1], 2)]  # ties, equal rows, no id
    rows += [(201, None, 1), (202, [None] + [0.0] * 7, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] * 8, 0)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0] * 2, 5) for i in range(80)]  # a third of equal vectors
    assert coded(spark, rows, entries=entries) == plain(rows, entries=entries)


@pytest.mark.parametrize("scale", [1e-6, 3e4, 2e5])
def test_small_and_large_numbers(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * scale).astype(np.float32).tolist(), 0) for i in range(60)]
    assert coded(spark, rows, entries=9) == plain(rows, entries=9)


def test_nothing_to_code(spark):
    assert coded(spark, []) == coded(spark, [(1, None, 1), (2, [float("nan")] * 4, 1)]) == []
    assert [r[:4] for r in coded(spark, [(1, [], 1), (2, [], 1)])] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


@pytest.mark.parametrize("rows", [[(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e30] * 4, 0)]])
def test_what_cannot_be_coded_fails(spark, rows):
    with pytest.raises(Exception, match="unequal lengths|do not divide|52 bits"):
        coded(spark, rows)


def test_a_round_touches_what_drift_violates():
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(16, 4)) * 4000, 200, 0) + rng.normal(size=(3200, 4)) * 300).astype(np.int64)[None]
    book = x[:, ::200].copy()
    drift = np.zeros(book.shape[:2])
    chunk = V.Chunk.load(V.Chunk.first(x, book, drift).dump())
    seen, violated = [], V.Heaps.violated
    for _ in range(4):
        new = np.array([[np.floor_divide(x[0][chunk.entry[0] == e].sum(0), max(1, (chunk.entry[0] == e).sum())) for e in range(16)]])
        drift = drift + V.drifted(book, new)
        book = new
        popped = []
        V.Heaps.violated = lambda self, d: popped.append(violated(self, d)) or popped[-1]
        try:
            moved, _ = chunk.advance(x, book, drift)
        finally:
            V.Heaps.violated = violated
        chunk = V.Chunk.load(chunk.dump())
        want, _ = V.nearest(x[0], book[0])
        assert (chunk.entry[0] == want).all() and set(moved[0]) <= set(popped[0])
        assert sorted(np.concatenate([chunk.heaps[0].rows])) == list(range(3200))
        keys, rows, ends = chunk.heaps[0].packed()
        for lo, hi in zip([0, *ends], ends):  # each part is in its entry's heap, and each heap is one
            assert (want[rows[lo:hi]] == list(ends).index(hi)).all() if hi > lo else True
            assert all(keys[lo + (i - 1) // 2] <= keys[lo + i] for i in range(1, hi - lo))
        seen.append(len(popped[0]))
    assert seen[-1] < 1600  # few of 3,200 once the entries have settled
