"""Near copies and fingerprint groups where bands are crowded and rows have no doc_id."""

import random

import numpy as np
import pytest

from lodestone.llm import simhash


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    near = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    centers = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({simhash.signed(near(rng.choice(centers), rng.randint(0, 9))) for _ in range(400)})
    a = np.array(fps, np.int64).view(np.uint64)
    far = np.bitwise_count(a[:, None] ^ a[None, :])
    first = list(range(len(fps)))
    for i, j in zip(*np.nonzero(np.triu(far <= simhash.MOST_BITS, 1))):
        lo, hi = sorted((first[i], first[j]))
        first = [lo if f == hi else f for f in first]
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rows = spark.createDataFrame([(x, x) for x in fps], "id long, fp long")
    pairs = [tuple(r) for r in simhash.links(rows, simhash.bands(), simhash.MOST_BITS).collect()]
    at = {x: i for i, x in enumerate(fps)}
    got = list(range(len(fps)))
    for x, y in pairs:
        assert far[at[x], at[y]] <= simhash.MOST_BITS
        lo, hi = sorted((got[at[x]], got[at[y]]))
        got = [lo if f == hi else f for f in got]
    assert got == first and len(set(first)) > 3


def test_inner_bands_hold_every_link():
    rng = random.Random(3)
    for mask in simhash.bands():
        inner = simhash.inner_bands(mask)
        assert len(inner) == 15 and all(not m & mask for m in inner)
        rest = [b for b in range(64) if not mask >> b & 1]
        for _ in range(30):
            x = sum(1 << b for b in rng.sample(rest, rng.randint(0, simhash.MOST_BITS)))
            assert any(not x & m for m in inner)


def plain_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    first = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and first[i] != first[j]:
                lo, hi = sorted((first[i], first[j]))
                first = [lo if f == hi else f for f in first]
    return first


def near_rows(n=25):
    rng = random.Random(5)
    say = lambda k: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(k)]
    rows = []
    for _ in range(n):
        base = say(rng.randint(3, 120))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = say(1)[0]
            rows.append((None if rng.random() < 0.3 else len(rows), " ".join(w), "en"))
    return rows + [(None, None, None), (None, "", "x"), (len(rows) + 5, "", "y"), rows[0], rows[0]]


def test_rows_without_a_doc_id(spark):
    rows = near_rows()
    want = plain_groups([t for _, t, _ in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    by_group = {}
    for (i, _, _), g in zip(rows, want):
        by_group.setdefault(g, []).append(i)
    firsts = {g: min((i for i in ids if i is not None), default=None) for g, ids in by_group.items()}
    assert sorted(r.first for r in got if r.first is not None) == sorted(firsts[g] for g in want if firsts[g] is not None)
    assert {r.doc_id: r.first for r in got if r.doc_id is not None} == {i: firsts[g] for (i, _, _), g in zip(rows, want) if i is not None}
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert len(left) == len(by_group) and {r.doc_id for r in left} - {None} == {f for f in firsts.values() if f is not None}
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_nothing_is_left_but_the_result(spark):
    import os

    from lodestone.llm.common import local_path, shared_dir

    folder = local_path(shared_dir(spark))
    before = set(os.listdir(folder))
    simhash.near_groups(spark.createDataFrame(near_rows(), "doc_id long, text string, lang string")).collect()
    new = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert new <= {"near-keys", "near-firsts", "components", "links"}
