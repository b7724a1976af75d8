"""Sketches leave out no near copies, and most of what is none is not compared."""

import random

import numpy as np

from lodestone.llm import simhash
from tests.llm.test_near_groups import plain_groups


def test_sketches_are_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 900), np.int64).view(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 300), np.int64).view(np.uint64)])
        bits = int(np.bitwise_count((simhash.near_sketch(np.unique(a)) ^ simhash.near_sketch(np.unique(b))).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_a_crowded_shingle_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda k: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(k)]
    passage = say(8)
    texts = [" ".join(passage + say(16)) for _ in range(120)]
    for i in range(0, 40, 2):
        texts[i + 1] = texts[i] + " more"
    # the passage leads the order of shingles, so all texts meet under it
    monkeypatch.setattr(simhash, "near_prefix", lambda own, common, rank, passage=simhash.near_set(" ".join(passage))[1]: np.concatenate([own[np.isin(own, passage)], own[~np.isin(own, passage)]])[: len(own) // 5 + 1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = [], simhash.Scratch.written
    monkeypatch.setattr(simhash.Scratch, "written", lambda self, df, name: (out := real(self, df, name), name == "near-pairs" and made.append(out.count()))[0])
    got = {r.doc_id: r.first for r in simhash.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)
    assert sum(made) < 100
