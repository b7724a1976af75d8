"""The index of window hashes over batches and sessions, against brute force."""

import hashlib
import os
import random

import pytest

from lodestone.llm import substring
from lodestone.llm.common import local_path

DOCS = "doc_id long, text string"


def plain(rows):
    """[(doc_id, n_words, n_removed, digest)] of every row, by word sequences."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(2000)}" for _ in range(k)]
    passages = [say(rng.randint(50, 80)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = say(rng.randint(0, 90))
        if rng.random() < 0.5:
            p = passages[rng.randrange(4)]
            w = w + p + say(rng.randint(0, 60))
        if rows and rng.random() < 0.2:
            w = rows[rng.randrange(len(rows))][1].split()
        rows.append((i * 3, " ".join(w)))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batches_in_other_sessions(spark, tmp_path):
    rows, path = corpus(), f"file:{tmp_path}/index"
    want = plain(rows)
    found, tables = [], []
    for k in range(6):
        session = spark.newSession()
        for t in session.catalog.listTables():  # as in a later application
            if t.name.startswith("substring_"):
                session.sql(f"drop table {t.name}")
        index = substring.FingerprintIndex(session, path)
        found += got(index.add(session.createDataFrame(rows[k * 10 : k * 10 + 10], DOCS)))
        tables.append([len(x) for x in index.state["levels"]])
    assert sorted(found, key=str) == want and sum(r[2] > 0 for r in want) > 10
    assert tables == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    index = substring.FingerprintIndex(spark, path)
    live = {x for level in index.state["levels"] for x in level} | {t["name"] for t in index.state["texts"]}
    assert {x for x in os.listdir(local_path(path)) if x.startswith("substring_")} == live  # what was compacted is gone
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame(rows[:1], DOCS))
    assert index.add(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_ids_nulls_and_an_outlier(spark):
    rng = random.Random(1)
    say = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    shared, alone = say(70), say(200)
    rows = [(1, shared + " " + say(40)), (2, alone), (2, say(30) + " " + shared), (2, alone), (3, shared), (3, shared), (10**15, say(20) + " " + shared), (None, shared), (None, None), (4, None), (5, "")]
    rows += [(k, say(60)) for k in range(20, 40)]
    for batches in (1, 4):
        assert got(substring.deduplicated(spark.createDataFrame(rows, DOCS), batches)) == plain(rows)


def test_a_kept_index_goes_on(spark, tmp_path):
    rows, path = corpus(30, 8), f"{tmp_path}/kept"
    first = got(substring.deduplicated(spark.createDataFrame(rows[:20], DOCS), 2, path))
    assert sorted(first + got(substring.deduplicated(spark.createDataFrame(rows[20:], DOCS), 2, path)), key=str) == plain(rows)


def test_a_text_of_megabytes(spark):
    rng = random.Random(2)
    words = [f"z{rng.randrange(10**5)}" for _ in range(300_000)]
    rows = [(1, " ".join(words[:200_000])), (2, "x " + " ".join(words[100_000:])), (3, "same " * 100_000), (4, "same " * 60)]
    assert got(substring.deduplicated(spark.createDataFrame(rows, DOCS), 2)) == plain(rows)
