"""Phrases against a plain count of every phrase, and the sketch that stands before the exact counts."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return counts, n


def best(rows, least, share=80, top=2000):
    counts, n = counted(rows)
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= least}
        found = []
        for p, a in often.items():
            held = any(100 * b >= share * a for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if len(p) > 1 and not held:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = np.array(["a", "B", "ab", "Ä", "ä", "x y", "c-d", "New", "york", "城市"])
    seps = np.array([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "; "])
    made = [("".join(w + s for w, s in zip(rng.choice(words, n), rng.choice(seps, n))), lang) for n in rng.integers(0, 60, 80) for lang in ("en", None, "und")]
    return made + [(None, "en"), ("", "en"), (" .,;", "fr"), ("New York " * 9, "de"), ("New York " * 9, "de"), ("a", None)]


@pytest.mark.parametrize("top", [2000, 3])
def test_same_as_plain_counts(spark, rows, top):
    docs = spark.createDataFrame([(i, t, lang, "n", 1) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, phrase string, a int").repartition(5)
    got = phrases.collocations(docs, least=5, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    want = sorted(best(rows, 5, top=top))
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == want


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).count() == 0


def test_portions_keep_every_word(monkeypatch, rows):
    whole = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["text", "lang"])
    monkeypatch.setattr(phrases, "AT_ONCE", 300)
    seen = collections.Counter()
    for part, langs, lang in phrases.portions(iter([whole.slice(7, 90), whole.slice(97)])):
        codes, words, run, text = phrases.worded(part)
        spelt, of = words.to_pylist(), np.asarray(lang)[text]
        for i in range(len(codes)):
            for k in range(1, 5):
                if i + k <= len(codes) and run[i] == run[i + k - 1]:
                    seen[langs[of[i]], *(spelt[c] for c in codes[i : i + k])] += 1
    counts, _ = counted(rows[7:])
    assert seen == collections.Counter({(lang, *p): a for lang, c in counts.items() for p, a in c.items()})


@pytest.mark.parametrize("width, least", [(1, 3), (1 << 21, 3), (1 << 21, 300)])
def test_sketch_loses_nothing(tmp_path, width, least):
    rng = np.random.default_rng(0)
    sketch = phrases.Sketch(str(tmp_path), width, least)
    parts = [phrases.mixed(rng.zipf(1.3, 50_000).astype(np.uint64)) for _ in range(4)]
    totals = {}
    for h in parts:
        for block, packed in sketch.counted(h):
            sketch.add(totals.setdefault(block, np.zeros(1 << sketch.block, sketch.counter)), packed)
    for block, total in totals.items():
        sketch.save(block, total)
    kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
    found = phrases.Sketch(str(tmp_path), width, least).reached(kinds)
    assert found[counts >= least].all()
    assert found.sum() < (counts >= least).sum() + (len(kinds) / 100 if width > 1 else len(kinds) / 2)
