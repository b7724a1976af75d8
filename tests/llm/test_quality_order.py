"""The quality rules see the order of words: the model across their borders against a plain one, and a shuffled text."""

import math
import random

import pytest

from lodestone.llm import quality
from tests.llm.test_quality_bands import Plain

N = quality.ORDER


class Across(Plain):
    """The model of one language's texts, letters of all words in a row."""

    def __init__(self, texts):
        super().__init__(["\n".join(t) for t in texts])

    def text(self, words):
        s = "\t" * (N - 1) + "".join(w + "\n" for w in words)
        return sum(math.log10(self.p(s[i : i + N])) for i in range(len(s) - N + 1)) / len(words)


def test_figures_across_words_are_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.choice((1, 1, 2, 3, 4, 7)))) for _ in range(60)]
    texts = [rng.choices(vocabulary, k=rng.randint(1, 90)) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    plain = Across(texts)
    want = [plain.text(t) for t in texts]
    for kept in (quality.KEPT, 10):
        monkeypatch.setattr(quality, "KEPT", kept)
        got = {r.doc_id: r.text_logp for r in quality.judged(docs, ["doc_id", "lang"]).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_shuffled_words_are_rejected(spark):
    rng = random.Random(9)
    say = lambda a, b: [a + "".join(rng.choices("eiou", k=3)) + b for _ in range(30)]
    first, second = say("m", "r"), say("k", "s")
    texts = [[w for _ in range(60) for w in (rng.choice(first), rng.choice(second))] for _ in range(60)]
    shuffled = rng.sample(texts[0], len(texts[0]))
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate([*texts, shuffled])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(docs, ["doc_id", "lang"]).collect()}
    assert got[60].word_logp == pytest.approx(got[0].word_logp) and not got[60].base_failed
    assert got[0].kept and not got[60].kept
    assert sum(not got[i].kept for i in range(60)) <= 3
