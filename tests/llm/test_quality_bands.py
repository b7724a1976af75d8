"""The verdict of the quality rules against a plain version of model and bands."""

import math
import random
from collections import Counter

import pytest

from lodestone.llm import quality
from lodestone.llm.kneser_ney import discounts


class Plain:
    """The model of one language's words, on strings."""

    def __init__(self, words, n=quality.ORDER):
        self.n, counts = n, [Counter() for _ in range(n + 1)]
        for w in words:
            s = "\t" * (n - 1) + w + "\n"
            counts[n].update(s[i : i + n] for i in range(len(s) - n + 1))
        for k in range(n - 1, 0, -1):
            for g, c in counts[k + 1].items():
                counts[k][g[1:]] += c if g[1:].startswith("\t") else 1
        self.counts = [Counter({g: c for g, c in x.items() if not g.endswith("\t")}) for x in counts]
        self.cut = [discounts(*[sum(c == j for c in x.values()) for j in (1, 2, 3, 4)]) for x in self.counts]
        self.after = [{} for _ in self.counts]
        for k, x in enumerate(self.counts):
            for g, c in x.items():
                self.after[k].setdefault(g[:-1], []).append(c)

    def p(self, g):
        out = 1 / (len(self.counts[1]) + 1)
        for k in range(1, self.n + 1):
            if own := self.after[k].get(g[self.n - k : -1]):
                d, c = self.cut[k], self.counts[k][g[self.n - k :]]
                out = (c - d[min(c, 3) - 1] if c else 0) / sum(own) + sum(d[min(x, 3) - 1] for x in own) / sum(own) * out
        return out

    def word(self, w):
        s = "\t" * (self.n - 1) + w + "\n"
        return sum(math.log10(self.p(s[i : i + self.n])) for i in range(len(s) - self.n + 1))


def verdicts(rows):
    """{row number: (mean log10 probability of a word, kept)}."""
    by_lang = {}
    for i, t, lang in rows:
        by_lang.setdefault(lang, []).append((i, (t or "").split()))
    out = {}
    for own in by_lang.values():
        model = Plain([w for _, words in own for w in words])
        known = {w: model.word(w) for _, words in own for w in words}
        value = {i: sum(known[w] for w in words) / len(words) if words else None for i, words in own}
        failed = {i: len(words) < 50 or 100 * repeats(words) > 50 * len(words) for i, words in own}
        good = sorted(v for i, v in value.items() if not failed[i])
        if good:
            middle = lower_median(good)
            spread = 1.4826 * lower_median(sorted(abs(v - middle) for v in good))
        for i in value:
            out[i] = value[i], not failed[i] and abs(value[i] - middle) <= quality.WIDTH * spread
    return out


def lower_median(x):
    return x[math.ceil(len(x) / 2) - 1]


def repeats(w):
    n = Counter(zip(w, w[1:], w[2:]))
    return len({k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)})


def language_rows(names):
    """Texts of two alphabets for each pair of names, some of them odd for their language."""
    rng = random.Random(6)
    rows = []
    for k, lang in enumerate(names):
        letters = "abcdefgh" if k % 2 else "stuvwxyzé"
        vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(80)]
        for _ in range(40):
            rows.append((len(rows), " ".join(rng.choices(vocabulary, k=rng.randint(55, 120))), lang))
        rows.append((len(rows), " ".join("".join(rng.choices("0123456789", k=7)) for _ in range(60)), lang))
        rows.append((len(rows), "too short", lang))
    return rows + [(len(rows), None, names[0]), (len(rows) + 1, "", names[0])]


@pytest.mark.parametrize("names", [["de", "fr"], ["zh-Hans-CN", "zh-Hans-TW", None, "", "a\tb", "a b"]])
def test_bands_are_brute_force(spark, names):
    rows = language_rows(names)
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "lang"]).collect()}
    want = verdicts(rows)
    for i, (value, kept) in want.items():
        assert got[i].word_logp == (None if value is None else pytest.approx(value, rel=1e-4)), rows[i]
        assert got[i].kept == kept, rows[i]
    assert any(not kept for i, (_, kept) in want.items() if not got[i].base_failed)


def test_a_languages_name_changes_nothing(spark):
    figures = []
    for names in (["de", "fr"], ["zh-Hans-CN", "zh-Hans-TW"]):
        rows = quality.judged(spark.createDataFrame(language_rows(names), "doc_id long, text string, lang string"), ["doc_id", "lang"]).collect()
        figures.append({r.doc_id: r.word_logp for r in rows})
    assert figures[0] == figures[1]


def test_joined_without_a_broadcast(spark, monkeypatch):
    rows = language_rows(["de", None])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {tuple(r) for r in quality.judged(docs, ["doc_id", "lang"]).collect()}
    monkeypatch.setattr(quality, "LANGUAGES", 0)
    assert {tuple(r) for r in quality.judged(docs, ["doc_id", "lang"]).collect()} == one


def test_base_columns_are_sql(spark):
    import duckdb

    from lodestone.llm import sql

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(sql.QUALITY_BASE)
    names = [c[0] for c in cur.description]
    want = {r[0]: r for r in cur.fetchall()}
    got = {r.doc_id: r for r in quality.op4_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == want
