"""Operators as Spark runs them, on small tables with nulls, ties, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import bpe, decontaminate, html_main, language_model, license_scan, quality, secret_scan, simhash, substring, toxicity
from lodestone.llm.components import components
from lodestone.llm.kneser_ney import discounts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [[i, " ".join(rng.choices(words, k=rng.randint(0, 160))), rng.choice(["en", "de", None])] for i in range(n)]
    rows[5][1] = rows[3][1]
    rows[6][1] = rows[3][1] + " tail of it"
    rows[7][1] = "start " + " ".join(rows[8][1].split()[:70])
    rows[9][1] = None
    rows[10][1] = ""
    rows[11][1] = "x " * 3000
    rows[12][1] = " é\x1c ß " * 30
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, and columns named like the operators' own."""
    rows = [(1, "a b c " * 30, None, 1, "k"), (1, "a b c " * 30, None, 1, "k"), (None, "token = abcdefgh12", "en", None, None), (2, None, "de", 2, "z"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_simhash_groups(docs):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    fp = {i: simhash.fingerprint(t or "") for i, t, *_ in corpus()}
    assert {i: r.fp for i, r in got.items()} == {i: simhash.signed(x) for i, x in fp.items()}
    up = {i: i for i in fp}
    for a in fp:
        for b in fp:
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    assert {i: r.component_id for i, r in got.items()} == up


def test_near_groups(docs):
    got = {r.doc_id: r.first for r in simhash.near_groups(docs).collect()}
    assert got[5] == 3 and got[6] == 3 and got[20] == 20


def plain_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        covered = set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                covered |= set(range(k, k + 50))
        out[i] = (len(w), len(covered), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in covered)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_substring(docs, batches):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(docs, batches).collect()}
    assert got == plain_repeats([r[:2] for r in corpus()])


def test_decontamination(spark):
    item = "Alice bought 5 apples for 3 dollars each and then sold 2 of them, how many apples are left now?"
    other = item.replace("5", "7").replace("3", "4").replace("2", "1").replace("Alice", "Carol")
    mixed = item.replace("5 apples", "7 apples").replace("3 dollars", "7 dollars")
    texts = [item, "x y " + other + " z", mixed, None, "", "nothing of it", item.lower() + " " + item]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, item), (0, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, bench).collect()}
    # mixed has 14 words after its slots that are word for word the item's: two windows that count whatever was changed before them
    assert got == {(0, 1): False, (1, 1): True, (2, 1): False, (6, 1): False}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs):
    rows = {r.doc_id: r for r in quality.judged(docs, ["doc_id", "lang"]).collect()}
    for i, t, *_ in corpus():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert any(r.kept for r in rows.values())


def test_quality_probabilities(spark):
    """The stored model against the formula on strings."""
    words = ["aba", "abb", "ab", "ba", "c", "abac"] * 3 + ["bab", "cc"]
    df = spark.createDataFrame([(1, " ".join(words), "en")], "doc_id long, text string, lang string")
    store = quality.train(df)
    n, counts = quality.ORDER, [Counter() for _ in range(quality.ORDER + 1)]
    for w in words:
        s = "\t" * (n - 1) + w + "\n"
        counts[n].update(s[i : i + n] for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if g[1:].startswith("\t") else 1
    counts = [Counter({g: c for g, c in x.items() if not g.endswith("\t")}) for x in counts]

    def p(g):
        out = 1 / (len(counts[1]) + 1)
        for k in range(1, n + 1):
            d = discounts(*[sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)])
            own = {x: c for x, c in counts[k].items() if x[:-1] == g[n - k : -1]}
            if own:
                total = sum(own.values())
                c = own.get(g[n - k :], 0)
                out = (c - d[min(c, 3) - 1] if c else 0) / total + sum(d[min(x, 3) - 1] for x in own.values()) / total * out
        return out

    scorer = quality.Scorer(store, "en")
    for w in ["aba", "zz", "abc"]:
        s = "\t" * (n - 1) + w + "\n"
        want = sum(math.log10(p(s[i : i + n])) for i in range(len(s) - n + 1))
        (number,) = scorer.numbers([[w.encode()]])
        assert scorer.p[number[0]] == pytest.approx(want, rel=1e-4)


def test_language_model(docs):
    got = {r.doc_id: r for r in language_model.score(docs, language_model.train(language_model.texts(docs.where(~language_model.held_out())))).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    one, two = Counter(), Counter()
    for i, t, *_ in corpus():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = tokens(t)
            one.update(w)
            two.update(zip([b"\n", *w], w))
    places = Counter(b for _, b in two)
    n_of = lambda c: discounts(*[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d, e, total, v = n_of(two), n_of(places), len(two), len(one)
    rest = sum(e[min(c, 3) - 1] for c in places.values()) / total
    after, off = Counter(), Counter()
    for (a, _), c in two.items():
        after[a] += c
        off[a] += d[min(c, 3) - 1]

    def p(a, b):
        low = (places[b] - e[min(places[b], 3) - 1] if places[b] else 0) / total + rest / (v + 1)
        return ((two[a, b] - d[min(two[a, b], 3) - 1] if two[a, b] else 0) + off[a] * low) / after[a] if after[a] else low

    for i, t, *_ in corpus():
        w = tokens(t)
        assert got[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([b"\n", *w], w)), rel=1e-6)
        assert got[i].base_score == pytest.approx(sum(math.log10((one[x] + 0.5) / (sum(one.values()) + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(one[x] > 0 for x in w), sum(one.values()))


def test_bpe_digests(docs):
    tok = bpe.Tokenizer(bpe.vocabulary_file())
    for r in bpe.digests(bpe.encode(docs, bpe.vocabulary_file())).collect():
        t = corpus()[r.doc_id][1] or ""
        ids = tok.encode(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 80, 2)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 80 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_pages(spark):
    rows = [(1, "u", "<article><h1>T</h1><p>Some words of a text, long enough.</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.main_text) for r in html_main.extract(pages, ["page_id", "url"]).collect())
    assert got == [(0, ""), (1, "T\n\nSome words of a text, long enough."), (2, ""), (2, "")]


def test_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "a b c " * 10)], "item_id long, text string")
    runs = [
        lambda d: simhash.groups(d),
        lambda d: simhash.near_groups(d),
        lambda d: substring.deduplicated(d),
        lambda d: quality.judged(d, ["doc_id", "lang"]),
        lambda d: language_model.score(d, language_model.train(language_model.texts(d))),
        lambda d: bpe.encode(d, bpe.vocabulary_file()),
        lambda d: secret_scan.scan(d),
        lambda d: toxicity.score(d, toxicity.train(d, labels)),
    ]
    for k, run in enumerate(runs):
        assert run(odd).count() == 5, k
        assert run(empty).count() == 0, k
    assert {r.doc_id for r in decontaminate.contaminated(odd, bench).collect()} == {1}
    assert decontaminate.contaminated(empty, bench).count() == license_scan.scan(odd).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en", "s", 0) for i in range(60)]
    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    item = " ".join(rng.choices(words, k=30))
    rows[1] = (1, rows[0][1], "en", "s", 0)
    rows[2] = (2, rows[0][1] + " more", "en", "s", 0)
    rows[3] = (3, rows[3][1] + " " + item, "en", "s", 0)
    rows[4] = (4, rows[4][1] + " " + secret, "en", "s", 0)
    rows[5] = (5, "too short", "en", "s", 0)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == set(range(60)) - {1, 2, 3, 5}
    assert "0123456789abcdef" not in left[4].text and left[4].n_chars == len(left[4].text)
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}.keys() == left.keys()
