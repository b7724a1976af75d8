"""The license scan against exact containment in every window."""

import random

from lodestone.llm import license_scan as op
from lodestone.llm.license_texts import WHOLE

ALL = WHOLE | op.TEMPLATES


def changed(text, rng, share):
    """``text`` with about that share of its words replaced."""
    words = text.split()
    for i in rng.sample(range(len(words)), round(len(words) * share)):
        words[i] = "".join(rng.choices("bcdfg", k=6))
    return " ".join(words)


def documents(n=120):
    rng = random.Random(12)
    out = []
    for _ in range(n):
        name = rng.choice(list(ALL))
        say = lambda k: " ".join("".join(rng.choices("aeioulmn", k=rng.randint(2, 8))) for _ in range(k))
        out.append(f"{say(rng.randint(0, 120))}\n{changed(ALL[name], rng, rng.choice([0, 0, 0.03, 0.06, 0.1, 0.15]))}\n{say(rng.randint(0, 120))}")
    return out


def contained(words, sets):
    """Names of the templates that a window of their length holds, by trying every window."""
    out = set()
    for name, (size, own) in sets.items():
        pairs = op.shingles(words)
        for i in range(max(1, len(words) - size + 1)):
            if len(own & set(pairs[i : i + max(1, size - 1)])) / len(own) >= op.CONTAINED:
                out.add(name)
                break
    return out


def test_recall_against_every_window():
    m = op.Matcher(ALL)
    sets = {name: (len(w), set(op.shingles(w))) for name, t in ALL.items() if (w := op.WORDS.findall(t.lower()))}
    there = met = 0
    for text in documents():
        words = op.WORDS.findall(text.lower())
        want = contained(words, sets)
        every = {size: list(range(len(words))) for size in m.by_size}
        got = m.hits(words, every)
        near = {}
        for at, pair in enumerate(zip(words, [*words[1:], ""])):
            for shingle in (" ".join(pair), pair[0]):
                for size in m.gates.get(shingle, ()):
                    near.setdefault(size, []).append(at)
        gated = m.hits(words, near)
        assert set(gated) == set(got)  # the gate costs nothing
        there, met = there + len(want), met + len(want & set(gated))
        for name, windows in gated.items():
            for i, j, share in windows:
                assert share == len(sets[name][1] & set(op.shingles(words[i:j]))) / len(sets[name][1])
        found = m.find(text)
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:])) and {f[0] for f in found} <= set(gated)
    assert there > 100 and met / there >= 0.99, (met, there)


def test_a_whole_text_goes_before_its_grant():
    m = op.Matcher(ALL)
    for name in WHOLE:
        (found,) = m.find("alpha beta gamma " * 30 + changed(WHOLE[name], random.Random(1), 0.02) + " delta epsilon" * 30)
        assert found[0] == name and found[3] >= 0.9


def test_empty_tables_and_long_texts(spark):
    schema = "doc_id long, text string, template int, start string"
    assert op.scan(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000 + WHOLE["MIT"] + " word" * 300_000
    rows = op.scan(spark.createDataFrame([(1, long, 0, ""), (2, None, None, None), (None, "Released under the MIT License.", None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.template) for r in rows) == [(0, "MIT notice"), (1, "MIT")]
