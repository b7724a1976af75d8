"""Decontamination against a plain version, and the cases that templates alone lose."""

import random

import pytest

from lodestone.llm import decontaminate as op
from lodestone.llm.decontaminate import FOLDED, TYPED, VERBATIM


def plain(docs, items, words=op.WORDS):
    """{(doc_id, item_id): (n_windows, n_item_windows, n_slots, reparameterised)} by comparing everything with everything."""
    lists = op.all_lists(words)
    out = {}
    for doc_id, text, lang in docs:
        for item_id, item in items:
            w, v = (text or "").split(), (item or "").split()
            size = min(op.WINDOW, len(v))
            if doc_id is None or item_id is None or not size:
                continue
            for way in (TYPED, FOLDED, VERBATIM):
                places, own = {}, set()
                for key in lists:
                    for j in range(len(v) - size + 1):
                        if not (b := op.windows_of(v, j, size, way, lists[key])):
                            continue
                        own.add(j)
                        for i in range(len(w) - size + 1):
                            a = op.windows_of(w, i, size, way, lists.get(lang or "", lists[""]))
                            if a and a[0] == b[0]:
                                seen, pairs = places.setdefault(i - j, (set(), set()))
                                seen.add(j)
                                pairs.update(zip(b[1], a[1]))
                good = [(len(seen), len(pairs), any(x != y for x, y in pairs)) for seen, pairs in places.values() if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})]
                if good:
                    best = max(good)
                    key = (doc_id, item_id)
                    if key not in out:
                        out[key] = (best[0], len(own), best[1], best[2])
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows, r.n_slots, r.reparameterised) for r in op.contaminated(d, b, **more).collect()}


def corpus():
    rng = random.Random(2)
    vocabulary = "the a of Anna Boris Clara one two drei vingt dos 5 7 12 3.5 kg dollars Tage jours and sold bought apples how many are left now? then each for ACME -- go no".split()
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 4, 8, 13, 14, 22, 30])))) for i in range(12)] + [(50, None), (51, ""), (None, "some words")]
    swap = {"5": "9", "7": "5", "Anna": "Dora", "two": "four", "kg": "miles", "drei": "vier", "vingt": "quarante", "12": "7"}
    docs = []
    for i in range(60):
        item = (items[rng.randrange(12)][1] or "").split()
        if i % 3 == 1:
            item = [swap.get(x, x) for x in item]
        if i % 3 == 2 and item:
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        text = " ".join(say(rng.randint(0, 20)) + item + say(rng.randint(0, 10)))
        docs.append((i, text.upper() if i % 7 == 0 else text, rng.choice(["en", "de", "fr", "es", "xx", None])))
    return docs + [(100, None, "en"), (101, "", None), (None, items[5][1], "en")], items


@pytest.mark.parametrize("most", [op.BROADCAST_MOST, 0])
def test_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(op, "BROADCAST_MOST", most)
    docs, items = corpus()
    want = plain(docs, items)
    assert len(want) > 40 and any(x[3] for x in want.values())
    assert found(spark, docs, items) == want


def test_short_and_slot_heavy_items_word_for_word(spark):
    heavy = "In 2019 Alice and Bob bought 12 kg for 30 dollars"
    items = [(1, "What is a quark?"), (2, heavy), (3, "quark")]
    docs = [(1, "so what is a quark, then", "en"), (2, f"x {heavy} y", "en"), (3, heavy.replace("12", "13"), "en"), (4, "nothing of it", "en")]
    assert {k: v[3] for k, v in found(spark, docs, items).items()} == {(1, 1): False, (1, 3): False, (2, 2): False, (3, 2): True}


def test_numbers_of_other_languages(spark):
    item = "Dans le jardin il y a vingt pommes rouges et le voisin en mange trois chaque matin avant midi"
    docs = [(1, item.replace("vingt", "quarante"), "fr"), (2, item.replace("vingt", "quarante"), None), (3, item.replace("vingt", "beaucoup"), "fr")]
    assert {k: v[3] for k, v in found(spark, docs, [(7, item)]).items()} == {(1, 7): True, (2, 7): True}
    own = {"xx": (frozenset({"beaucoup", "vingt"}), frozenset())}
    assert (3, 7) in found(spark, [(3, docs[2][1], "xx")], [(7, item)], words=own)


def test_what_is_word_for_word_needs_no_consistency(spark):
    item = "Anna has 5 apples and 5 pears in a basket that she carries over the hill to the old market where people buy fruit for the week"
    changed = item.replace("5 pears", "7 pears")
    assert {k: v[3] for k, v in found(spark, [(1, changed, "en")], [(1, item)]).items()} == {(1, 1): False}


def test_rows_without_a_doc_id_go_by_their_text(spark):
    item = "a question of more than thirteen words that is in the benchmark and in a document too"
    docs = spark.createDataFrame([(None, f"x {item} y", "en"), (None, "clean", None), (None, None, None), (1, item, None), (2, "clean", "en")], "doc_id long, text string, __key string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = op.without_leaks(docs.withColumnRenamed("__key", "lang"), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "clean"), (2, "clean")]


def test_long_texts_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(40))
    long = "5 " * 300_000 + item + " 7 kg" * 100_000
    assert found(spark, [(1, long, "en"), (2, "5 " * 50_000, "en")], [(1, item), (2, "3 " * 30)]).keys() == {(1, 1)}
    assert found(spark, [], [(1, item)]) == found(spark, [(1, item, "en")], []) == {}
