"""What the first review found missing: each of these failed before its change."""

import base64
import random

from lodestone.llm import decontaminate, license_scan, secret_scan, simhash


def near_corpus():
    """Texts with copies of which one passage is replaced or appended, at similarities around 0.8, beside a line that all share."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 240))]
        line = "all of these texts end in this same line of words".split() * rng.randint(0, 1)
        rows.append(base + line)
        for k in range(3):
            n = round(len(base) * rng.uniform(0.04, 0.24))
            at = rng.randrange(len(base) - n)
            other = [word() for _ in range(n)]
            rows.append((base[:at] + other + base[at + n :] if k else base + other) + line)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def plain_groups(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    first = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and first[i] != first[j]:
                lo, hi = sorted((first[i], first[j]))
                first = [lo if f == hi else f for f in first]
    return dict(enumerate(first))


def test_near_groups_are_brute_force(spark):
    rows = near_corpus()
    got = {r.doc_id: r.first for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_case_hides_no_passage(spark):
    item = "Anna told Boris that Clara gave three Apples of 7 kg to David and Emil before the Straße to Fulda closed"
    assert not any(all(not w[:1].isupper() for w in item.split()[i : i + 13]) for i in range(len(item.split()) - 12))
    other = item.upper().replace("THREE", "four").replace("7", "9")
    texts = ["so " + item.upper() + " it says", item.lower(), item, other, item.upper().replace("BORIS", "BERTA")[:60]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.reparameterised, r.n_windows <= r.n_item_windows) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {0: (False, True), 1: (False, True), 2: (False, True), 3: (True, True)}


def test_keys_of_all_short_lengths():
    rng = random.Random(5)
    der = lambda tag, body: bytes([tag, len(body)]) + body
    one, zero = der(2, b"\1"), der(2, b"\0")
    oid = lambda x: der(6, bytes.fromhex(x))
    p256 = oid("2a8648ce3d0201") + oid("2a8648ce3d030107")
    keys = {
        "MEECAQAw": der(0x30, zero + der(0x30, p256) + der(4, der(0x30, one + der(4, rng.randbytes(32))))),
        "MDECAQEE": der(0x30, one + der(4, rng.randbytes(32)) + der(0xA0, oid("2a8648ce3d030107"))),
        "MFECAQEw": der(0x30, one + der(0x30, oid("2b6570")) + der(4, der(4, rng.randbytes(32))) + der(0x81, b"\0" + rng.randbytes(32))),
        "MEcCAQAw": der(0x30, zero + der(0x30, oid("2b6571")) + der(4, der(4, rng.randbytes(57)))),
    }
    for n in range(0x30, 0x70):
        keys[n] = der(0x30, one + der(4, rng.randbytes(n - 5)))
        assert keys[n][1] == n
    for start, raw in keys.items():
        text = base64.b64encode(raw).decode()
        assert isinstance(start, int) or text.startswith(start)
        assert ("base64", 2, 2 + len(text)) in secret_scan.spans_of(f"x {text} y"), start
        assert secret_scan.redact(f"x {text} y", secret_scan.spans_of(f"x {text} y")) == "x <BASE64> y"


def test_licenses_need_no_fixed_words(spark):
    passed = {"warranty": "This software is provided as-is, without any express or implied warranty"}
    docs = spark.createDataFrame([(1, "x y z " + passed["warranty"] + " x y z"), (2, "nothing of it")], "doc_id long, text string")
    assert [(r.doc_id, r.template, r.containment) for r in license_scan.scan(docs, passed).collect()] == [(1, "warranty", 1.0)]
    m, mpl = license_scan.Matcher(license_scan.TEMPLATES), license_scan.TEMPLATES["MPL-2.0 notice"]
    for cut, share in ((mpl.replace("License", "Licence"), 13 / 15), (mpl.replace(" License, v. 2.0.", ""), 12 / 15)):
        assert [(f[0], f[3]) for f in m.find("alpha beta " * 9 + cut + " gamma delta" * 9)] == [("MPL-2.0 notice", share)]


def test_no_window_that_holds_enough_lacks_the_gate():
    for text in license_scan.TEMPLATES.values():
        own = set(license_scan.shingles(license_scan.WORDS.findall(text.lower())))
        rest = own - set(license_scan.gate(own))
        assert len(rest) / len(own) < license_scan.CONTAINED
