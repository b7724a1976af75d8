"""Functions on single texts, against plain versions of what they promise."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, decontaminate, html_main, license_scan, secret_scan, simhash, substring, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(bpe.vocabulary_file())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_the_librarys(tokenizer, library):
    rng = random.Random(1)
    letters = "abc  THE\n\t\r\x0b\x1c\x85\xa0éñß日本語😀'sll 0123٣½²—<|endoftext|>​　ǅ_$%'re"
    texts = ["", "x" * 400, "ab" * 3000, "the " * 50 + "<|endoftext|>"] + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert tokenizer.encode(t) == want
        assert tokenizer.decode(want) == library.decode(want, skip_special_tokens=False)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_bpe_round_trip(text):
    tok = test_bpe_round_trip.tok = getattr(test_bpe_round_trip, "tok", None) or bpe.Tokenizer(bpe.vocabulary_file())
    assert tok.decode(tok.encode(text)) == text


def test_scan_and_heap_merge_alike(tokenizer):
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choices("theandingrst", k=rng.randint(1, 90))).encode()
        ids = [tokenizer.first[b] for b in raw]
        assert tokenizer._scan(list(ids)) == tokenizer._heap(list(ids))


def plain_secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]


@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", ":", "=", " = ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", " ", "\n", "x", "ſecret"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_secrets(text):
    assert secret_scan.base_spans(text) == plain_secrets(text)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_confirmed_secrets():
    import base64
    import json

    rng = random.Random(3)
    number = lambda k: der(2, bytes([1]) + rng.randbytes(k))
    key = der(0x30, der(2, b"\0"), *[number(30) for _ in range(8)])
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END RSA PRIVATE KEY-----"
    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    signed = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(b'{12345678}')}.{b64(b'signature')}"
    kinds = lambda t: [k for k, _, _ in secret_scan.spans_of(t)]
    assert "pem" in kinds(f"x {pem} y") and "base64" in kinds(f"x {base64.b64encode(key).decode()} y") and "hexkey" in kinds(f"x {key.hex()} y")
    assert kinds(f"see {signed} there") == ["signed"]
    broken = base64.b64encode(key[:-3] + b"abcdef").decode()
    assert kinds(f"x {broken} y") == [] and kinds("eyJhbGciOiJub25l.abcdefghijkl.abc") == []
    text = 'token = "0123456789abcdef0123456789abcdef01234567" end'
    assert secret_scan.redact(text, secret_scan.spans_of(text)) == 'token = "<ASSIGN>" end'


def test_fingerprint_is_plain_majority():
    import xxhash

    def plain(t, size=4):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(len(w) - size + 1)] or [xxhash.xxh64_intdigest(b" ".join(w), 42)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ["", " \n", "One", "a b c", "a b c d", "A B c d e É é", "x y z " * 40, "\x1c\x85 q"]:
        assert simhash.fingerprint(t) == plain(t)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), 1 << 63, 500)
    b = a.copy()
    for i in range(500):
        for bit in rng.choice(64, i % 6, replace=False):
            b[i] ^= np.int64(simhash.signed(1 << int(bit)))
    far = np.bitwise_count((a ^ b).view(np.uint64))
    refs = np.array(simhash.pivots(), np.int64)
    fp = np.concatenate([a, b])
    coords = np.bitwise_count((fp[:, None] ^ refs).view(np.uint64)).astype(np.int16)
    i, _ = simhash._survivors(fp, coords, np.arange(500), np.arange(500, 1000), 4)
    assert set(i.tolist()) == set(np.flatnonzero(far <= 4).tolist())
    masks = np.array(simhash.bands(), np.int64)
    assert (((a ^ b)[:, None] & masks) == 0).any(1)[far <= 4].all()


def test_window_hashes_tell_windows_apart():
    tokens = np.random.default_rng(2).integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 2, 5, 13, 50):
        got = decontaminate.window_hashes(tokens, size)
        want = [tuple(tokens[i : i + size].tolist()) for i in range(len(tokens) - size + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    assert len(substring.anchors(tokens)) == len(tokens) - substring.SIZE + 1


def test_template_tokens():
    got = [decontaminate.template_token(w) for w in ["Alice", "5", "3.5km", "$12,", "twelve", "dollars.", "(Apples)", "APPLES", "a1b", "--"]]
    assert got == ["<name>", "<number>", "<number><unit>", "<number>", "<number>", "<unit>", "<name>", "apples", "a1b", "--"]


def test_main_text():
    field = html_main.trained()
    page = (
        "<html><head><title>t</title><script>var x = '<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='ad'>Buy &amp; go</div>"
        "<article><h1>A  title</h1><p><b>First &lt;part&gt;\n of it.<br><p>Second one.</p></article><footer>&copy; x</footer></body></html>"
    )
    assert html_main.main_text(page, field) == "A title\n\nFirst <part> of it.\n\nSecond one."
    assert [html_main.main_text(x, field) for x in ("", "<", "<!-- open", "<script>x")] == ["", html_main.main_text("<", field), "", ""]
    pages = html_main.labelled_pages(40, 99)
    right = total = 0
    for html, labels in pages:
        blocks = html_main.blocks_of(html)
        got = field.decode([html_main.features(*b) for b in blocks])
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_brute_force():
    from itertools import product

    field = html_main.trained()
    blocks = [html_main.features(*b) for b in html_main.blocks_of(html_main.labelled_pages(1, 4)[0][0])][:8]
    unary = [np.sum([field.table.get(f, (0, 0)) for f in b], 0) for b in blocks]
    value = lambda y: sum(u[k] for u, k in zip(unary, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
    assert value(field.decode(blocks)) == pytest.approx(max(map(value, product((0, 1), repeat=len(blocks)))))


def test_licenses():
    m = license_scan.Matcher(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        padded = "alpha beta gamma " * 9 + text + " delta epsilon" * 9
        assert name in [f[0] for f in m.find(padded)], name
    assert m.find("") == [] and m.find("a license to nothing at all") == []
    (name, start, end, share), = m.find("İ x\nLicensed under CC BY-NC 4.0.\ny")
    assert (name, share) == ("CC BY-NC 4.0 notice", 1.0)


def test_kept_words():
    words = [str(i).encode() for i in range(120)]
    left = substring.kept_words(words, np.array([0, 1, 60, 119]))
    assert left == [str(i).encode() for i in [*range(51, 60), *range(110, 120)]]


def test_toxicity_model():
    rng = random.Random(5)
    say = lambda *w: " ".join(rng.choices([f"word{i}" for i in range(200)], k=60) + list(w))
    rows = [(i, say(*(["vile", "rotten"] * 3 if i % 4 == 0 else ["kind"])), int(i % 4 == 0)) for i in range(400)]
    score = toxicity.Model(rows).scorer()
    assert score(say("vile", "rotten", "vile")) > 0.7 > 0.3 > score(say("nice"))
    assert 0 <= score("") <= 1 and toxicity.Model(rows[1:4]).scorer()("vile") == 0.0
