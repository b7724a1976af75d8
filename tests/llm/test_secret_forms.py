"""Forms in which keys stand in texts."""

import base64
import random

import pytest

from lodestone.llm import secret_scan, sql

RNG = random.Random(9)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


def rsa(size=30):
    return der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" + RNG.randbytes(size)) for _ in range(8)))


def openssh():
    part = lambda x: len(x).to_bytes(4, "big") + x
    return secret_scan.OPENSSH + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(RNG.randbytes(51)) + part(RNG.randbytes(136))


def spans(text, *kinds):
    return [s for s in secret_scan.spans_of(text) if not kinds or s[0] in kinds]


@pytest.mark.parametrize("raw", [rsa(), rsa(31), rsa(32), rsa(7_000), openssh()], ids=["0", "1", "2", "long", "openssh"])
@pytest.mark.parametrize("width", [None, 64, 76, 48])
@pytest.mark.parametrize("url", [False, True])
def test_wrapped_and_url_safe(raw, width, url):
    text = (base64.urlsafe_b64encode if url else base64.b64encode)(raw).decode()
    if width:
        text = "\n  ".join(text[i : i + width] for i in range(0, len(text), width))
    for before, after in (("key: ", " end"), ("", ""), ("", "\nAnd\nmore words"), ("word\n", "\nQUJD\n")):
        assert ("base64", len(before), len(before) + len(text)) in spans(before + text + after, "base64")
    bare = text.rstrip("=")
    assert spans(f"x {bare} y", "base64") == [("base64", 2, 2 + len(bare))]


def test_keys_on_lines_after_each_other():
    keys = [base64.b64encode(rsa(k)).decode() for k in (30, 31, 32)]
    text = "\n".join(keys)
    assert [text[a:b] for _, a, b in spans(text, "base64")] == keys


def test_what_only_begins_like_a_key():
    raw = rsa()
    for text in (base64.b64encode(raw + b"abc").decode(), base64.b64encode(raw[:-3]).decode(), "M" * 500, "MII" + "A" * 400, "b3BlbnNzaC1rZXk" + "x" * 100, base64.b64encode(RNG.randbytes(300)).decode()):
        assert spans(f"x {text} y", "base64") == [], text


def test_pem_with_headers_and_escapes():
    body = base64.encodebytes(RNG.randbytes(200)).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    sealed = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}-----END RSA PRIVATE KEY-----"
    assert spans(f"a {sealed} b", "pem") == [("pem", 2, 2 + len(sealed))]
    assert spans(sealed.replace(head, ""), "pem") == []
    plain = f"-----BEGIN PRIVATE KEY-----\nComment: mine\n\n{base64.encodebytes(rsa()).decode()}-----END PRIVATE KEY-----"
    assert spans(plain, "pem", "base64") == [("pem", 0, len(plain))]
    escaped = '{"private_key": "' + plain.replace("Comment: mine\n\n", "").replace("\n", "\\n") + '\\n"}'
    assert spans(escaped, "pem") == [("pem", escaped.index("-----BEGIN"), escaped.index("END PRIVATE KEY-----") + 20)]


def test_long_hex_key():
    text = rsa(7_000).hex()
    assert ("hexkey", 0, len(text)) in spans(text)


def test_long_texts_are_quick():
    import time

    start = time.time()
    for line in ("M" * 64, "MIIE" + "A" * 60, "-" * 70, "eyJ" * 20, "-----BEGIN PRIVATE KEY-----"):
        secret_scan.spans_of("\n".join([line] * 20_000))
    secret_scan.spans_of("M" * 2_000_000)
    assert time.time() - start < 60


def test_base_spans_are_sql(spark):
    """Base counts, digest and spans of the whole table against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(sql.SECRET_BASE).fetchall()}
    rows = secret_scan.op10_secret_scan(spark, sf).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
