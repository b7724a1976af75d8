"""Secret scan with structural confirmation.

Three base patterns give spans as they stand. On top of those, candidates that
look like encoded keys are decoded and parsed before they are reported: PEM
blocks and bare base64 or hex must hold DER whose nested lengths fill their
parents exactly or an OpenSSH key record, and a signed token must have a header
that decodes to JSON with an algorithm. Whole texts are scanned.

Every candidate is decoded, whatever its length. Bare base64 may use either alphabet, padded or
not, on one line or wrapped over several: from the start of each line the length that
the first bytes give says where the key ends, there the line has to end too, and what
lies between is parsed. A PEM block may have header lines and escaped line ends; the content of
an encrypted one cannot be parsed, so its header and whole base64 confirm it.

Edge cases: a null or empty text has no spans (empty strings, zero counts, the
digest of the empty string); repeated rows are scanned each for itself; offsets
are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run of at least so many characters: the same matches as of the plain run with the shorter ones dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+[^\n]*\n)*)*)((?:[A-Za-z0-9+/=\s]|\\[nr])+?)-----END \1-----")
SEALED = re.compile(r"^(?:Proc-Type:\s*4\s*,\s*ENCRYPTED|DEK-Info:)", re.M)
#: Base64 of both alphabets: a run, and the lines that follow it with nothing but a word on them.
RUNS = [(url, re.compile(rf"(?<!{a}){a}{{{32}}}{a}*(?:\r?\n[ \t]*{a}+)*"), re.compile(f"{a}+")) for url, a in ((False, "[A-Za-z0-9+/]"), (True, "[A-Za-z0-9_-]"))]
LEAST_BASE64 = 56
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){40,}(?![0-9A-Fa-f])")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "signed", "pem", "base64", "hexkey")
OPENSSH = b"openssh-key-v1\0"
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: True for the bytes that no encoded run can hold.
BREAKS = np.ones(256, bool)
BREAKS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = False


def has_long_run(text: str, least: int = 32) -> bool:
    """Whether any hex or base64 run of ``least`` characters can be there; most texts have none and skip those patterns."""
    raw = text.encode(errors="replace")
    at = np.flatnonzero(BREAKS[np.frombuffer(raw, np.uint8)])
    return bool(np.diff(at, prepend=-1, append=len(raw)).max() > least)


def der_children(raw: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that fill ``raw`` to its last byte, else None."""
    found, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw):
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if at + n > len(raw):
            return None
        found.append((tag, raw[at : at + n]))
        at += n
    return found


def key_length(raw: bytes) -> int | None:
    """How many bytes the key that ``raw`` begins with has, as its lengths say; None if it is none or they are not there."""
    if raw.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation, its options
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
        left, at = int.from_bytes(raw[at : at + 4], "big") + 1, at + 4
        while left and at + 4 <= len(raw):  # the public keys and the private part
            at, left = at + 4 + int.from_bytes(raw[at : at + 4], "big"), left - 1
        return None if left or at > len(raw) else at
    if len(raw) < 2 or raw[0] != 0x30:
        return None
    if raw[1] < 0x80:
        return 2 + raw[1]
    k = raw[1] & 0x7F
    return 2 + k + int.from_bytes(raw[2 : 2 + k], "big") if 1 <= k <= 4 and len(raw) >= 2 + k else None


def is_key(raw: bytes) -> bool:
    """A DER key (a sequence of a small integer version or an algorithm, then key material) or an OpenSSH record."""
    if raw.startswith(OPENSSH):
        at, n = len(OPENSSH), 0
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(raw) or (n := int.from_bytes(raw[at : at + 4], "big")) > len(raw) - at - 4:
                return False
            at += 4 + n
        return at + 4 <= len(raw)
    top = der_children(raw)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_children(top[0][1])
    if not inner or len(inner) < 2:
        return False
    for tag, content in inner:
        if tag & 0x20 and der_children(content) is None:
            return False
    kinds = [tag for tag, _ in inner]
    version = kinds[0] == 0x02 and 1 <= len(inner[0][1]) <= 2
    numbers = version and len(inner) >= 6 and all(t == 0x02 for t in kinds[:6])  # RSA and DSA keys
    wrapped = version and kinds[1] == 0x30 and 0x04 in kinds  # PKCS 8
    curve = version and kinds[1] == 0x04  # EC
    sealed = kinds[:2] == [0x30, 0x04]  # encrypted PKCS 8
    return bool(numbers or wrapped or curve or sealed)


def from_base64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=not url)
    except (binascii.Error, ValueError):
        return None


def is_signed_header(text: str) -> bool:
    try:
        head = json.loads(from_base64(text, url=True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose content decodes to what it looks like."""
    if "eyJ" in text:
        for m in SIGNED.finditer(text):
            if is_signed_header(m[1]):
                yield "signed", m.start(), m.end()
    blocks = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            raw = from_base64(re.sub(r"\\[nr]", "", m[3]))
            if raw and (is_key(raw) or SEALED.search(m[2])):
                blocks.append((m.start(), m.end()))
                yield "pem", m.start(), m.end()
    if not has_long_run(text):
        return
    found = {s for url, run, line in RUNS for s in wrapped_keys(text, url, run, line)}
    for start, end in sorted(found):
        if not any(a <= start < b for a, b in blocks):
            yield "base64", start, end
    for m in HEXKEY.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and is_key(bytes.fromhex(m[0])):
            yield "hexkey", m.start(), m.end()


def wrapped_keys(text: str, url: bool, run: re.Pattern, line: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of keys in base64 that begin with a line of a run and end with one."""
    for m in run.finditer(text):
        if len(m[0]) < LEAST_BASE64 or url and not ("-" in m[0] or "_" in m[0]):
            continue
        lines, i = [x.span() for x in line.finditer(text, *m.span())], 0
        while i < len(lines):
            if end := key_end(text, lines, i, url):
                yield lines[i][0], end
                while i < len(lines) and lines[i][0] < end:
                    i += 1
            else:
                i += 1


def key_end(text: str, lines: list[tuple[int, int]], i: int, url: bool) -> int | None:
    """Where the key that begins with line ``i`` ends, None if none does."""
    start, stop = lines[i]
    if text.startswith("b3BlbnNzaC1rZXk", start):
        whole = "".join(text[a:b] for a, b in lines[i:])
        size = key_length(from_base64(whole[: len(whole) // 4 * 4], url) or b"") or len(whole) * 3 // 4
    elif text[start] == "M":  # the first six bits of a sequence
        size = key_length(from_base64(text[start : start + 8], url) or b"")
    else:
        return None
    if not size or (need := (size * 4 + 2) // 3) < LEAST_BASE64:
        return None
    parts = []
    for a, b in lines[i:]:
        parts.append(text[a:b])
        need -= b - a
        if need <= 0:
            break
    else:
        return None
    if need < 0 or not (raw := from_base64("".join(parts), url)) or not is_key(raw):
        return None
    for _ in range(-size % 3):
        b += text.startswith("=", b)
    return b


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found, low = [], text.lower()
    if any(name in low for name in NAMED):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if has_long_run(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed in ``KINDS``."""
    found = base_spans(text) + list(confirmed(text))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each secret replaced by its kind; overlapping spans become one.

    The key of an assignment stays, its value goes.
    """
    cut: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if cut and start < cut[-1][1]:
            cut[-1][1] = max(cut[-1][1], end)
        else:
            cut.append([start, end, kind])
    for start, end, kind in reversed(sorted(cut)):
        text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
    return text


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, redacted text of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for t in batch.column(1).to_pylist():
                spans.append(found := spans_of(t))
                clean.append(redact(t, found) if found else t)
            as_structs = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_structs, kind), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"])

    source = texts(docs)
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("spans", SPANS), T.StructField("redacted", T.StringType())]))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
