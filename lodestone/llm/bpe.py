"""BPE encoding and decoding with a contiguous rank array.

A text is cut into pieces by the byte-level pattern; each distinct piece is
merged once per task and then comes from a bounded cache. A short piece keeps
its part ids and the ranks of neighbouring parts in two contiguous lists: the
smallest rank is found by scanning, the boundary behind it is deleted, and the
two ranks beside it are looked up again. A piece of more than ``SCAN_MOST``
bytes (a scan for each merge would cost the square of its length) takes the same
merges from a heap.

Edge cases: a null text is the empty text, which has no ids and decodes to the
empty text; a string of the special token in a text becomes its id, as in the
library; a null doc_id passes through; other columns are left alone.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, ship, table, texts

#: Fixed value: the public byte-level pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point all classes of the pattern are written out, for the faster engine.
PLAIN_BELOW = 0x250
SCAN_MOST = 128
CACHE_MOST = 500_000
NEVER = 1 << 60
#: Bits of an id, where a pair of ids or a rank and an id share one number.
ID = 24
ONE = (1 << ID) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in shown):
        letters[chr(256 + n)] = b
    return letters


def plain_pattern() -> re.Pattern:
    """The same pattern with the letters, numbers and blanks below ``PLAIN_BELOW`` spelt out."""
    members = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(PLAIN_BELOW)):
        kind = "Z" if regex.match(r"\s", c) else "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else None
        if kind:
            members[kind] += re.escape(c)
    letters, numbers, blanks = members["L"], members["N"], members["Z"]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class Pieces(dict):
    """Packed ids by piece; a long piece is not kept."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_MOST:
            self.clear()
        found = np.asarray(self.merge(piece.encode()), "<i4").tobytes()
        if len(piece) <= SCAN_MOST:
            self[piece] = found
        return found


class Tokenizer:
    """A byte-level BPE vocabulary as read from a ``tokenizers`` file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        vocab, byte_of = spec["model"]["vocab"], byte_letters()
        self.pairs: dict[int, int] = {}  # two ids, to the rank and the id of their union
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << ID | vocab[b]] = rank << ID | vocab[a + b]
        self.first = [0] * 256
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = raw = bytes(byte_of[c] for c in token)
            if len(raw) == 1:
                self.first[raw[0]] = i
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pieces, self.plain = regex.compile(PATTERN).findall, plain_pattern().findall
        self.cache = Pieces(self.merge)
        self.spelt = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)].__getitem__

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece]
        return self._scan(ids) if len(ids) <= SCAN_MOST else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << ID | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i] = new = least & ONE
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << ID | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID | new, NEVER)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get(ids[i] << ID | ids[j])):
                heapq.heappush(heap, (found, i, ids[i] << ID | ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            best, i, pair = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or ids[i] << ID | ids[j] != pair:
                continue
            ids[i], ids[j], after[i] = best & ONE, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        packed = self.cache.__getitem__
        cut = self.cut and any(x in text for x in self.special)
        for part in self.cut.split(text) if cut else (text,):
            if part in self.special:
                out.append(np.asarray([self.special[part]], "<i4").tobytes())
            elif part:
                pieces = self.plain if part.isascii() or ord(max(part)) < PLAIN_BELOW else self.pieces
                out += map(packed, pieces(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelt, ids)).decode(errors="replace")


def encode(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, input_ids array<int>, decoded string of every row.

    ``vocabulary`` is the content of a tokenizer file; it is broadcast (some
    2 MB, a property of the vocabulary and not of the data).
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [tok.encode_packed(t) for t in part.column(1).to_pylist()]
                values = np.frombuffer(b"".join(packed), "<i4")
                ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int64).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
                back = [tok.decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(back, pa.string())], ["doc_id", "input_ids", "decoded"])

    source = texts(docs)
    schema = T.StructType([source.schema["doc_id"], T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(given_back(run), schema)


def vocabulary_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary_file()))
