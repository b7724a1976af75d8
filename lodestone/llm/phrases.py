"""Phrase collocations: count-min sketches first, exact counts of what they let through, then scores.

First pass: every task hashes its phrases of 1 to 4 words and counts the slots of ``DEPTH`` sketch rows.
What leaves it is packed by block of slots; the blocks of all tasks are added up, each in a stream, and
kept as one bit a slot: whether the sum reaches ``least``. A sum is never below the count of a phrase in
its slot, so no frequent phrase is lost, whatever the width. Counters stop at ``least``, so a byte will do.

Second pass: a phrase whose slots are all set, as are those of the phrases within it, is counted exactly:
as text, summed in the task and then by key. The width grows with the text (a slot for ``CHARS_A_SLOT`` bytes),
and so do the number and, beyond 4,096 blocks, the length of blocks; a task holds one block at a time and
looks bits up in memory-mapped files.

Scores join a phrase with its two parts at each cut, on text; an AQE skew join can split a hot first word.
The phrases inside a longer one are its contiguous parts, so subsumption is a maximum by part and a join.

Edge cases: a null text is empty, a null lang is ``und`` (and the same as a lang of that name); empty tables give no
rows; equal rows count again; other columns are not read; a text of any length is one unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cleaned, mapped, put_bytes, removed, ship, slices, table, written
from .kneser_ney import mixed

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
DEPTH = 2
CHARS_A_SLOT = 16
#: Bytes of text that a task works on at once; a longer text is worked on alone.
AT_ONCE = 2 << 20
#: The rows of the sketch multiply by these odd numbers.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: 1 for the blanks between words, 2 for what ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
SALTS = 64


def worded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(code of each word, the distinct words, its run: equal for the words of one piece, the text it is of)."""
    lowered = pc.ascii_lower(texts).cast(pa.large_string())  # in this order: of a slice that was cast first, the offsets come out wrong
    _, offsets, content = lowered.buffers()
    edges = np.frombuffer(offsets, np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = np.frombuffer(content or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    tops = edges[:-1][edges[:-1] < len(data)]
    first[tops] = inside[tops]
    begins = np.flatnonzero(first)
    stops = np.append(np.flatnonzero(~inside | first), len(data))
    ends = stops[np.searchsorted(stops, begins, "right")]
    spelt = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(0, np.cumsum(ends - begins))), pa.py_buffer(data[inside]))
    coded = spelt.dictionary_encode()
    text = np.searchsorted(edges, begins, "right") - 1
    run = np.searchsorted(np.flatnonzero(kind == 2), begins) + text
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, run, text


def hashes(codes: np.ndarray, words: pa.Array, langs: list[str], lang: np.ndarray) -> np.ndarray:
    """A hash of each word in its language."""
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    by = np.fromiter(map(xxhash.xxh3_64_intdigest, langs), np.uint64, len(langs))
    return mixed(of[codes] + mixed(by)[lang]) if len(codes) else np.empty(0, np.uint64)


def longer(h: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of n words at each place, from those of n - 1 words and of one."""
    return mixed(h[: len(one) - n + 1] * ODD[0] + one[n - 1 :]) if len(one) >= n else np.empty(0, np.uint64)


def within(run: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from each place are of one piece."""
    return run[: len(run) - n + 1] == run[n - 1 :] if len(run) >= n else np.empty(0, bool)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """(texts, the languages, the language of each text) of at most ``AT_ONCE`` bytes, or of one text."""
    for batch in batches:
        texts = batch.column(0).fill_null("")
        coded = batch.column(1).fill_null("und").dictionary_encode()
        langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        for lo, hi in slices(texts, AT_ONCE):
            yield texts.slice(lo, hi - lo), langs, lang[lo:hi]


class Sketch:
    """Where the rows of a count-min sketch lie, and which of its slots reach ``least``."""

    def __init__(self, uri: str, width: int, least: int):
        self.uri, self.least = uri, least
        self.bits = min(48, max(16, int(width - 1).bit_length() if width > 1 else 0))
        self.block = max(18, self.bits - 12) if self.bits > 18 else self.bits
        self.blocks = 1 << self.bits - self.block
        self.counter = np.uint8 if least <= 255 else np.uint32
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def slots(self, h: np.ndarray, row: int) -> np.ndarray:
        return h * ODD[row] >> np.uint64(64 - self.bits)

    def pack(self, slots: np.ndarray, counts: np.ndarray) -> bytes:
        """Rising slots of a block and their counters."""
        gaps = np.diff(slots, prepend=0).astype("<u4")
        planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
        return zstandard.ZstdCompressor(level=1).compress(planes + counts.astype(self.counter).tobytes())

    def unpack(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        n = len(raw) // (4 + self.counter().itemsize)
        gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
        return np.cumsum(gaps, dtype=np.int64), raw[4 * n :].view(self.counter)

    def counted(self, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(block of all rows, packed counters) of hashes."""
        for row in range(DEPTH):
            slots = self.slots(h, row)
            slots.sort()
            at = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.empty(0, np.int64)
            counts = np.minimum(np.diff(np.append(at, len(slots))), self.least)
            slots = slots[at].astype(np.int64)
            block = slots >> self.block
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(slots)]):
                k = int(block[lo])
                yield row * self.blocks + k, self.pack(slots[lo:hi] - (k << self.block), counts[lo:hi])

    def add(self, total: np.ndarray, packed: bytes) -> None:
        slots, counts = self.unpack(packed)
        total[slots] = np.minimum(total[slots].astype(np.int64) + counts, self.least)

    def save(self, block: int, total: np.ndarray) -> int:
        full = total >= self.least
        put_bytes(f"{self.uri}/{block}", np.packbits(full, bitorder="little").tobytes())
        return int(full.sum())

    def _bits(self, block: int) -> np.ndarray | None:
        if block not in self._open:
            self._open[block] = mapped(f"{self.uri}/{block}", np.uint8)
        return self._open[block]

    def reached(self, h: np.ndarray) -> np.ndarray:
        """Whether all slots of each hash reach ``least``."""
        alive = np.arange(len(h))
        for row in range(DEPTH):
            slots = self.slots(h[alive], row).astype(np.int64)
            block = (slots >> self.block).astype(np.uint16)
            order = np.argsort(block, kind="stable")
            alive, slots, block = alive[order], slots[order] & (1 << self.block) - 1, block[order]
            cuts = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
            keep = np.zeros(len(alive), bool)
            for lo, hi in zip(cuts, [*cuts[1:], len(alive)]):
                if (bits := self._bits(row * self.blocks + int(block[lo]))) is not None:
                    keep[lo:hi] = bits[slots[lo:hi] >> 3] >> (slots[lo:hi] & 7).astype(np.uint8) & 1
            alive = alive[keep]
        out = np.zeros(len(h), bool)
        out[alive] = True
        return out


def sketched(texts: DataFrame, uri: str, width: int, least: int) -> Sketch:
    """The merged sketch of (text, lang): the phrases of all tasks by block, added up block by block."""
    sketch = Sketch(uri, width, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, lang in portions(batches):
            codes, words, run, text = worded(part)
            one = h = hashes(codes, words, langs, lang[text])
            found = [one]
            for n in range(2, LONGEST + 1):
                h = longer(h, one, n)
                found.append(h[within(run, n)])
            made = list(sketch.counted(np.concatenate(found)))
            blocks, packed = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], ["block", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done = None, None, 0
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now:
                    done += 0 if now is None else sketch.save(now, total)
                    now, total = block, np.zeros(1 << sketch.block, sketch.counter)
                sketch.add(total, packed.as_py())
        done += 0 if now is None else sketch.save(now, total)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["full"])

    with cleaned(texts.sparkSession):
        parts = texts.mapInArrow(count, "block long, packed binary")
        parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "full long").agg(F.sum("full")).collect()  # one row
    return sketch


def surviving(texts: DataFrame, sketch: Sketch) -> DataFrame:
    """(lang, phrase, words, n): sums by portion for the phrases that the sketch lets through, and, with no words, for all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, lang in portions(batches):
            codes, words, run, text = worded(part)
            if not len(codes):
                continue
            lang = lang[text].astype(np.int64)
            one = h = hashes(codes, words, langs, lang)
            names, spelt = pa.array(langs, pa.string()), words.cast(pa.large_string())
            all_words = np.bincount(lang, minlength=len(langs))
            yield rows(names, pa.array([""] * len(langs), pa.large_string()), 0, all_words)
            alive = sketch.reached(one)
            # the number of the phrase at each place, its text and its language
            key = lang << 32 | codes
            own, texts_of, of = np.full(len(codes), -1), None, None
            for n in range(1, LONGEST + 1):
                if n > 1:
                    h = longer(h, one, n)
                    alive = alive[: len(h)] & alive[1 : len(h) + 1] & within(run, n)
                    places = np.flatnonzero(alive)
                    alive[places] = sketch.reached(h[places])
                    key = own[: len(h)] << 32 | codes[n - 1 :]
                places = np.flatnonzero(alive)
                if not len(places):
                    break
                kinds, numbers, counts = np.unique(key[places], return_inverse=True, return_counts=True)
                last = spelt.take(pa.array(kinds & 0xFFFFFFFF))
                before = pa.array(kinds >> 32)
                texts_of = last if n == 1 else pc.binary_join_element_wise(texts_of.take(before), last, pa.scalar(" ", pa.large_string()))
                of = names.take(before) if n == 1 else of.take(before)
                own = np.full(len(alive), -1)
                own[places] = numbers
                yield rows(of, texts_of, n, counts)

    def rows(lang: pa.Array, phrase: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(np.full(len(lang), n, np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "n"])

    return texts.mapInArrow(count, "lang string, phrase string, words int, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a): exact counts of all phrases of 1 to 4 words that occur ``least`` times or more, and of all words (words 0)."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    own = Scratch(spark)
    sketch = sketched(texts, own.path("sketch"), size // CHARS_A_SLOT, least)
    sums = surviving(texts, sketch).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a"))
    counts = written(sums.where((F.col("a") >= least) | (F.col("words") == 0)), "phrase-counts")
    own.drop()
    return counts


def part(words: Column, lo: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, lo, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, k, l, r): the cut of each phrase of 2 words or more with the lowest floor(2,000,000 a / (l + r)), of equal ones the first."""
    ws = F.split("phrase", " ")
    several = counts.where("words >= 2").select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = several.select("lang", "phrase", "a", "k", part(ws, F.lit(1), F.col("k")).alias("before"), part(ws, F.col("k") + 1, F.col("words") - F.col("k")).alias("after"))
    of = counts.where("words >= 1")
    l, r = of.select("lang", F.col("phrase").alias("before"), F.col("a").alias("l")), of.select("lang", F.col("phrase").alias("after"), F.col("a").alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div cast(l + r as decimal(20,0))").alias("score")
    both = cuts.join(l, ["lang", "before"]).join(r, ["lang", "after"]).select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut"))
    return both.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.*")


def parts_of(words: Column, n: int) -> Column:
    """The contiguous parts of n words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: part(words, at, n))


def within_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the largest count of a longer phrase that holds a phrase of 2 words or more."""
    inner = [F.when(F.col("words") > n, parts_of(F.split("phrase", " "), n)).otherwise(F.array().cast("array<string>")) for n in range(2, LONGEST)]
    parts = counts.where("words >= 3").select("lang", "a", F.explode(F.concat(*inner)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases.

    A phrase goes if a longer one that holds it has ``share`` percent of its count or more.
    """
    counts = phrase_counts(docs, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    found = scored(counts).join(within_longer(counts), ["lang", "phrase"], "left")
    left = found.where(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of each of a language's salts, so that no task orders a whole language
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    made = written(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for path in {f.rsplit("/", 1)[0] for f in counts.inputFiles()}:
        removed(docs.sparkSession, path)
    return made


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
