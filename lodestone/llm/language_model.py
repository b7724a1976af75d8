"""Interpolated modified Kneser-Ney bigram model over words, for perplexity.

Counted in Spark over all training rows, in three steps that each sum up within
a task before they shuffle:

1. The vocabulary: (hash of a word, its count), stored as sorted hash arrays. A
   word's place in them is its id.
2. The bigrams: a task packs its sorted distinct pairs of ids with their counts by
   shard, so that a pair costs a few bytes in the shuffle; a shard's task merges
   them into one sorted array. A frequent first word is dealt to several shards.
3. By blocks of ids: what follows a word (its total and how many followers came
   once, twice, more often) and in how many contexts it occurs itself.

All arrays lie as files in the shared folder and are memory-mapped by the
workers that score. Nothing of the model passes through the driver but the
sizes of its shards, its counts of counts, and two sums.

A text is its words (A-Z in lower case) and one end; the end is also the context of the
first word. p(w | h) = (c(h w) - D) / c(h) + g(h) p(w), with p(w) from the number
of contexts of w and, last, from the uniform distribution over the known words and
one more, which unknown words get.

Counts are 64 bits wide where 32 do not hold them. Two ids share a key of 64 bits, so that a
vocabulary of ``IDS`` words or more is refused.

Edge cases: a null or empty text is one end; rows with a null doc_id are training
rows; with no training rows at all every token is unknown and has probability 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, mapped, put_bytes, ship, table, texts, written
from .kneser_ney import HashArrays, discounts, mixed

END = b"\n"
SHARD_TOKENS = 4_000_000
BLOCK = 18
FLUSH_WORDS, FLUSH_TOKENS = 400_000, 3_000_000
CACHE_MOST = 400_000
IDS = 1 << 31
CONTEXT = ("total", "n1", "n2", "n3", "places")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


END_HASH = xxhash.xxh64_intdigest(END)


def token_hashes(texts: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens in a row, and where each text starts."""
    out, starts, n = [], [], 0
    for t in texts:
        words = t.encode(errors="replace").lower().split()
        starts.append(n)
        n += len(words) + 1
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        out.append(np.array([END_HASH], np.uint64))
    return np.concatenate(out), np.array(starts, np.int64)


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def put_counts(uri: str, counts: np.ndarray) -> None:
    """A file of counts, named by how wide they have to be."""
    kind = "u8" if len(counts) and counts.max() >= 1 << 32 else "u4"
    put_bytes(f"{uri}.{kind}", counts.astype(f"<{kind}").tobytes())


class Vocabulary(HashArrays):
    """Sorted hashes of words with their counts; ids by place."""

    def __init__(self, uri: str, bits: int):
        super().__init__(uri, bits, {"c": "<u8"})
        self.base, self.size, self.tokens = {}, 0, 0

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each of the hashes."""
        asked, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
        shards = self.shard(asked)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(asked)]):
            if files := self._files(int(shards[lo])):
                own, values = files
                at = np.minimum(np.searchsorted(own, asked[lo:hi]), len(own) - 1)
                hit = own[at] == asked[lo:hi]
                ids[lo:hi][hit] = self.base[int(shards[lo])] + at[hit]
                counts[lo:hi][hit] = values["c"][at[hit]]
        return ids[back], counts[back]


def _vocabulary(docs: DataFrame) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        ends = 0

        def rows() -> pa.RecordBatch:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(list(words.values()), pa.int64())], ["key", "c"])
            words.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update(t.encode(errors="replace").lower().split())
                ends += 1
                if len(words) > FLUSH_WORDS:
                    yield rows()
        words[END] = ends
        if ends:
            yield rows()

    spark = docs.sparkSession
    counted = written(docs.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "vocabulary-counts")
    size = counted.count()
    vocabulary = Vocabulary(fresh_path(spark, "vocabulary"), max(3, (size // 1_000_000).bit_length()))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()) for b in batches if b.num_rows]
        out = []
        if held:
            keys, c = (np.concatenate(x) for x in zip(*held))
            shards = vocabulary.shard(keys)
            for s in np.unique(shards).tolist():
                own = shards == s
                vocabulary.save(s, keys[own], c=c[own])
                out.append((s, int(own.sum()), int(c[own].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["shard", "n", "total"])

    shard = F.shiftrightunsigned("key", 64 - vocabulary.bits)
    for r in sorted(counted.select(shard.alias("shard"), "key", "c").repartition(1 << vocabulary.bits, "shard").mapInArrow(save, "shard long, n long, total long").collect()):
        vocabulary.base[r.shard] = vocabulary.size
        vocabulary.size += r.n
        vocabulary.tokens += r.total
    if vocabulary.size >= IDS:
        raise OverflowError(f"{vocabulary.size} different words, fewer than {IDS} have an id")
    return vocabulary


class Model:
    """Paths, sizes and discounts of a trained model; the arrays stay in their files."""

    def __init__(self, vocabulary: Vocabulary, uri: str):
        self.vocabulary, self.uri = vocabulary, uri
        self.shards = max(6, vocabulary.tokens // SHARD_TOKENS)
        self._open: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def place(self, first: np.ndarray, count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of each pair; a first word of many tokens has several."""
        spread = 1 + count * 2 * self.shards // max(self.vocabulary.tokens, 1)
        return ((mixed(first + 1) + (mixed(second + 1) % spread.astype(np.uint64))) % np.uint64(self.shards)).astype(np.int64)

    def file(self, name: str, kind: str) -> np.ndarray | None:
        if name not in self._open:
            self._open[name] = mapped(f"{self.uri}/{name}", kind)
        return self._open[name]

    def counts_file(self, name: str) -> np.ndarray | None:
        narrow = self.file(f"{name}.u4", "<u4")
        return self.file(f"{name}.u8", "<u8") if narrow is None else narrow

    def of_ids(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        out = {n: np.zeros(len(ids), np.int64) for n in CONTEXT}
        blocks = ids >> BLOCK
        for b in np.unique(blocks[ids >= 0]).tolist():
            own = np.flatnonzero((blocks == b) & (ids >= 0))
            for n in CONTEXT:
                if (x := self.counts_file(f"{n}-{b}")) is not None:
                    out[n][own] = x[ids[own] & ((1 << BLOCK) - 1)]
        return out

    def counts(self, first: np.ndarray, count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How often each pair occurs in the training rows."""
        out = np.zeros(len(first), np.int64)
        ok = np.flatnonzero((first >= 0) & (second >= 0))
        keys, back = np.unique((first[ok] << 32) | second[ok], return_inverse=True)
        one = np.zeros(len(keys), np.int64)
        one[back] = count[ok]
        place, found = self.place(keys >> 32, one, keys & (2**32 - 1)), np.zeros(len(keys), np.int64)
        for s in np.unique(place).tolist():
            pairs, c = self.file(f"pairs-{s}", "<u8"), self.counts_file(f"counts-{s}")
            if pairs is not None and len(pairs):
                own = np.flatnonzero(place == s)
                asked = keys[own].astype(np.uint64)
                at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
                hit = pairs[at] == asked
                found[own[hit]] = c[at[hit]]
        out[ok] = found[back]
        return out


PACKED = "shard int, kind int, a binary, b binary, c binary, d binary, e binary"


def _pair_blobs(docs: DataFrame, model: Model) -> DataFrame:
    """Packed distinct pairs of each task, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordHashes(), [], 0

        def rows() -> pa.RecordBatch:
            pairs, count, place = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(place, kind="stable")
            edges = np.flatnonzero(np.diff(place[order], prepend=-1, append=model.shards))
            out = []
            for lo, hi in zip(edges, edges[1:]):
                own = order[lo:hi]
                keys, c = summed(pairs[own], count[own])
                out.append((int(place[own[0]]), 0, pack(np.diff(keys, prepend=np.int64(0))), pack(c.astype("<u4")), b"", b"", b""))
            held.clear()
            return _packed(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                hashes, starts = token_hashes(batch.column(0).slice(at, 1000).to_pylist(), known)
                ids, counts = model.vocabulary.ids(hashes)
                first, first_n = np.r_[ids[-1], ids[:-1]], np.r_[counts[-1], counts[:-1]]
                keys, where, c = np.unique((first << 32) | ids, return_index=True, return_counts=True)
                held.append((keys, c, model.place(first[where], first_n[where], ids[where])))
                n += len(ids)
                if n > FLUSH_TOKENS:
                    yield rows()
                    n = 0
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, PACKED)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "kind", "a", "b", "c", "d", "e"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows of each shard, which arrive one after another."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[0] != now and rows:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows


def train(docs: DataFrame) -> Model:
    """The model of all rows (text) of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = _vocabulary(docs)
    model = Model(vocabulary, fresh_path(spark, "pairs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches):
            keys, c = summed(np.concatenate([np.cumsum(unpack(r[2], "<i8")) for r in rows]), np.concatenate([unpack(r[3], "<u4") for r in rows]).astype(np.int64))
            put_bytes(f"{model.uri}/pairs-{shard}", keys.astype("<u8").tobytes())
            put_counts(f"{model.uri}/counts-{shard}", c)
            out = [(-1, 2, pack(np.array([(c == k).sum() for k in range(1, 5)], "<i8")), b"", b"", b"", b"")]
            one = np.ones(len(keys), np.int64)
            first = summed(keys >> 32, c, one * (c == 1), one * (c == 2), one * (c > 2))
            second = summed(keys & (2**32 - 1), one)
            for kind, (ids, *values) in ((0, first), (1, second)):
                edges = np.flatnonzero(np.diff(ids >> BLOCK, prepend=-1, append=1 << 40))
                for lo, hi in zip(edges, edges[1:]):
                    blobs = [pack(v[lo:hi].astype("<u8")) for v in values]
                    out.append((int(ids[lo] >> BLOCK), kind, pack(np.diff(ids[lo:hi], prepend=np.int64(0)).astype("<u4")), *blobs, *[b""] * (4 - len(blobs))))
            yield _packed(out)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block, rows in _runs(batches):
            arrays = {n: np.zeros(1 << BLOCK, np.int64) for n in CONTEXT}
            for _, kind, ids, *blobs in rows:
                at = np.cumsum(unpack(ids, "<u4").astype(np.int64)) & ((1 << BLOCK) - 1)
                for n, blob in zip(CONTEXT[:4] if kind == 0 else CONTEXT[4:], blobs):
                    np.add.at(arrays[n], at, unpack(blob, "<u8").astype(np.int64))
            for n, x in arrays.items():
                put_counts(f"{model.uri}/{n}-{block}", x)
            places = arrays["places"]
            out.append([*(int((places == k).sum()) for k in range(1, 5)), int((places > 2).sum()), int(places.sum())])
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(6)], ["n1", "n2", "n3", "n4", "more", "total"])

    pairs = _pair_blobs(docs, model).repartition(model.shards, "shard").sortWithinPartitions("shard")
    stats = written(pairs.mapInArrow(merge, PACKED), "pair-statistics")
    seen = np.zeros(4, np.int64)
    for r in stats.where("kind = 2").select("a").collect():
        seen += unpack(r.a, "<i8")
    model.cut = discounts(*seen.tolist())
    blocks = (vocabulary.size >> BLOCK) + 1
    by_id = stats.where("kind < 2").repartition(min(blocks, 4096), "shard").sortWithinPartitions("shard")
    sums = by_id.mapInArrow(dense, "n1 long, n2 long, n3 long, n4 long, more long, total long").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n1", "n2", "n3", "n4", "more", "total")]).first()
    model.low_cut = discounts(sums.n1, sums.n2, sums.n3, sums.n4)
    model.places = sums.total
    d = model.low_cut
    model.low_rest = (d[0] * sums.n1 + d[1] * sums.n2 + d[2] * sums.more) / sums.total if sums.total else 1.0
    return model


def taken(c: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(c - np.array([0.0, *cut])[np.minimum(c, 3)], 0)


def log_probabilities(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 p of each token after the one before it."""
    first, first_n = np.r_[ids[-1], ids[:-1]], np.r_[counts[-1], counts[:-1]]
    distinct, back = np.unique(ids, return_inverse=True)
    own = {n: x[back] for n, x in model.of_ids(distinct).items()}
    p = taken(own["places"], model.low_cut) / max(model.places, 1) + model.low_rest / (model.vocabulary.size + 1)
    before = {n: np.r_[x[-1], x[:-1]] for n, x in own.items()}
    total = np.maximum(before["total"], 1)
    rest = sum(d * before[n] for d, n in zip(model.cut, ("n1", "n2", "n3"))) / total
    pair = taken(model.counts(first, first_n, ids), model.cut) / total + rest * p
    return np.log10(np.where(before["total"] > 0, pair, p))


FIELDS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row's whole text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value, WordHashes()
        v = own.vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes, starts = token_hashes(part.column(1).to_pylist(), known)
                ids, counts = v.ids(hashes)
                base = np.log10((counts + 0.5) / (v.tokens + 0.5 * (v.size + 1)))
                each = lambda x: np.add.reduceat(x, starts)
                n = np.diff(np.r_[starts, len(ids)])
                made = [n, each((counts > 0).astype(np.int64)), np.full(len(n), v.tokens), each(base), each(log_probabilities(own, ids, counts))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, made)], ["doc_id", *FIELDS])

    source = texts(docs)
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 2
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *(T.StructField(n, k) for n, k in zip(FIELDS, kinds))]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(texts(docs.where(~held_out())))
    rounded = [F.round(n, 6).alias(n) for n in FIELDS[3:]]  # sums in another order differ far behind that
    return score(docs, model).select("doc_id", held_out().alias("held_out"), *FIELDS[:3], *rounded)
