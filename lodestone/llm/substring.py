"""Substring deduplication with a log-structured fingerprint index.

Documents come in batches of ascending doc_id. The index holds what earlier
batches had as sorted immutable runs of window hashes: tables in the shared
folder, bucketed and sorted by hash, so that a new batch is merge-joined with a run
without the run being shuffled or sorted again. When ``FAN_IN`` runs of one level have
gathered, they are compacted into one run of the next and deleted. The texts of a batch are kept as
a table bucketed by doc_id. A manifest names the tables that count; it is replaced last,
so a batch that breaks off leaves the index as it was. ``FingerprintIndex(spark, path)`` opens
the index at ``path`` again, in this session or a later one, and ``add`` brings the next batch.

Not every window goes into a run. Of each window of ``SIZE`` words the smallest hash
among its parts of ``PART`` words is its anchor, so equal windows have equal
anchors, and neighbouring windows mostly share one. A run holds the distinct
(anchor, doc_id) of documents, some twentieth of the windows. Windows under
an anchor that two documents share are candidates. Those of the batch and of the
historical documents that the merge-join names are then verified: they are cut from
the texts again and compared by a cryptographic digest (BLAKE2b, 128 bits) of their words as they are written; the smallest
doc_id of each decides. Documents with equal word sequences (exact copies) are first
collapsed to the one with the smallest doc_id, so a group of copies costs one.

Edge cases: a null text has no words; a document shorter than a window keeps all
its words; rows with a null doc_id have no order: they keep their words and nobody
is compared with them; rows that repeat a doc_id do not remove each other's words, and each is judged by its own text;
a batch whose doc_ids do not all follow those in the index is refused; an empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, annotate, cleaned, fresh_path, get_bytes, put_bytes, removed, ship, table, texts, written
from .decontaminate import window_hashes
from .kneser_ney import mixed

SIZE, PART = 50, 10
BATCHES = 4
FAN_IN = 2
CACHE_MOST = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(tokens: np.ndarray) -> np.ndarray:
    """The anchor of each window: its smallest mixed hash of ``PART`` words."""
    parts = mixed(window_hashes(tokens, PART))
    span = SIZE - PART + 1
    low, length = parts, 1
    while length * 2 <= span:
        low, length = np.minimum(low[:-length], low[length:]), length * 2
    return np.minimum(low[: len(low) - (span - length)], low[span - length :])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id): the distinct anchors of each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out_a, out_d = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode(errors="replace").split()
                if len(words) >= SIZE:
                    out_a.append(np.unique(anchors(hashed(words, known))))
                    out_d.append(np.full(len(out_a[-1]), doc_id))
            if out_a:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out_a)), pa.array(np.concatenate(out_d), pa.int64())], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def candidate_windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, t, at) of the windows of (doc_id, digest, text, wanted) whose anchor is in the array ``wanted``.

    h1 and h2 are the digest of the window's words, t is the text's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                digests, ids, keys, places = [], [], [], []
                for i, (doc_id, digest, text) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)))):
                    words = text.encode(errors="replace").split()
                    if len(words) < SIZE:
                        continue
                    wanted = part.column(3)[i].values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(anchors(hashed(words, known)), wanted))
                    joined = b" ".join(words)
                    ends = np.cumsum([len(w) + 1 for w in words])
                    starts, stops = np.r_[0, ends[:-1]][at].tolist(), (ends[at + SIZE - 1] - 1).tolist()
                    digests += [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(starts, stops)]
                    ids.append(np.full(len(at), doc_id))
                    keys.append(np.full(len(at), text_number(digest)))
                    places.append(at)
                if digests:
                    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    cols = [h[:, 0], h[:, 1], *map(np.concatenate, (ids, keys, places))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), k) for x, k in zip(cols, [pa.int64()] * 4 + [pa.int32()])], ["h1", "h2", "doc_id", "t", "at"])

    return docs.select("doc_id", "digest", "text", "wanted").mapInArrow(run, "h1 long, h2 long, doc_id long, t long, at int")


def text_number(digest: bytes) -> int:
    """The first eight bytes of a text's digest, as ``text_column`` has them."""
    return int.from_bytes(digest[:8], "big", signed=True)


def text_column():
    return F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")


TEXTS = "doc_id bigint, n_words bigint, digest binary, text string"
ANCHORS = "anchor bigint, doc_id bigint"


class FingerprintIndex:
    """Sorted immutable runs of anchors, by level, and the texts of each batch, below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.path = (path or fresh_path(spark, "substring-index")).rstrip("/")
        found = get_bytes(f"{self.path}/manifest.json")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.state = json.loads(found) if found else {"buckets": n, "levels": [[]], "texts": [], "last": None}
        ship(spark)

    def _write(self, rows: DataFrame, kind: str, key: str, *order: str) -> str:
        name, n = f"substring_{kind}_{uuid.uuid4().hex[:12]}", self.state["buckets"]
        with cleaned(self.spark):
            rows.repartition(n, key).write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(n, key).sortBy(key, *order).saveAsTable(name)
        return name

    def _table(self, name: str, columns: str, key: str, *order: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            place = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({', '.join((key, *order))}) into {self.state['buckets']} buckets location '{place}'")
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        removed(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self._table(name, ANCHORS, "anchor", "doc_id") for level in self.state["levels"] for name in level]

    def texts(self) -> list[tuple[int, int, DataFrame]]:
        """(least doc_id, largest, texts) of each batch."""
        return [(t["lo"], t["hi"], self._table(t["name"], TEXTS, "doc_id")) for t in self.state["texts"]]

    def _keep(self, anchors: DataFrame, batch: dict) -> None:
        """A further run, compaction where a level is full, then the new manifest; old runs go last."""
        levels = [list(x) for x in self.state["levels"]]
        levels[0].append(self._write(anchors, "run", "anchor", "doc_id"))
        old = []
        for k in range(len(levels)):
            if len(levels[k]) >= self.fan_in:
                full, levels[k] = levels[k], []
                runs = [self._table(name, ANCHORS, "anchor", "doc_id") for name in full]
                merged = runs[0]
                for r in runs[1:]:
                    merged = merged.unionByName(r)
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(self._write(merged, "run", "anchor", "doc_id"))
                old += full
        self.state = self.state | {"levels": levels, "texts": [*self.state["texts"], batch], "last": batch["hi"]}
        put_bytes(f"{self.path}/manifest.json", json.dumps(self.state).encode())
        for name in old:
            self._drop(name)

    def drop_runs(self) -> None:
        for level in self.state["levels"]:
            for name in level:
                self._drop(name)
        self.state["levels"] = [[]]

    def _shared(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """(anchor, doc_id) of the batch ``rows`` and of the runs for each anchor that two documents have."""
        in_batch = rows.groupBy("anchor").agg((F.min("doc_id") != F.max("doc_id")).alias("twice"))
        hits = [run.join(in_batch, "anchor", "left_semi") for run in self.runs()]
        old = hits[0] if hits else rows.limit(0)
        for h in hits[1:]:
            old = old.unionByName(h)
        old = scratch.written(old, "old-anchors")
        both = in_batch.join(old.select("anchor").distinct().withColumn("before", F.lit(True)), "anchor", "left")
        wanted = scratch.written(both.where("twice or before").select("anchor"), "shared-anchors")
        return rows.join(wanted, "anchor", "left_semi").unionByName(old)

    def add(self, docs: DataFrame, store: bool = True) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of the rows of a batch; ``store``: later batches will be compared with it."""
        source = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        loose = with_digests(source.where("doc_id is null")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256"))
        name = self._write(with_digests(source.where("doc_id is not null")).select("doc_id", "n_words", "digest", "text"), "texts", "doc_id")
        own = self._table(name, TEXTS, "doc_id")
        ends = own.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        if ends.lo is None:
            self._drop(name)
            return loose
        if self.state["last"] is not None and ends.lo <= self.state["last"]:
            self._drop(name)
            raise ValueError(f"doc_ids of a batch follow those before it: {ends.lo} is not above {self.state['last']}")
        batch, scratch = {"name": name, "lo": ends.lo, "hi": ends.hi}, Scratch(self.spark)
        each = self._with_firsts(own, scratch)
        unique = scratch.written(each.where(~F.col("whole") & (F.col("n_words") >= SIZE)).select("doc_id", F.col("digest").alias("d")).distinct(), "unique")
        rows = scratch.written(anchor_rows(own.join(unique, "doc_id").where("digest = d")).distinct(), "anchors")
        starts = self._starts(own, ends.lo, rows, scratch)
        found = written(each.join(starts, (each["doc_id"] == F.col("__id")) & (text_column() == F.col("t")), "left").drop("__id", "t"), "removals")
        if store:
            self._keep(rows, batch)
        scratch.drop()
        return loose.unionByName(kept_rows(found, own))

    def _with_firsts(self, own: DataFrame, scratch: Scratch) -> DataFrame:
        """(doc_id, n_words, digest, whole) of the batch; whole: an exact copy with a smaller doc_id exists."""
        sums = own.select("doc_id", "n_words", "digest")
        long = sums.where(F.col("n_words") >= SIZE).groupBy("digest").agg(F.min("doc_id").alias("first"))
        old = [t.select("digest", "doc_id").join(long.select("digest"), "digest", "left_semi") for _, _, t in self.texts()]
        for t in old:
            long = long.unionByName(t.groupBy("digest").agg(F.min("doc_id").alias("first")))
        firsts = scratch.written(long.groupBy("digest").agg(F.min("first").alias("first")), "firsts")
        whole = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        return scratch.written(sums.join(firsts, "digest", "left").select("doc_id", "n_words", "digest", whole.alias("whole")), "each")

    def _starts(self, own: DataFrame, lo: int, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """(__id, t, starts): where in a text of the batch windows start whose words also start in a document with a smaller doc_id."""
        by_doc = scratch.written(self._shared(rows, scratch).groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted")), "wanted")
        old = self.texts()
        named = by_doc.select([F.count(F.when(F.col("doc_id").between(a, b), 1)).alias(f"n{k}") for k, (a, b, _) in enumerate(old)]).first() if old else ()
        seen = candidate_windows(own.join(by_doc, "doc_id"))
        for n, (_, _, t) in zip(named, old):
            if n:
                seen = seen.unionByName(candidate_windows(t.join(by_doc, "doc_id")))
        windows = scratch.written(seen, "windows")
        first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        later = windows.where(F.col("doc_id") >= lo).join(scratch.written(first, "first"), ["h1", "h2"]).where("doc_id > first")
        return later.groupBy(F.col("doc_id").alias("__id"), "t").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def with_digests(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, digest: the SHA-256 of each text's words joined by a space."""

    def make():
        def of(ts: list[str]):
            words = [t.encode(errors="replace").split() for t in ts]
            return [[len(w) for w in words], [hashlib.sha256(b" ".join(w)).digest() for w in words]]

        return of

    return annotate(docs, ["doc_id", "text"], [("n_words", "long"), ("digest", "binary")], make)


def kept_rows(found: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; ``sequence_rows`` has the text of those that lose a part."""
    partly = F.col("starts").isNotNull() & ~F.col("whole")
    some = found.where(partly).select("doc_id", F.col("digest").alias("d"), "starts").dropDuplicates(["doc_id", "d"])
    gone = F.col("whole") & (F.col("n_words") >= SIZE)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    plain = found.where(~partly).select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, empty).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"))
    changed = sequence_rows(own.join(some, "doc_id").where("digest = d"))
    return plain.unionByName(changed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    covered = np.zeros(len(words) + 1, np.int64)
    starts = starts[starts + SIZE <= len(words)]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + SIZE, -1)
    keep = np.cumsum(covered)[:-1] == 0
    return [words[i] for i in np.flatnonzero(keep)]


def sequence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text, starts) that lose a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode(errors="replace").split()
                left = kept_words(words, batch.column(2)[i].values.to_numpy())
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicated(docs: DataFrame, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, added to an index in batches of about equal size.

    path: of an index that stays, with what is in it already; otherwise the runs go when the last batch is through.
    """
    index = FingerprintIndex(docs.sparkSession, path)
    at = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at, 10_000).alias("x")).first().x if at else []
    cuts = sorted(set(cuts or []))
    made = index.add(docs.where(F.col("doc_id").isNull())) if not cuts else None
    for k in range(len(cuts) + 1):
        part = docs
        if k:
            part = part.where(F.col("doc_id") > cuts[k - 1])
        if k < len(cuts):
            part = part.where((F.col("doc_id") <= cuts[k]) | (F.col("doc_id").isNull() if k == 0 else F.lit(False)))
        elif not k:
            part = part.where("doc_id is not null")
        rows = index.add(part, store=path is not None or k < len(cuts))
        made = rows if made is None else made.unionByName(rows)
    if path is None:
        index.drop_runs()
    return made


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
