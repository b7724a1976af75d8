"""Codes of vectors by parts: Lloyd's rounds with a heap for each codebook entry.

Vectors are made whole numbers, floor(1024 x), and cut into equal parts. Each part position has a codebook. The
vectors lie in chunks in the shared folder; a chunk keeps, for each entry, a heap of the parts that the entry
holds, keyed by slack: the lower bound of the distance to any other entry less the upper bound of the distance to
its own, plus how far the entries had drifted when the part was put in. Drift adds up over the rounds: the way an
entry has moved and the longest way any other has. While the least key of a heap lies above the drift so far,
no part below it can have changed its entry, and none of them is touched; what lies at or below is popped and
compared with all entries again, exactly, in whole numbers. So a round reads bounds, rescans the violated
parts and sends only the sums of parts that moved: at most a row for each entry and task.

The driver holds the codebooks (parts x entries x width numbers, whatever the table's size), sums deltas into
them and sends them with the next round. A round's heaps are a file for each chunk, written at once, so a
task that is run again reads the last round's file and writes the same one.

Edge cases: rows whose vector is null or holds null or non-finite components are left out; a null vec_id comes after all
others, rows of one vec_id are ordered by their vectors, and each gets its row; null labels are one label; fewer rows than entries
make smaller codebooks; of equal distances the lower index wins; a table without a vector to keep gives no rows; vectors
of unequal lengths, or of a length that does not divide, fail, as do numbers beyond 52 bits and errors beyond 63. Numbers too
large for exact floats are compared as Python integers. Columns beside vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, cleaned, get_bytes, put_bytes, removed, ship, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a chunk.
CHUNK = 8192
#: Distances of a block of parts are held at once.
BLOCK = 2048
#: Bounds are rounded outwards by this share of the largest distance.
SAFE = 1e-9


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and the vector as whole numbers, of the rows whose vector is there and finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52 / SCALE, F.floor(v * SCALE)).otherwise(F.raise_error(F.lit("a component passes 52 bits")).cast("long")))
    return embeddings.where(x.isNotNull() & ~bad).select("vec_id", "label", whole.alias("x"))


def first_entries(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids: ``entries`` rows at most."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()  # bounded by entries
    widths = {len(r["x"]) for r in rows}
    if len(widths) > 1:
        raise ValueError(f"vectors of unequal lengths: {sorted(widths)}")
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), widths.pop() if widths else 0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    most = max((int(abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)  # sums and products are whole numbers that floats hold
    else:
        x, c = x.astype(object), c.astype(object)
    return (x * x).sum(1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(1)[None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entry of each part, its slack): the slack is rounded down, so that it never hides a change."""
    best, slack = np.empty(len(x), np.int32), np.empty(len(x))
    for lo in range(0, len(x), BLOCK):
        d = distances(x[lo : lo + BLOCK], c)
        at = d.argmin(1)  # the first of equal ones
        own = d[np.arange(len(d)), at].copy()
        d[np.arange(len(d)), at] = d.max(initial=0) + 1
        other = d.min(1) if d.shape[1] > 1 else own
        upper, lower = np.sqrt(own.astype(np.float64)), np.sqrt(other.astype(np.float64))
        best[lo : lo + BLOCK] = at
        slack[lo : lo + BLOCK] = lower - upper - SAFE * (1 + lower) if d.shape[1] > 1 else np.inf
    return best, slack


class Heaps:
    """The parts of a chunk at one position, in a heap for each entry; heaps that are not asked for stay packed."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, ends: np.ndarray):
        self.keys, self.rows, self.ends, self.open = keys, rows, ends, {}

    @classmethod
    def of(cls, entry: np.ndarray, keys: np.ndarray, k: int) -> Heaps:
        order = np.lexsort((keys, entry))  # a sorted list is a heap
        return cls(keys[order], order.astype(np.int32), np.cumsum(np.bincount(entry, minlength=k)))

    def _heap(self, e: int) -> list[tuple[float, int]]:
        if e not in self.open:
            lo, hi = self.ends[e - 1] if e else 0, self.ends[e]
            self.open[e] = list(zip(self.keys[lo:hi].tolist(), self.rows[lo:hi].tolist()))
        return self.open[e]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """The rows whose keys the drift of their entry has reached; they leave their heaps."""
        out = []
        begins = np.append(0, self.ends[:-1])
        tops = np.where(self.ends > begins, np.append(self.keys, np.inf)[begins], np.inf)
        for e in np.flatnonzero(tops <= drift).tolist():
            heap = self._heap(e)
            while heap and heap[0][0] <= drift[e]:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, entry: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for e, key, row in zip(entry.tolist(), keys.tolist(), rows.tolist()):
            heapq.heappush(self._heap(e), (key, row))

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.open:
            heaps = []
            for e in range(len(self.ends)):
                lo, hi = self.ends[e - 1] if e else 0, self.ends[e]
                own = self.open.get(e)
                if own is None:
                    heaps.append((self.keys[lo:hi], self.rows[lo:hi]))
                else:
                    heaps.append((np.array([h[0] for h in own], np.float64), np.array([h[1] for h in own], np.int32)))
            self.ends = np.cumsum([len(rows) for _, rows in heaps])
            self.keys, self.rows, self.open = np.concatenate([a for a, _ in heaps]), np.concatenate([b for _, b in heaps]), {}
        return self.keys, self.rows, self.ends


class Chunk:
    """The entries of a chunk's parts and their heaps, position by position."""

    def __init__(self, entry: np.ndarray, heaps: list[Heaps]):
        self.entry, self.heaps = entry, heaps

    @classmethod
    def first(cls, x: np.ndarray, books: np.ndarray, drift: np.ndarray) -> Chunk:
        entry, heaps = np.empty((len(books), x.shape[1]), np.int32), []
        for p, book in enumerate(books):
            entry[p], slack = nearest(x[p], book)
            heaps.append(Heaps.of(entry[p], slack + drift[p][entry[p]], len(book)))
        return cls(entry, heaps)

    def advance(self, x: np.ndarray, books: np.ndarray, drift: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pop what drift has violated and compare it again: (the rows that changed their entries, what their entries were) by position."""
        moved, were = [], []
        for p, (book, heaps) in enumerate(zip(books, self.heaps)):
            rows = heaps.violated(drift[p])
            now, slack = nearest(x[p][rows], book)
            heaps.push(now, slack + drift[p][now], rows)
            before = self.entry[p][rows]
            self.entry[p][rows] = now
            moved.append(rows[before != now])
            were.append(before[before != now])
        return moved, were

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"{name}{p}": a for p, h in enumerate(self.heaps) for name, a in zip(("keys", "rows", "ends"), h.packed())})
        return out.getvalue()

    @classmethod
    def load(cls, packed: bytes) -> Chunk:
        a = np.load(io.BytesIO(packed))
        return cls(a["entry"], [Heaps(a[f"keys{p}"], a[f"rows{p}"], a[f"ends{p}"]) for p in range(len(a["entry"]))])


def chunks(kept: DataFrame, dims: int) -> DataFrame:
    """(chunk, ids, labels, x): up to ``CHUNK`` vectors of a task in one row, their numbers as bytes."""
    ids, labels = (T.ArrayType(kept.schema[c].dataType) for c in ("vec_id", "label"))
    schema = T.StructType().add("chunk", "string").add("n", "long").add("ids", ids).add("labels", labels).add("x", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                ids, labels, x = batch.slice(lo, CHUNK).columns
                if set(pc.list_value_length(x).to_pylist()) - {dims}:
                    raise ValueError("vectors of unequal lengths")
                values = x.flatten().to_numpy().astype("<i8")
                narrow = values.astype("<i4")
                packed = (b"4" + narrow.tobytes()) if (narrow == values).all() else b"8" + values.tobytes()
                one = [[f"{task}-{n}"], [len(ids)], [ids.to_pylist()], [labels.to_pylist()], [packed]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, arrow)], schema=arrow)
                n += 1

    return kept.mapInArrow(run, schema)


def numbers(packed: bytes, n: int, parts: int, width: int) -> np.ndarray:
    """(part, row, component) of a chunk of n vectors."""
    return np.frombuffer(packed, "<i4" if packed[:1] == b"4" else "<i8", offset=1).reshape(n, parts, width).transpose(1, 0, 2)


def round_sums(rows: DataFrame, uri: str, k: int, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(part, entry, place, value): how the sums of entries change in round k, and, at place -1, their counts.

    Round 0 compares all parts; the heaps of round k are files under ``uri/k``.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for name, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = numbers(packed.as_py(), n, parts, width)
                if k == 0:
                    chunk = Chunk.first(x, books, drift)
                    moved, were = [np.arange(x.shape[1])] * parts, None
                else:
                    chunk = Chunk.load(get_bytes(f"{uri}/{k - 1}/{name}"))
                    moved, were = chunk.advance(x, books, drift)
                for p, changed in enumerate(moved):
                    values, to = x[p][changed].astype(np.int64), chunk.entry[p][changed]
                    np.add.at(sums[p], to, values)
                    np.add.at(counts[p], to, 1)
                    if were is not None:
                        np.subtract.at(sums[p], were[p], values)
                        np.subtract.at(counts[p], were[p], 1)
                put_bytes(f"{uri}/{k}/{name}", chunk.dump())
        both = np.concatenate([counts[:, :, None], sums], 2)
        at = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (at[0], at[1], at[2] - 1, both[at])], ["part", "entry", "place", "value"])

    made = rows.select("chunk", "n", "x").mapInArrow(run, "part long, entry long, place long, value long")
    return made.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))


def coded(rows: DataFrame, uri: str, k: int, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) with the last codebooks, from the heaps of round k - 1 (none: all parts are compared)."""
    parts, _, width = books.shape
    ids, labels = (rows.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType().add("vec_id", ids).add("label", labels).add("code", "string").add("error", "long")
    arrow, digits = to_arrow_schema(schema), [f"{e:02x}" for e in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, ids, labels, packed = (c[at] for c in batch.columns)
                x = numbers(packed.as_py(), len(ids), parts, width)
                if k == 0:
                    chunk = Chunk.first(x, books, drift)
                else:
                    chunk = Chunk.load(get_bytes(f"{uri}/{k - 1}/{name.as_py()}"))
                    chunk.advance(x, books, drift)
                wide = max(abs(x).max(initial=0), abs(books).max(initial=0)) > 2**26
                gaps = [x[p].astype(object if wide else np.int64) - books[p][chunk.entry[p]] for p in range(parts)]
                error = [int(e) for e in sum((g * g).sum(1) for g in gaps)]
                code = ["".join(map(digits.__getitem__, e)) for e in chunk.entry.T.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code), pa.array(error, pa.int64())], schema=arrow)

    return rows.select("chunk", "ids", "labels", "x").mapInArrow(run, schema)


def drifted(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(part, entry): an upper bound of how much slack each entry's parts have lost: its own way and the longest way of another."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(2)) * (1 + SAFE)
    out = np.empty_like(way)
    for p, w in enumerate(way):
        most = int(w.argmax())
        rest = np.delete(w, most).max(initial=0.0)
        out[p] = w + w[most]
        out[p, most] = w[most] + rest
    return out


def fitted(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each vector; the codebooks as an array (part, entry, component))."""
    spark = kept.sparkSession
    ship(spark)
    start = first_entries(kept, entries)
    dims = start.shape[1]
    if dims % parts:
        raise ValueError(f"vectors of {dims} components do not divide into {parts} parts")
    books = start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    own = Scratch(spark)
    rows = own.written(chunks(kept, dims), "vector-chunks")
    uri = own.path("vector-heaps")
    sums, counts, drift = np.zeros_like(books), np.zeros(books.shape[:2], np.int64), np.zeros(books.shape[:2])
    for k in range(rounds if len(start) else 0):
        with cleaned(spark):
            changes = round_sums(rows, uri, k, books, drift).collect()  # bounded by parts x entries x width
        for part, entry, place, value in changes:
            if place < 0:
                counts[part, entry] += value
            else:
                sums[part, entry, place] += value
        used = counts > 0
        new = books.copy()
        new[used] = sums[used] // counts[used][:, None]
        drift = drift + drifted(books, new)
        books = new
        if k:
            removed(spark, f"{uri}/{k - 1}")
    made = written(coded(rows, uri, rounds, books, drift), "vector-codes")
    own.drop()
    return made, books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; an entry's index is two hex digits, so ``entries`` is 256 at most."""
    if entries > 256:
        raise ValueError("two hex digits number 256 entries")
    made, books = fitted(kept_vectors(embeddings), parts, entries, rounds)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = made.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return made.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))
