"""Embeddings by block factorisation: every cell of the matrix counts, the zero ones too.

Rows and columns are dealt into shards (``matrices.shard_places``), and a block is the cells of a row shard and a column
shard. A task makes its block dense in strips of rows, so no more than a strip of one block is ever held, and
zero cells are never rows of a table. A cell that is not zero adds half its confidence times the squared error;
a zero cell adds softplus(error), which only holds the product down.

An epoch has as many steps as there are shards. In step s row shard i meets column shard i + s, so that
no two blocks of a step share a row or a column: their Adagrad updates are independent and the same as one after
the other. Vectors and their sums of squared gradients are tables, written after each step to the folder that executors share;
a lost executor costs the blocks of one step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, ship, stored
from .frequencies import greatest
from .matrices import shard_places

#: Rows of a block that are dense at once.
STRIP = 256
ROW, COL, CELLS, LOSS = "row", "col", "cells", "loss"
NUMBERS = T.ArrayType(T.DoubleType())
#: What a task of a block reads and writes: vectors (side row or col), the cells of a row, and the losses.
STATE = (
    T.StructType()
    .add("block", T.IntegerType())
    .add("side", T.StringType())
    .add("place", T.LongType())
    .add("token", T.StringType())
    .add("shard", T.IntegerType())
    .add("bias", T.DoubleType())
    .add("vector", NUMBERS)
    .add("squares", NUMBERS)
    .add("at", T.ArrayType(T.LongType()))
    .add("weights", NUMBERS)
)


@dataclass(frozen=True)
class Options:
    """The confidence of a cell is base + scale * weight ^ exponent; losses are multiplied by ``multiplier``."""

    base: float = 0.1
    scale: float = 0.25
    exponent: float = 0.5
    multiplier: float = 1 / 4096
    rate: float = 1.0
    #: What Adagrad's sums start with.
    squares: float = 0.1


def checked(cooc: DataFrame) -> DataFrame:
    """The same cells; one that is negative or no number fails."""
    weight = F.col("weight").cast("double")
    why = F.when(weight < 0, "negative").when(F.isnan(weight), "nan").when(weight.isNull(), "empty")
    fail = F.raise_error(F.concat(F.lit("the matrix has a cell that is "), why)).cast("double")
    return cooc.withColumn("weight", F.when(why.isNull(), weight).otherwise(fail))


def effective_size(words: int, asked: int, shard_size: int) -> int:
    """The vocabulary's size: no larger than there are words, rounded down to whole shards."""
    size = min(words, asked)
    if size < shard_size:
        raise ValueError(f"a vocabulary of {size} words is smaller than a shard of {shard_size}; take a shard of {size} at most")
    return size - size % shard_size


def prepared(cooc: DataFrame, docfreq: DataFrame, size: int, shard_size: int) -> tuple[DataFrame, DataFrame, int]:
    """(cells, vocabulary (token), number of shards) of the most frequent words of ``docfreq`` (token, freq)."""
    size = effective_size(docfreq.count(), size, shard_size)
    words = stored(greatest(docfreq.select("token", "freq"), size).select("token"), "vocabulary")
    row, col = words.withColumnRenamed("token", "row"), words.withColumnRenamed("token", "col")
    cells = checked(cooc).join(row, "row", "left_semi").join(col, "col", "left_semi")
    return stored(cells.select("row", "col", "weight"), "cells"), words, size // shard_size


def placed(cooc: DataFrame, vocabulary: DataFrame, n_shards: int) -> DataFrame:
    """(side, token, shard, place, bias) of rows and of columns: the bias is ln(1 + cells)."""
    places = stored(shard_places(cooc, vocabulary, n_shards), "places")
    cols = cooc.groupBy(F.col("col").alias("token")).agg(F.count("*").alias("cells"))
    rows = places.select(F.lit(ROW).alias("side"), "token", "shard", "place", F.log1p("sums").alias("bias"))
    return rows.unionByName(places.join(cols, "token", "left").select(F.lit(COL).alias("side"), "token", "shard", "place", F.log1p(F.coalesce("cells", F.lit(0))).alias("bias")))


def cells_by_row(cooc: DataFrame, places: DataFrame) -> DataFrame:
    """(shard, col_shard, place, at, weights): the cells of a row in a block, at the places of their columns."""
    r = places.where(f"side = '{ROW}'").select(F.col("token").alias("row"), "shard", "place")
    c = places.where(f"side = '{COL}'").select(F.col("token").alias("col"), F.col("shard").alias("col_shard"), F.col("place").alias("at"))
    found = cooc.where("weight > 0").join(r, "row").join(c, "col")
    packed = found.groupBy("shard", "col_shard", "place").agg(F.array_sort(F.collect_list(F.struct("at", F.col("weight").cast("double").alias("weight")))).alias("cells"))
    return packed.select("shard", "col_shard", "place", F.col("cells.at").alias("at"), F.col("cells.weight").alias("weights"))


def start_vectors(places: DataFrame, dim: int, seed: int = 42, squares: float = Options.squares) -> DataFrame:
    """Places with vectors drawn from the seed and the token alone, of a deviation of 1 / sqrt(dim)."""

    def uniform(i: Column, what: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "side", "token", i), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)

    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(uniform(i, "radius")) / dim) * F.cos(6.283185307179586 * uniform(i, "angle")))
    return places.withColumn("vector", normal).withColumn("squares", F.array_repeat(F.lit(squares), dim))


class Block:
    """The vectors, biases and cells of one block."""

    def __init__(self, rows: pa.Table):
        side = np.array(rows["side"].to_pylist())
        self.parts = {s: rows.take(pa.array(np.flatnonzero(side == s))) for s in (ROW, COL, CELLS)}
        self.ids = {s: self.parts[s]["place"].to_numpy() for s in (ROW, COL)}
        self.r, self.c = self.matrix(ROW, "vector"), self.matrix(COL, "vector")
        self.row_bias, self.col_bias = (self.parts[s]["bias"].to_numpy() for s in (ROW, COL))

    def matrix(self, side: str, name: str) -> np.ndarray:
        part = self.parts[side][name].combine_chunks()
        return part.flatten().to_numpy().reshape(len(part), -1) if len(part) else np.empty((0, 0))

    def strips(self, log_total: float, options: Options):
        """(rows, derivative of the loss by each product, loss of cells, loss of zeros) strip by strip."""
        order = {side: np.argsort(ids) for side, ids in self.ids.items()}
        cells = self.parts[CELLS]
        at = cells["at"].combine_chunks()
        own = np.repeat(cells["place"].to_numpy(), np.diff(at.offsets.to_numpy())) if len(at) else np.empty(0, np.int64)
        find = lambda side, ids: order[side][np.searchsorted(self.ids[side], ids, sorter=order[side])]
        i, j, w = find(ROW, own), find(COL, at.flatten().to_numpy()), cells["weights"].combine_chunks().flatten().to_numpy()
        by_row = np.argsort(i, kind="stable")
        i, j, w = i[by_row], j[by_row], w[by_row]
        for lo in range(0, len(self.r), STRIP):
            hi = min(lo + STRIP, len(self.r))
            first, last = np.searchsorted(i, [lo, hi])
            a, b, weight = i[first:last] - lo, j[first:last], w[first:last]
            error = self.r[lo:hi] @ self.c.T + self.row_bias[lo:hi, None] + self.col_bias[None] - log_total
            full = error[a, b] - np.log(weight)
            confidence = options.base + options.scale * weight**options.exponent
            soft = np.logaddexp(0, error)
            soft[a, b] = 0
            slope = 1 / (1 + np.exp(-np.clip(error, -700, 700)))
            slope[a, b] = confidence * full
            m = options.multiplier
            yield slice(lo, hi), m * slope, m * 0.5 * float((confidence * full * full).sum()), m * float(soft.sum())

    def losses(self, log_total: float, options: Options) -> tuple[float, float]:
        found = [(a, b) for _, _, a, b in self.strips(log_total, options)]
        return sum(a for a, _ in found), sum(b for _, b in found)

    def stepped(self, log_total: float, options: Options) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float, float]:
        """({side: (vectors, sums of squares)} after one Adagrad step, the losses before it)."""
        dr, dc, l2, zero = np.zeros_like(self.r), np.zeros_like(self.c), 0.0, 0.0
        for strip, slope, a, b in self.strips(log_total, options):
            dr[strip] = slope @ self.c
            dc += slope.T @ self.r[strip]
            l2, zero = l2 + a, zero + b
        out = {}
        for side, vectors, gradient in ((ROW, self.r, dr), (COL, self.c, dc)):
            squares = self.matrix(side, "squares") + gradient**2
            out[side] = vectors - options.rate * gradient / np.sqrt(squares), squares
        return out, l2, zero


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(STATE)


def _loss_row(block: int, l2: float, zero: float) -> pa.Table:
    row = {"block": block, "side": LOSS, "vector": [l2, zero]}
    return pa.Table.from_pylist([row], schema=_schema())


def _of_blocks(vectors: DataFrame, cells: DataFrame, n_shards: int, shift: int | None) -> DataFrame:
    """The rows of ``STATE`` of the blocks (i, i + shift), or of all blocks."""
    full = lambda df: df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE])
    if shift is None:
        others = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
        two = vectors.withColumn("__other", others)
        block = F.when(F.col("side") == ROW, F.col("shard") * n_shards + F.col("__other")).otherwise(F.col("__other") * n_shards + F.col("shard"))
        return full(two.withColumn("block", block)).unionByName(full(cells.select(F.lit(CELLS).alias("side"), (F.col("shard") * n_shards + F.col("col_shard")).alias("block"), "place", "at", "weights")))
    block = F.when(F.col("side") == ROW, F.col("shard")).otherwise(F.pmod(F.col("shard") - shift, F.lit(n_shards)))
    own = cells.where(F.pmod(F.col("col_shard") - F.col("shard"), F.lit(n_shards)) == shift % n_shards)
    return full(vectors.withColumn("block", block)).unionByName(full(own.select(F.lit(CELLS).alias("side"), F.col("shard").alias("block"), "place", "at", "weights")))


def log_of_all(places: DataFrame) -> float:
    """ln(1 + all cells)"""
    n = places.where(f"side = '{ROW}'").agg(F.sum(F.round(F.expm1("bias"))).alias("n")).first()["n"]
    return float(np.log1p(n or 0))


def block_losses(vectors: DataFrame, cells: DataFrame, n_shards: int, options: Options = Options()) -> DataFrame:
    """(row_shard, col_shard, l2, zeros): the loss of the cells of a block and that of its zero cells, of vectors (side, token, shard, place, bias, vector)."""
    ship(vectors.sparkSession)
    log_total = log_of_all(vectors)

    def of(rows: pa.Table) -> pa.Table:
        return _loss_row(rows["block"][0].as_py(), *Block(rows).losses(log_total, options))

    made = _of_blocks(vectors, cells, n_shards, None).groupBy("block").applyInArrow(of, STATE)
    at = F.expr(f"cast(block div {n_shards} as int)").alias("row_shard"), F.pmod("block", F.lit(n_shards)).alias("col_shard")
    return made.select(*at, F.get("vector", F.lit(0)).alias("l2"), F.get("vector", F.lit(1)).alias("zeros"))


def losses(vectors: DataFrame, cells: DataFrame, n_shards: int, options: Options = Options()) -> DataFrame:
    """(l2, zeros): the sums of ``block_losses``."""
    return block_losses(vectors, cells, n_shards, options).agg(F.sum("l2").alias("l2"), F.sum("zeros").alias("zeros"))


def step(vectors: DataFrame, cells: DataFrame, n_shards: int, shift: int, log_total: float, options: Options = Options()) -> DataFrame:
    """Rows of ``STATE`` after one step over the blocks (i, i + shift): the vectors of all rows and columns, and the losses."""
    ship(vectors.sparkSession)

    def of(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        new, l2, zero = block.stepped(log_total, options)
        parts = [_loss_row(rows["block"][0].as_py(), l2, zero)]
        for side, (vector, squares) in new.items():
            part = block.parts[side]
            for name, values in (("vector", vector), ("squares", squares)):
                part = part.set_column(part.schema.get_field_index(name), name, _lists(values)) if len(part) else part
            parts.append(part.cast(_schema()))
        return pa.concat_tables(parts)

    return _of_blocks(vectors, cells, n_shards, shift).groupBy("block").applyInArrow(of, STATE)


def trained(cooc: DataFrame, vocabulary: DataFrame, n_shards: int, dim: int = 300, epochs: int = 40, seed: int = 42, options: Options = Options()) -> tuple[DataFrame, DataFrame, list[tuple[float, float]]]:
    """((token, embedding) of rows, the same of columns, the losses of cells and of zero cells in each epoch)."""
    places = stored(placed(cooc, vocabulary, n_shards), "sides")
    cells = stored(cells_by_row(cooc, places), "blocks")
    log_total = log_of_all(places)
    now, found = stored(start_vectors(places, dim, seed, options.squares), "vectors"), []
    for _ in range(epochs):
        l2 = zero = 0.0
        for shift in range(n_shards):
            made = stored(step(now, cells, n_shards, shift, log_total, options), "vectors")
            a, b = made.where(f"side = '{LOSS}'").agg(F.sum(F.get("vector", F.lit(0))), F.sum(F.get("vector", F.lit(1)))).first()
            l2, zero = l2 + (a or 0.0), zero + (b or 0.0)
            dropped(now)
            now = made.where(F.col("side") != LOSS)
        found.append((l2, zero))
    rows, cols = (now.where(F.col("side") == side).select("token", F.col("vector").alias("embedding")) for side in (ROW, COL))
    return rows, cols, found
