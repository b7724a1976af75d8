"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_folder, ship  # noqa: F401

#: Words are maximal runs of anything but these six ASCII blanks, which is also
#: how ``bytes.split()`` cuts UTF-8.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: With this Spark removes what a query shuffled as soon as that query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that end inside leave no shuffle files behind: their results are written, nobody reads those files again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows that Spark sends to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside hold ``BATCH_ROWS`` rows at most on their way to Python: whole texts of a default batch take tens of MB in the executor and again in the worker."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_ROWS if int(before) <= 0 else min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; what it held goes back to the system as it ends, since the worker stays and goes on to other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what lies between pieces still in use
            trim(0)

    return whole


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    return Scratch(df.sparkSession).written(df, name)


def removed(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of the shared folder that are needed only until what is made from them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with cleaned(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths = []


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def annotate(df: DataFrame, keep: list[str], fields: list[tuple[str, str]], make, text: str = "text", rows: int = 1000, also: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of every row, and ``fields`` (name, type) made from its whole text.

    ``make()`` is called once a task and gives a function from a list of texts
    (null: empty) to one list or Arrow array for each field; it also gets a list for each of the kept columns ``also``. A kept column whose
    name is that of a new field gives way to it. A text that is kept travels once.
    """
    ship(df.sparkSession)
    names = [n for n, _ in fields]
    keep = [c for c in keep if c not in names]
    source = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("__text"))
    at, others = source.columns.index(text if text in keep else "__text"), [keep.index(c) for c in also]
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                made = of(part.column(at).fill_null("").to_pylist(), *(part.column(k).to_pylist() for k in others))
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, arrow.field(n).type) for n, x in zip(names, made)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=keep + names)

    return source.mapInArrow(given_back(run), schema)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of texts that have ``most`` bytes together at most, or of one longer text; a null text has none."""
    total = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(the code of each word of all texts in a row, the distinct words by code, how many words each text has); no text is null."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, words, lengths = flat.indices.to_numpy(), flat.dictionary.to_pylist(), pc.list_value_length(lists).to_numpy()
    if "" in words:  # before a text's first blank, and after its last
        keep = codes != words.index("")
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[keep], minlength=len(lengths))
        codes = codes[keep]
    return codes, words, lengths


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path, None for other stores."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return uri
    return "/" + rest.lstrip("/") if scheme == "file" else None


def put_bytes(uri: str, content: bytes) -> None:
    """Write a file of the shared folder at once: a task that is run again replaces its own file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex[:8]}"
        with open(own, "wb") as f:
            f.write(content)
        os.replace(own, path)
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(content)


def get_bytes(uri: str) -> bytes | None:
    """The content of a file of the shared folder, None if there is none."""
    if path := local_path(uri):
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return f.read()
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def mapped(uri: str, dtype) -> np.ndarray | None:
    """A memory-mapped array of the shared folder, None if there is none.

    From a store that is no file system it is copied first, to a file without a name, which goes with the process.
    """
    path = local_path(uri)
    if path is None:
        fs, source = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(source).type == pafs.FileType.NotFound:
            return None
        out = tempfile.TemporaryFile()
        with fs.open_input_stream(source) as f:
            shutil.copyfileobj(f, out)
        out.flush()
        return np.memmap(out, dtype, mode="r") if out.tell() else np.empty(0, dtype)
    if not os.path.exists(path):
        return None
    return np.memmap(path, dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
