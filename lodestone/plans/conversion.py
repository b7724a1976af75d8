"""Conversion of models one by one: each has its own fold over its files, its own result, and its own failure.

Files are rows of a table, so that tasks read them side by side. A file is folded batch by batch into a state, the states of a model meet
under its name, and the result is written to a place of its own and then moved there. A model with a file that cannot be read,
or whose fold fails, is a row with the error and leaves nothing behind; a model whose result is there is skipped.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

MADE, SKIPPED, FAILED = "made", "skipped", "failed"
STATUS = "name string, status string, rows long, error string"
FOLDED = "name string, state binary, error string"


class Conversion:
    """A fold of a model's files: ``add`` sees a batch at a time, ``merge`` two states, ``finish`` makes the result."""

    def start(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, batch: pa.RecordBatch) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> pa.Table:
        raise NotImplementedError


class MergedBags(Conversion):
    """Bags (token, document, value) with a row for each token of a document; with ``features`` only tokens of those namespaces."""

    def __init__(self, features: list[str] | None = None):
        self.features = None if features is None else {f.rstrip(".") for f in features}

    def start(self) -> dict[tuple[str, str], float]:
        return {}

    def add(self, state, batch):
        for token, document, value in zip(*(batch.column(c).to_pylist() for c in ("token", "document", "value"))):
            if self.features is None or token.partition(".")[0] in self.features:
                state[document, token] = state.get((document, token), 0) + value
        return state

    def merge(self, a, b):
        for key, value in b.items():
            a[key] = a.get(key, 0) + value
        return a

    def finish(self, state):
        rows = sorted(state)
        columns = {"token": [t for _, t in rows], "document": [d for d, _ in rows], "value": [float(state[k]) for k in rows]}
        return pa.table({n: pa.array(v, pa.float64() if n == "value" else pa.string()) for n, v in columns.items()})


def said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def model_files(uri: str) -> list[str]:
    """The Parquet files at or below a path."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    top = uri.rstrip("/")
    return sorted(top + f.path[len(path.rstrip("/")) :] for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


def converted(spark: SparkSession, inputs: dict[str, str], destination: str, conversion: Conversion) -> DataFrame:
    """(name, status, rows, error) after the conversion of each model (name: path) to ``destination``/name.parquet."""
    ship(spark)
    fs, top = opened(destination)
    fs.create_dir(top, recursive=True)
    known, files = [], []
    for name, path in inputs.items():
        if fs.get_file_info(f"{top}/{name}.parquet").type != pafs.FileType.NotFound:
            known.append((name, SKIPPED, None, None))
            continue
        try:
            own = model_files(path)
            files += [(name, f) for f in own]
            if not own:
                known.append((name, FAILED, None, f"no files at {path}"))
        except OSError as e:
            known.append((name, FAILED, None, said(e)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, uri in zip(*(c.to_pylist() for c in batch.columns)):
                state, error = None, None
                try:
                    own, path = opened(uri)
                    state = conversion.start()
                    with own.open_input_file(path) as source:
                        for part in pq.ParquetFile(source).iter_batches():
                            state = conversion.add(state, part)
                except (OSError, pa.ArrowException, KeyError, ValueError, TypeError, AttributeError) as e:
                    state, error = None, said(e)
                yield pa.RecordBatch.from_pydict({"name": [name], "state": [None if error else pickle.dumps(state)], "error": [error]}, schema=pa.schema([("name", pa.string()), ("state", pa.binary()), ("error", pa.string())]))

    def meet(parts: pa.Table) -> pa.Table:
        name, n, error = parts["name"][0].as_py(), None, next((e for e in parts["error"].to_pylist() if e), None)
        if not error:
            try:
                state = None
                for packed in parts["state"]:
                    own = pickle.loads(packed.as_py())
                    state = own if state is None else conversion.merge(state, own)
                made = conversion.finish(state)
                n = made.num_rows
                own_fs, folder = opened(destination)
                draft = f"{folder}/_{name}-{uuid.uuid4().hex[:8]}"
                with own_fs.open_output_stream(draft) as out:
                    pq.write_table(made, out)
                own_fs.move(draft, f"{folder}/{name}.parquet")
            except (OSError, pa.ArrowException, KeyError, ValueError, TypeError, AttributeError) as e:
                n, error = None, said(e)
        return pa.table({"name": [name], "status": [FAILED if error else MADE], "rows": pa.array([n], pa.int64()), "error": pa.array([error], pa.string())})

    status = spark.createDataFrame(known, STATUS)
    if not files:
        return status
    table = spark.createDataFrame(files, "name string, file string").repartition(min(len(files), 10_000))
    made = table.mapInArrow(fold, FOLDED).groupBy("name").applyInArrow(meet, STATUS)
    # results are written as rows are made: once, whatever reads the status
    return status.unionByName(spark.createDataFrame(made.collect(), STATUS))  # a row for each model
