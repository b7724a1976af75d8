"""Files of repositories as a table, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..columns import FILES
from ..session import ship


def load_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    if isinstance(paths, str):
        return spark.read.parquet(paths)
    if isinstance(paths, (list, tuple)) and paths and all(isinstance(p, str) for p in paths):
        return spark.read.parquet(*paths)
    raise ValueError(f"a path or a list of paths is needed, got {paths!r}")


def document_files(docs: DataFrame) -> DataFrame:
    """A documents table (doc_id, text, lang, source) as files: the source is the repository."""
    return docs.select(
        F.col("source").alias("repository_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("blob_id"),
        F.lit(None).cast("string").alias("commit_hash"),
        "lang",
        F.col("text").alias("content"),
        F.lit(False).alias("is_binary"),
    )


class RepositoryFiles(DataSource):
    """``spark.read.format("repository_files").load(root)``: text files below ``root``, its folders the repositories.

    The folder must be visible to all executors. A partition reads one repository.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _RepositoryReader(self.options["path"])


class _RepositoryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.root).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import hashlib

        top = Path(partition.value)
        for path in sorted(p for p in top.rglob("*") if p.is_file() and ".git" not in p.parts):
            raw = path.read_bytes()
            binary = b"\0" in raw[:8000]
            yield top.name, str(path.relative_to(top)), hashlib.sha1(raw).hexdigest(), None, None, None if binary else raw.decode(errors="replace"), binary


def read_repositories(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(RepositoryFiles)
    return spark.read.format("repository_files").load(root)


def save_parquet(df: DataFrame, path: str) -> None:
    """Fails if there is something at ``path``."""
    df.write.parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """One file with a header, in place of what was there; for small results."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def save_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
