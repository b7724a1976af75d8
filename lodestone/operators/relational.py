"""Projection, filters, deduplication, sampling, counting and layout of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(df: DataFrame) -> DataFrame:
    return df


def select_fields(fields: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*fields)


def rows_as(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    """Rows made of named expressions, in the order given."""
    return lambda df: df.select(*[c.alias(n) for n, c in columns.items()])


def repositories_like(pattern: str, column: str = "repository_id") -> Callable[[DataFrame], DataFrame]:
    """Rows whose repository has a match of ``pattern`` anywhere."""
    return lambda df: df.where(F.col(column).rlike(pattern))


def languages(names: Sequence[str] | None, blacklist: bool = False, column: str = "lang") -> Callable[[DataFrame], DataFrame]:
    """Rows in (or not in) some languages; None: all rows.

    A row without a language is in neither, but for an empty blacklist, which keeps all.
    """
    if names is None:
        return identity
    if not names:
        return lambda df: df.where(F.lit(blacklist) & (F.col(column).isNull() | F.col(column).isNotNull()))
    return lambda df: df.where(F.col(column).isin(*names) != F.lit(blacklist))


def distinct_blobs(df: DataFrame, key: str = "blob_id", order: str | None = None) -> DataFrame:
    """One row of each blob; with ``order`` the least by it, otherwise any."""
    if order is None:
        return df.dropDuplicates([key])
    least = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("__row"))
    return least.select(*[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in df.columns])


def non_empty(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(F.length(column) > 0)


def sample(fraction: float = 0.05, seed: int = 42, replacement: bool = False) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.sample(replacement, fraction, seed)


def counted(distinct: bool = False, approximate: bool = False, columns: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """One row, n: of all rows, of the distinct ones, or about the latter."""

    def run(df: DataFrame) -> DataFrame:
        if not distinct:
            return df.agg(F.count("*").alias("n"))
        row = F.struct(*(columns or df.columns))
        if approximate:
            return df.agg(F.approx_count_distinct(F.xxhash64(row)).alias("n"))
        return df.select(*(columns or df.columns)).distinct().agg(F.count("*").alias("n"))

    return run


def repartitioned(n: int | None, *keys: str, shuffle: bool = False, multiplier: int = 1) -> Callable[[DataFrame], DataFrame]:
    """``n`` partitions: by keys, by a shuffle, or by merging neighbours; None: as they are."""
    if n is None:
        return identity
    n *= multiplier
    if keys:
        return lambda df: df.repartition(n, *keys)
    return (lambda df: df.repartition(n)) if shuffle else (lambda df: df.coalesce(n))


def bucket(key: str, n: int, name: str = "bucket") -> Callable[[DataFrame], DataFrame]:
    """A column that deals rows to ``n`` buckets by key, the same in every run."""
    return lambda df: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def only_bucket(key: str, n: int, i: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def cached(level: StorageLevel | None) -> Callable[[DataFrame], DataFrame]:
    return identity if level is None else lambda df: df.persist(level)


def head_files(files: DataFrame) -> DataFrame:
    """Files of the last commit of each repository; ``files`` has commit_time."""
    return history_files(files, 0)


def history_files(files: DataFrame, depth: int, repository: str = "repository_id", time: str = "commit_time", tie: str = "commit_hash") -> DataFrame:
    """Files of the last ``depth`` + 1 commits of each repository; negative: of all."""
    if depth < 0:
        return files
    commits = files.select(repository, time, tie).distinct()
    index = F.row_number().over(Window.partitionBy(repository).orderBy(F.desc(time), F.asc(tie))) - 1
    return files.join(commits.withColumn("index", index).where(F.col("index") <= depth), [repository, time, tie])
