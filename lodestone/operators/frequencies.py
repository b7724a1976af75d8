"""Term and document frequencies, TF-IDF, vocabularies.

Bags are long: (token, document, value). Every measure is one or two aggregations,
which Spark sums up before it shuffles; vocabularies are joined and never collected, and
whether one is broadcast is left to its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_tf_log_idf
from ..session import stored


def term_frequency(bags: DataFrame) -> DataFrame:
    return bags.groupBy("token", "document").agg(F.sum("value").alias("value"))


def document_frequency(bags: DataFrame) -> DataFrame:
    return bags.groupBy("token").agg(F.countDistinct("document").alias("freq"))


def n_documents(bags: DataFrame) -> DataFrame:
    return bags.agg(F.countDistinct("document").alias("ndocs"))


def tf_idf(tf: DataFrame, df: DataFrame, ndocs: Column | int) -> DataFrame:
    """Tokens without a document frequency are dropped; one that all documents have keeps its rows, with 0."""
    n = ndocs if isinstance(ndocs, Column) else F.lit(ndocs)
    return tf.join(df, "token").select("token", "document", log_tf_log_idf(F.col("value"), F.col("freq"), n).alias("value"))


def pruned(df: DataFrame, least: int) -> DataFrame:
    if least < 1:
        raise ValueError("a document frequency is at least 1")
    return df if least == 1 else df.where(F.col("freq") >= least)


def greatest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent tokens; of equal ones at the end the alphabetically first."""
    if n < 1:
        raise ValueError("n is at least 1")
    return df.orderBy(F.desc("freq"), F.asc("token")).limit(n)


def indexed(df: DataFrame, column: str = "token", name: str = "token_id") -> DataFrame:
    """Dense ids from 0 in the order of distinct values, without one task sorting all of them.

    Values are range-partitioned once and stored with their place; a partition's offset is the number of
    values before it, and only those numbers meet in one place.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranged = values.repartitionByRange(n, column).sortWithinPartitions(column)
    # monotonically_increasing_id is partition * 2^33 + row, in order within a partition
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    placed = placed.select(column, F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    return placed.join(starts, "__part").select(column, (F.col("__before") + F.col("__row")).alias(name))


def ordered(df: DataFrame) -> DataFrame:
    """(token, freq, token_id): a vocabulary with ids in alphabetical order."""
    df = stored(df, "vocabulary")
    return df.join(indexed(df), "token").select("token", "freq", "token_id")


def constructed(rows: DataFrame, order: str) -> DataFrame:
    """(token, freq) of rows that name tokens more than once: by ``order`` the last of a token counts, and frequencies are not summed."""
    return rows.where("token is not null").groupBy("token").agg(F.max_by("freq", order).alias("freq"))


def merged(models: list[DataFrame], least: int = 1, size: int | None = None) -> DataFrame:
    """One vocabulary of several: frequencies are summed, then pruned and cut."""
    total = models[0]
    for m in models[1:]:
        total = total.unionByName(m)
    total = pruned(total.groupBy("token").agg(F.sum("freq").alias("freq")), least)
    return total if size is None else greatest(total, size)


def identifier_frequencies(identifiers: DataFrame, split: Column) -> DataFrame:
    """(num_files, num_occ, num_repos, token, token_split) of rows (token, repository_id, path)."""
    per = identifiers.groupBy("token").agg(F.countDistinct("path").alias("num_files"), F.count("*").alias("num_occ"), F.countDistinct("repository_id").alias("num_repos"))
    return per.select("num_files", "num_occ", "num_repos", "token", F.array_join(split, " ").alias("token_split"))


def distinct_identifiers(identifiers: DataFrame, split: Column) -> DataFrame:
    return identifiers.select("token").distinct().select("token", F.array_join(split, " ").alias("token_split"))


def looked_up(df: DataFrame, index: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Rows with the id of their value (column ``column``_id in ``index``); unknown values are dropped, or fail with ``strict``."""
    if not strict:
        return df.join(index, column)
    found = df.join(index, column, "left")
    id_ = f"{column}_id"
    return found.withColumn(id_, F.coalesce(id_, F.raise_error(F.concat(F.lit("no id for "), F.col(column).cast("string"))).cast("long")))


def common_tokens(vocabularies: list[DataFrame]) -> DataFrame:
    out = vocabularies[0].select("token")
    for v in vocabularies[1:]:
        out = out.join(v.select("token"), "token", "left_semi")
    return out.distinct()
