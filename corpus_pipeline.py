"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Rows keep all their columns through every stage but the last. Rows without a doc_id are judged by
their texts like any other; of a group of near copies they go if one of it has a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, quality, secret_scan, simhash
from lodestone.llm.common import annotate, cleaned, fresh_path, small_batches, table, written


def apart(docs: DataFrame) -> DataFrame:
    """The text, the language and, in ``row``, all columns but the text: so no name clashes and no text travels twice."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "lang", "text")


def whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows (row, text)."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return whole(quality.judged(apart(docs), ["row", "lang", "text"]).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, once; if none has a doc_id, one of the smallest text_key."""
    groups = simhash.near_groups(docs)
    stay = written(groups.where("doc_id = first").groupBy("doc_id").agg(F.count("*").alias("__rows")), "near-stay")
    rows = docs.join(stay.where("__rows = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if stay.where("__rows > 1").limit(1).count():
        more = docs.join(stay.where("__rows > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
        rows = rows.unionByName(more.dropDuplicates(["doc_id", "text"]))
    nameless = groups.where("first is null").groupBy("group").agg(F.min("text_key").alias("text_key")).select("text_key")
    if nameless.limit(1).count():
        others = simhash.near_keys(docs.where("doc_id is null").select(F.struct("*").alias("row"), "text"), ["row"])
        rows = rows.unionByName(others.join(nameless, "text_key", "left_semi").dropDuplicates(["text_key"]).select("row.*"))
    return rows


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the text of a benchmark item, also with other numbers or names."""
    with small_batches(spark):
        return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the text."""
    make = lambda: lambda ts: [[secret_scan.redact(t, found) if (found := secret_scan.spans_of(t)) else t for t in ts]]
    rows = annotate(apart(docs), ["row", "text"], [("redacted", "string")], make)
    changed = F.col("redacted") != F.coalesce("text", F.lit(""))
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.length("redacted")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return whole(rows.select(row.alias("row"), F.when(F.col("text").isNotNull(), F.col("redacted")).alias("text")), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, input_ids and the digests of every document."""
    encoded = bpe.encode(docs, bpe.vocabulary_file())
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return encoded.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_tokens"),
        "input_ids",
        sha(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding_and_decoding", bpe_encoding),
]

#: SQL cannot express the models and fingerprints; tests/llm holds a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with cleaned(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
