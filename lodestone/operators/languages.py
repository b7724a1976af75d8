"""The language of a file: by its extension where that says it, else by its content.

A multinomial model over words and marks is counted in Spark from files whose language is known. Of a word it has only the gain
over not having been seen, so the table holds no zeros: a file's score for a language is the prior, so many times
the floor as the file has tokens, and the gains of its tokens, which one join on the token brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .relational import distinct_blobs

TOKEN = r"[A-Za-z_]+|[^\x20\x09-\x0DA-Za-z_0-9]"
#: What a first line names, and the language of it.
INTERPRETERS = {"python": "Python", "ruby": "Ruby", "sh": "Shell", "bash": "Shell", "dash": "Shell", "ksh": "Shell", "zsh": "Shell", "node": "JavaScript", "php": "PHP", "lua": "Lua", "Rscript": "R", "runghc": "Haskell", "ocaml": "OCaml", "swift": "Swift"}


def token_counts(files: DataFrame, key: str) -> DataFrame:
    """(key, token, n): how often a file has each word and each mark."""
    each = files.select(key, F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("token"))
    return each.groupBy(key, "token").agg(F.count("*").alias("n"))


def language_model(files: DataFrame, smoothing: float = 0.5, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """((token, lang, gain), (lang, prior, floor)) of files (lang, content); files without a language are left out.

    Tokens that are seen fewer than ``least`` times in a language are as good as unseen in it.
    """
    known = files.where("lang is not null")
    counts = stored(token_counts(known, "lang"), "language-tokens")
    often = counts.where(F.col("n") >= least)
    gains = often.select("token", "lang", F.log((F.col("n") + smoothing) / smoothing).alias("gain"))
    size = often.agg(F.countDistinct("token").alias("words"))  # one row
    totals = often.groupBy("lang").agg(F.sum("n").alias("total"))
    files_of = known.groupBy("lang").agg(F.count("*").alias("files"))
    of = files_of.join(totals, "lang", "left").join(F.broadcast(size)).join(F.broadcast(files_of.agg(F.sum("files").alias("all"))))  # one row each
    floor = F.log(F.lit(smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * (F.col("words") + 1)))
    return gains, stored(of.select("lang", F.log(F.col("files") / F.col("all")).alias("prior"), floor.alias("floor")), "languages")


def scores(files: DataFrame, model: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """(key, lang, score) of files (key, content, candidates): the log probability with each candidate, null: each language."""
    gains, langs = model
    counts = stored(token_counts(files.select(key, "content").repartition(key), key), "file-tokens")  # texts are dealt, not their tokens
    found = counts.join(gains, "token").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    names = langs.agg(F.sort_array(F.collect_set("lang")).alias("__all"))  # one row, of as many names as there are languages
    each = files.join(F.broadcast(names)).select(key, F.explode(F.coalesce("candidates", "__all")).alias("lang"))
    sizes = counts.groupBy(key).agg(F.sum("n").alias("tokens"))
    scored = each.join(langs, "lang").join(sizes, key, "left").join(found, [key, "lang"], "left")
    return scored.select(key, "lang", (F.col("prior") + F.coalesce("tokens", F.lit(0)) * F.col("floor") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def classified(files: DataFrame, model: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """(key, lang): the candidate with the highest score, of equal ones the first by name; files of which the model knows no candidate are left out."""
    return scores(files, model, key).groupBy(key).agg(F.min_by("lang", F.struct((-F.col("score")).alias("falling"), "lang")).alias("lang"))


def interpreter(content: Column) -> Column:
    """The language that a first line of the form #!/path/name or #!/usr/bin/env name says."""
    name = F.regexp_extract(content, r"\A#![^\S\n]*(?:\S*/env[^\S\n]+(?:-\S+[^\S\n]+)*)?(?:\S*/)?([A-Za-z]+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in INTERPRETERS.items() for x in pair]), name)


def with_language(df: DataFrame, extensions: DataFrame, model: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Distinct text blobs with their language; ``extensions`` is (extension, lang), several languages of an extension are candidates.

    A file whose extension has one language is of that; one without an extension is of what its first line names. Where that leaves a file of an extension with
    candidates, or one without extension, the content decides: by ``model``, or one learned from the files that need none. Files of other extensions have no language.
    """
    text = distinct_blobs(df.where(~F.col("is_binary")).drop("lang"))
    known = extensions.groupBy("extension").agg(F.sort_array(F.collect_set("lang")).alias("candidates"))
    named = text.withColumn("extension", F.lower(F.regexp_extract("path", r"(?:^|/)[^/]+\.([^./]+)$", 1))).join(known, "extension", "left")
    sure = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).when(F.col("extension") == "", interpreter(F.coalesce("content", F.lit(""))))
    rows = stored(named.withColumn("lang", sure), "files")
    open_ = rows.where(F.col("lang").isNull() & ((F.size("candidates") > 1) | (F.col("extension") == "")) & (F.length("content") > 0))
    if model is None:
        model = language_model(rows)
    found = classified(open_.select("blob_id", "content", "candidates"), model, "blob_id").withColumnRenamed("lang", "__lang")
    lang = F.coalesce("lang", "__lang").alias("lang")
    return rows.join(found, "blob_id", "left").select(*[c for c in text.columns], lang)


def held_out_accuracy(files: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """(lang, files, right): what a model of some of the files (key, lang, content) says of the others; a file is in the one or the other by a hash of its key."""
    test = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1000)) < 1000 * share
    model = language_model(files.where(~test))
    rest = files.where(test & F.col("lang").isNotNull())
    said = classified(rest.select("key", "content", F.lit(None).cast("array<string>").alias("candidates")), model, "key").withColumnRenamed("lang", "said")
    return rest.join(said, "key", "left").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(F.col("said") == F.col("lang")).alias("right"))
