"""Identifiers to words: splitting, merging of short parts, styles, stems.

All but the stemmer are column expressions, so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, stored
from .porter2 import stem

MOST_LENGTH, LEAST_SPLIT, STEM_ABOVE = 256, 3, 6
#: Where a run of letters is cut. Attached: the last of several capitals begins the next word.
ATTACHED = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
LOOSE = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[a-z])"
DELIMITER, UPPER, LOWER, CAPITALIZED = 1, 2, 3, 4


def cut_text(token: Column, attach_upper: bool = True, most: int = MOST_LENGTH) -> Column:
    """An identifier's words as they are written, with blanks between them and for all that is no letter."""
    # blanks around a token count only where it is cut
    trimmed = F.when(F.length(token) > most, F.substring(F.regexp_replace(token, r"^\s+|\s+$", ""), 1, most)).otherwise(token)
    return F.regexp_replace(trimmed, f"[^a-zA-Z]+|{ATTACHED if attach_upper else LOOSE}", " ")


def split_identifier(token: Column, attach_upper: bool = True, single_shot: bool = False, least: int = LEAST_SPLIT, most: int = MOST_LENGTH) -> Column:
    """Lower-cased words of an identifier.

    A word shorter than ``least`` is joined to the long word before it and to the one after it,
    each a further word; it is a word of its own only if there is no long one before it. ``single_shot`` drops it.
    """
    # words are letters, so that they can be lower-cased as one text
    words = F.array_remove(F.split(F.lower(cut_text(token, attach_upper, most)), " "), "")
    if single_shot:
        return words if least <= 1 else F.filter(words, lambda w: F.length(w) >= least)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("last"), F.lit("").alias("short"))

    def step(acc: Column, w: Column) -> Column:
        long = F.struct(
            F.concat(acc["out"], F.array(w), F.when(acc["short"] != "", F.array(F.concat(acc["short"], w))).otherwise(none)).alias("out"),
            w.alias("last"),
            F.lit("").alias("short"),
        )
        brief = F.struct(F.concat(acc["out"], F.array(F.concat(acc["last"], w))).alias("out"), F.lit("").alias("last"), w.alias("short"))
        return F.when(F.length(w) >= least, long).otherwise(brief)

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def styled_parts(token: Column, attach_upper: bool = True, most: int = MOST_LENGTH) -> Column:
    """array<struct<text, style>> of all parts, delimiters too; ``reconstruct`` is its inverse."""
    trimmed = F.substring(F.regexp_replace(token, r"^\s+|\s+$", ""), 1, most)
    runs = F.regexp_extract_all(trimmed, F.lit("[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    cut = ATTACHED if attach_upper else LOOSE
    parts = F.filter(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-zA-Z]"), F.split(r, cut)).otherwise(F.array(r)))), lambda p: p != "")

    def style(p: Column) -> Column:
        return F.when(~p.rlike("^[a-zA-Z]"), F.lit(DELIMITER)).when(p == F.lower(p), F.lit(LOWER)).when((p == F.upper(p)) & (F.length(p) > 1), F.lit(UPPER)).otherwise(F.lit(CAPITALIZED))

    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[a-zA-Z]"), F.lower(p)).otherwise(p).alias("text"), style(p).alias("style")))


def reconstruct(parts: Column) -> Column:
    """The identifier that ``styled_parts`` came from."""

    def spelt(p: Column) -> Column:
        text, style = p["text"], p["style"]
        return F.when(style == UPPER, F.upper(text)).when(style == CAPITALIZED, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, MOST_LENGTH))).otherwise(text)

    return F.array_join(F.transform(parts, spelt), "")


def hashed_token(token: Column) -> Column:
    """16 hexadecimal digits that stand for a literal."""
    return F.substring(F.md5(token.cast("binary")), 1, 16)


@F.pandas_udf(T.StringType())
def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(stem, na_action="ignore")


def stemmed(df: DataFrame, column: str, above: int = STEM_ABOVE) -> DataFrame:
    """``df`` with the words of ``column`` longer than ``above`` stemmed; each distinct word is stemmed once."""
    ship(df.sparkSession)
    long = df.where(F.length(column) > above).select(F.col(column).alias("__word")).distinct().withColumn("__stem", _stems("__word"))
    long = stored(long, "stems")  # so that they are broadcast if they are few
    joined = df.join(long, F.col(column) == F.col("__word"), "left")
    return joined.withColumn(column, F.coalesce("__stem", column)).drop("__word", "__stem")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for words, above in batches:
        yield pd.Series([None if w is None else [stem(x) if len(x) > n else x for x in w] for w, n in zip(words, above)])


def processed(token: Column, above: int = STEM_ABOVE, **split) -> Column:
    """The words of an identifier as ``split_identifier`` gives them, those longer than ``above`` stemmed."""
    if above < 1:
        raise ValueError("the length above which words are stemmed is at least 1")
    ship(SparkSession.active())
    return _stem_arrays(split_identifier(token, **split), F.lit(above))
