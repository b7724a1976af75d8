"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_tf_log_idf(tf: Column, df: Column, ndocs: Column) -> Column:
    """ln(1 + tf) ln(ndocs / df); 0 for a token of every document, which stays a row."""
    return F.log1p(tf) * F.log(ndocs.cast("double") / df)


def document_name(repository: Column, path: Column, blob: Column) -> Column:
    """repository//path@blob, without the parts that are empty or null."""
    part = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(F.coalesce(repository, F.lit("")), part("//", path), part("@", blob))


def vw_name(name: Column) -> Column:
    """A document name without colons, its blanks underscores."""
    return F.translate(F.replace(name, F.lit(":"), F.lit("")), " ", "_")


def clean_roles(roles: Column) -> Column:
    """A joined list of roles without IDENTIFIER."""
    return F.replace(F.replace(roles, F.lit("IDENTIFIER | "), F.lit("")), F.lit(" | IDENTIFIER"), F.lit(""))


def namespace(token: Column) -> Column:
    return F.split_part(token, F.lit("."), F.lit(1))


def after_last_dot(token: Column) -> Column:
    return F.substring_index(token, ".", -1)
