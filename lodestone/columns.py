"""Names and schemas of the tables that all operators share."""

from pyspark.sql import types as T

REPOSITORY, PATH, BLOB, CONTENT, LANG = "repository_id", "path", "blob_id", "content", "lang"
TOKEN, DOCUMENT, VALUE = "token", "document", "value"

FILES = T.StructType(
    [
        T.StructField(REPOSITORY, T.StringType()),
        T.StructField(PATH, T.StringType()),
        T.StructField(BLOB, T.StringType()),
        T.StructField("commit_hash", T.StringType()),
        T.StructField(LANG, T.StringType()),
        T.StructField(CONTENT, T.StringType()),
        T.StructField("is_binary", T.BooleanType()),
    ]
)

#: One row for each node of a tree. ``ancestors`` runs from the root to the parent.
NODES = T.StructType(
    [
        T.StructField(DOCUMENT, T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("pre", T.LongType()),
        T.StructField("post", T.LongType()),
        T.StructField("internal_type", T.StringType()),
        T.StructField(TOKEN, T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("ancestors", T.ArrayType(T.LongType())),
    ]
)
