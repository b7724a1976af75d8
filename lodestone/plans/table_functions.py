"""Parsers and extractors as table functions of SQL, with failures as rows.

``register(spark)`` adds them to a session:

    SELECT n.* FROM files, LATERAL parse_python(path, content) n
    SELECT * FROM tree_bag('graphlet', TABLE(nodes) PARTITION BY document ORDER BY post)

A parser gives the nodes of a text, or one row with an error. An extractor sees a document's nodes one after the other in post-order,
so that it holds what is open above them and not the tree; what is wrong with a tree is one row with an error, and
the other documents have their bags all the same. Rows without an error have null there. Nodes come in Arrow batches; a table whose
documents already lie one after the other in post-order in each partition needs no PARTITION BY, and then a batch holds many of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf

from ..columns import NODES
from ..operators.trees import SEPARATOR, Split, has_roles
from ..session import ship
from ..sources.nodes import html_tree, python_nodes

PARSED = T.StructType([*NODES.fields, T.StructField("error", T.StringType())])
BAG = "document string, token string, value double, error string"
BAG_SCHEMA = pa.schema([("document", pa.string()), ("token", pa.string()), ("value", pa.float64()), ("error", pa.string())])


def said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


class Parser:
    @staticmethod
    def tree(document: str, content: str) -> list[list]:
        raise NotImplementedError

    def eval(self, document: str, content: str) -> Iterator[tuple]:
        if document is None or not content:
            return
        try:
            rows = self.tree(document, content)
        except (SyntaxError, ValueError, RecursionError, AssertionError) as e:
            yield (document, *[None] * (len(NODES) - 1), said(e))
            return
        for row in rows:
            yield (*row, None)


@udtf(returnType=PARSED)
class ParsePython(Parser):
    tree = staticmethod(python_nodes)


@udtf(returnType=PARSED)
class ParseHtml(Parser):
    tree = staticmethod(html_tree)


class Identifiers:
    """Words of identifiers, as the column ``words`` has them; one without a token is the empty word."""

    namespace = "i."

    @staticmethod
    def read(nodes: pa.RecordBatch) -> tuple[list, list[int]]:
        """What the nodes of a batch have to give, one after the other, and where each node's begins and ends."""
        size = lambda c: pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        roles, words, token = nodes.column("roles"), nodes.column("words"), nodes.column("token")
        marks = pc.equal(roles.flatten(), "IDENTIFIER").fill_null(False).to_numpy(zero_copy_only=False)
        names = np.bincount(np.repeat(np.arange(len(roles)), size(roles))[marks], minlength=len(roles)) > 0
        empty = names & pc.equal(pc.fill_null(token, ""), "").to_numpy(zero_copy_only=False)
        n = np.where(empty, 1, np.where(names, size(words), 0))
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.full(ends[-1], "", dtype=object)
        out[~np.repeat(empty, n)] = np.array(values(words.flatten()), dtype=object)[np.repeat(names & ~empty, size(words))]
        return out.tolist(), ends.tolist()

    def see(self, read: tuple[list, list[int]], first: int, behind: int) -> Iterable[str]:
        """What the nodes from ``first`` on give."""
        return read[0][read[1][first] : read[1][behind]]

    def rest(self) -> Iterator[str]:
        return iter(())


class Rows(Identifiers):
    """A kind that sees a node at a time."""

    @staticmethod
    def read(nodes: pa.RecordBatch) -> list[dict]:
        return [dict(zip(nodes.schema.names, row)) for row in zip(*map(values, nodes.columns))]

    def see(self, read: list[dict], first: int, behind: int) -> Iterable[str]:
        for node in read[first:behind]:
            yield from self.node(node)

    def node(self, node: dict) -> Iterator[str]:
        raise NotImplementedError


class Literals(Rows):
    namespace = "l."

    def node(self, node: dict) -> Iterator[str]:
        if "LITERAL" in (node["roles"] or ()):
            yield hashlib.md5((node["token"] or "").encode()).hexdigest()[:16]


class Sequences(Rows):
    """Three and four node types in a row."""

    namespace = "s."

    def __init__(self):
        self.last: deque[str] = deque(maxlen=4)

    def node(self, node: dict) -> Iterator[str]:
        self.last.append(node["internal_type"])
        types = list(self.last)
        yield from (SEPARATOR.join(types[-n:]) for n in (3, 4) if len(types) >= n)


class Graphlets(Rows):
    """Parent's, own and children's types: of nodes whose parent has not come the own and the children's wait."""

    namespace = "g."

    def __init__(self):
        self.waiting: dict[int, list[tuple[str, list[str]]]] = {}

    def node(self, node: dict) -> Iterator[str]:
        below = self.waiting.pop(node["node_id"], [])
        own = node["internal_type"], sorted(kind for kind, _ in below)
        for kind, kinds in below:
            yield "_".join([node["internal_type"], kind, *kinds])
        if node["parent_id"] is None:
            yield "_".join(["None", own[0], *own[1]])
        else:
            self.waiting.setdefault(node["parent_id"], []).append(own)

    def rest(self) -> Iterator[str]:
        if self.waiting:
            raise ValueError(f"no node {min(self.waiting)}, or it comes before its children")
        return iter(())


#: What each kind reads of a node besides its document, number, place and type.
READ = {"id": ("token", "roles", "words"), "lit": ("token", "roles"), "uast2seq": (), "graphlet": ("parent_id",)}
KINDS = {"id": Identifiers, "lit": Literals, "uast2seq": Sequences, "graphlet": Graphlets}


def values(column: pa.Array) -> list:
    """A column's values; equal strings are one object."""
    if pa.types.is_list(column.type):
        flat, ends = values(column.flatten()), np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        known = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
        return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)].tolist()
    return column.to_pylist()


@arrow_udtf(returnType=BAG)
class TreeBag:
    """The bags of documents, each of whose nodes come one after the other: ``kind`` is one of ``KINDS``."""

    def __init__(self):
        self.open, self.document, self.bag, self.made, self.error, self.posts = False, None, None, Counter(), None, -1

    def begin(self, document: str | None, kind: str) -> None:
        self.open, self.document, self.bag, self.made, self.error, self.posts = True, document, None, Counter(), None, -1
        if kind in KINDS:
            self.bag = KINDS[kind]()
        else:
            self.error = said(ValueError(f"no bag {kind!r}: {sorted(KINDS)}"))

    def end(self, rows: tuple[list, list, list, list]) -> None:
        """Add the rows of the document that has been seen."""
        if not self.open:
            return
        if not self.error:
            try:
                self.made.update(self.bag.rest())
            except ValueError as e:
                self.error = said(e)
        if self.error:
            found = [self.document], [None], [None], [self.error]
        else:
            n = len(self.made)
            found = [self.document] * n, [self.bag.namespace + t for t in self.made], list(map(float, self.made.values())), [None] * n
        for column, more in zip(rows, found):
            column += more

    def eval(self, kind: pa.Array, nodes: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, rows = nodes.num_rows, ([], [], [], [])
        if not n:
            return
        kind, documents = kind[0].as_py(), values(nodes.column("document"))
        coded = nodes.column("document").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins = [0, *(np.flatnonzero(coded[1:] != coded[:-1]) + 1).tolist()]
        post, missing = nodes.column("post").fill_null(-1).to_numpy(zero_copy_only=False), np.zeros(n, bool)
        for name in ("node_id", "internal_type", "post"):
            missing |= nodes.column(name).is_null().to_numpy(zero_copy_only=False)
        again = np.concatenate([[False], (post[1:] == post[:-1]) & (coded[1:] == coded[:-1])])
        goes_on = self.open and documents[0] == self.document
        again[0] = goes_on and post[0] == self.posts
        wrong = np.flatnonzero(missing | again)
        read = KINDS[kind].read(nodes) if kind in KINDS else None
        for k, (first, behind) in enumerate(zip(begins, [*begins[1:], n])):
            if k or not goes_on:
                self.end(rows)
                self.begin(documents[first], kind)
            if self.error:
                continue
            at = np.searchsorted(wrong, first) if len(wrong) else 0
            if at < len(wrong) and wrong[at] < behind:
                self.error = said(ValueError("a node without number, place or type" if missing[wrong[at]] else f"two nodes at place {post[wrong[at]]}"))
            else:
                self.made.update(self.bag.see(read, first, behind))
        self.posts = post[-1]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, BAG_SCHEMA)], schema=BAG_SCHEMA)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        rows = [], [], [], []
        self.end(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, BAG_SCHEMA)], schema=BAG_SCHEMA)


FUNCTIONS = {"parse_python": ParsePython, "parse_html": ParseHtml, "tree_bag": TreeBag}


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def with_words(nodes: DataFrame, split: Split) -> DataFrame:
    """Nodes as ``tree_bag`` reads them, with the words of identifiers."""
    return nodes.withColumn("words", F.when(has_roles("IDENTIFIER") & (F.coalesce("token", F.lit("")) != ""), split(F.col("token"))))


def sql_bag(nodes: DataFrame, kind: str) -> DataFrame:
    """(document, token, value, error) of nodes with words, through SQL."""
    spark = nodes.sparkSession
    register(spark)
    view = "lodestone_nodes"
    columns = ["document", "node_id", "post", "internal_type", *READ.get(kind, ())]
    nodes.select(*columns).createOrReplaceTempView(view)
    # the window lays documents one after the other, and deals them only if they are not dealt by document
    ordered = f"SELECT {', '.join(columns)}, row_number() OVER (PARTITION BY document ORDER BY post) AS at FROM {view}"
    return spark.sql(f"SELECT * FROM tree_bag('{kind}', TABLE({ordered}))")
