"""Trees as flat ``nodes`` tables: parsers as table functions, and trees that tables already hold."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..columns import NODES
from ..session import portions, ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree:
    """Collects nodes in the order they are opened and closed."""

    def __init__(self, document: str):
        self.document, self.rows, self.stack, self.closed = document, [], [], 0

    def open(self, kind: str, token: str | None, roles: list[str], line: int | None, col: int | None) -> None:
        parent = self.stack[-1] if self.stack else None
        self.rows.append([self.document, len(self.rows), parent, len(self.rows), None, kind, token, roles, line, col, list(self.stack)])
        self.stack.append(len(self.rows) - 1)

    def close(self) -> None:
        self.rows[self.stack.pop()][4] = self.closed
        self.closed += 1

    def leaf(self, *args) -> None:
        self.open(*args)
        self.close()

    def done(self) -> list[list]:
        while self.stack:
            self.close()
        return self.rows


def python_tree(document: str, source: str) -> list[list]:
    """Nodes of Python source; a syntax error gives none."""
    try:
        return python_nodes(document, source)
    except (SyntaxError, ValueError, RecursionError):
        return []


def python_nodes(document: str, source: str) -> list[list]:
    """Nodes of Python source; a syntax error fails, as does what is nested too deeply."""
    root = ast.parse(source)
    tree = Tree(document)

    def name(token: str, node: ast.AST, *roles: str) -> None:
        tree.leaf("Name", token, ["IDENTIFIER", *roles], getattr(node, "lineno", None), getattr(node, "col_offset", None))

    def visit(node: ast.AST) -> None:
        line, col = getattr(node, "lineno", None), getattr(node, "col_offset", None)
        kind = type(node).__name__
        if isinstance(node, ast.Name):
            tree.leaf(kind, node.id, ["EXPRESSION", "IDENTIFIER", *(["LEFT"] if isinstance(node.ctx, ast.Store) else [])], line, col)
            return
        if isinstance(node, ast.Constant):
            tree.leaf(kind, str(node.value), ["EXPRESSION", "LITERAL", "STRING" if isinstance(node.value, str) else "NUMBER"], line, col)
            return
        roles = {ast.FunctionDef: ["FUNCTION", "DECLARATION"], ast.AsyncFunctionDef: ["FUNCTION", "DECLARATION"], ast.ClassDef: ["TYPE", "DECLARATION"], ast.Call: ["EXPRESSION", "CALL"], ast.Assign: ["EXPRESSION", "ASSIGNMENT"], ast.BinOp: ["EXPRESSION", "BINARY", "OPERATOR"], ast.Module: ["FILE"]}
        tree.open(kind, None, roles.get(type(node), ["STATEMENT"] if isinstance(node, ast.stmt) else ["EXPRESSION"]), line, col)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name(node.name, node, "FUNCTION", "NAME")
        elif isinstance(node, ast.ClassDef):
            name(node.name, node, "TYPE", "NAME")
        elif isinstance(node, ast.arg):
            name(node.arg, node, "ARGUMENT", "NAME")
        elif isinstance(node, ast.Attribute):
            name(node.attr, node, "EXPRESSION", "QUALIFIED")
        elif isinstance(node, ast.alias):
            name(node.name, node, "IMPORT", "PATHNAME")
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)):
                visit(child)
        tree.close()

    visit(root)
    return tree.done()


class _Html(HTMLParser):
    def __init__(self, document: str):
        super().__init__()
        self.tree, self.names = Tree(document), []

    def handle_starttag(self, tag, attrs):
        line, col = self.getpos()
        self.tree.open(tag, tag, ["IDENTIFIER", "DECLARATION"], line, col)
        self.names.append(tag)
        for key, value in attrs:
            self.tree.leaf("@" + key, value or "", ["LITERAL"], line, col)
        if tag in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.names:
            while self.names:
                self.tree.close()
                if self.names.pop() == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            line, col = self.getpos()
            self.tree.leaf("#text", data.strip(), ["LITERAL", "STRING"], line, col)


def html_tree(document: str, source: str) -> list[list]:
    parser = _Html(document)
    parser.tree.open("#document", None, ["FILE"], 1, 0)
    parser.feed(source)
    parser.close()
    return parser.tree.done()


def parsed(files: DataFrame, document: str, content: str, parser) -> DataFrame:
    """Nodes of each row's content; rows without content or that do not parse have none."""
    schema = to_arrow_schema(NODES)
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [r for d, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if d is not None and c for r in parser(d, c)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return files.select(F.col(document).cast("string"), content).mapInArrow(run, NODES)


def unparsed(files: DataFrame, document: str, content: str, nodes: DataFrame) -> DataFrame:
    """(document): those with content of which ``nodes`` has none, since it does not parse."""
    there = nodes.select("document").distinct()
    full = files.where(F.length(content) > 0).select(F.col(document).cast("string").alias("document")).where("document is not null")
    return full.join(there, "document", "left_anti")


#: Lines that a partition of trees holds.
LINES_AT_ONCE = 100_000


def order_nodes(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A tree for each order: the order, its groups of lines by return flag, and the lines.

    A line number counts once. Orders are function declarations, groups operators and
    names, lines identifiers, or literals if they were not returned.

    Lines are dealt once, by document, to as many partitions as there are lines for, before anything is summed up, and gathered once; the nodes stay so
    dealt, and what is grouped by document and more needs no shuffle.
    """
    n = portions(lineitem, LINES_AT_ONCE)
    document = lambda key: F.concat(F.lit("o"), F.col(key).cast("string")).alias("document")
    dealt = lineitem.where("l_orderkey is not null").select(document("l_orderkey"), F.col("l_linenumber").alias("number"), "l_returnflag", "l_linestatus", "l_partkey").repartition(n, "document")
    # a document's lines lie in one array; of those with the same number the least flag, status and part count
    line = F.struct(F.col("l_returnflag").alias("flag"), "number", F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"))
    per = dealt.groupBy("document").agg(F.collect_list(line).alias("all"))
    numbers = F.array_distinct(F.col("all.number"))

    def least(number: Column) -> Column:
        same = F.filter("all", lambda x: x["number"].eqNullSafe(number))
        return F.struct(F.array_min(same["flag"]).alias("flag"), number.alias("number"), F.array_min(same["status"]).alias("status"), F.array_min(same["part"]).alias("part"))

    once = F.when(F.size(numbers) == F.size("all"), F.col("all")).otherwise(F.transform(numbers, least))
    per = per.select("document", F.sort_array(once).alias("lines"))
    o = orders.where("o_orderkey is not null").select(document("o_orderkey"), F.substring("o_orderpriority", 3, 20).alias("priority")).repartition(n, "document")
    flags = F.transform("lines", lambda x: F.struct(x["flag"].alias("flag")))
    trees = o.join(per, "document").withColumn("flags", flags).withColumn("groups", F.sort_array(F.array_distinct("flags")))
    # k is 0 for the order, then a group's number, then a line's behind the groups
    # i is a line's place in the order of flags and numbers, a group's first line, and the number of lines for the order itself; g a group's number, and how many there are
    long = lambda c: c.cast("long")
    rows = trees.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("groups") + F.size("lines"))))
    place = F.col("k") - 1 - F.size("groups")
    rows = rows.withColumn("kind", F.when(F.col("k") == 0, 0).when(place < 0, 1).otherwise(2)).withColumn("head", F.get("groups", F.col("k") - 1)).withColumn("x", F.get("lines", place))
    of_kind = lambda order, group, line: F.when(F.col("kind") == 0, order).when(F.col("kind") == 1, group).otherwise(line)
    end = F.size("flags") - F.array_position(F.reverse("flags"), F.col("head"))
    rows = rows.select(
        "document", "priority", "kind", of_kind(F.lit(None).cast("string"), F.col("head.flag"), F.col("x.flag")).alias("flag"), F.col("x.number").alias("number"), F.col("x.status").alias("status"),
        F.pmod("x.part", F.lit(7)).cast("string").alias("part"), of_kind(long(F.size("lines")), F.array_position("flags", F.col("head")) - 1, long(place)).alias("i"),
        of_kind(long(F.size("groups")), long(F.col("k")), F.array_position("groups", F.struct(F.col("x.flag").alias("flag")))).alias("g"), F.when(F.col("kind") == 1, long(end)).alias("end"),
    )
    by_kind = lambda order, group, line: F.when(F.col("kind") == 0, order).when(F.col("kind") == 1, group).otherwise(line)
    text = lambda *roles: F.array(*map(F.lit, roles))
    i, g, zero, none, as_int = F.col("i"), F.col("g"), F.lit(0).cast("long"), F.lit(None), lambda c: F.col(c).cast("int")
    odd = lambda value: F.when(F.col("number") % 2 == 1, value)
    flagged = lambda value: F.when(F.col("flag") != "A", value)
    columns = {
        "document": F.col("document"),
        "node_id": by_kind(zero, g, 100 + i),
        "parent_id": by_kind(none.cast("long"), zero, g),
        "pre": by_kind(zero, i + g, i + g + 1),
        "post": by_kind(i + g, F.col("end") + g, i + g - 1),
        "internal_type": by_kind(F.lit("Order"), F.concat(F.lit("Group"), "flag"), F.concat(F.lit("Line"), "status")),
        "token": by_kind(F.concat(F.lit("order"), F.replace(F.col("priority"), F.lit(" "), F.lit("_"))), F.concat(F.lit("group"), "flag", F.lit("Name")), F.concat(F.lit("line"), "flag", F.lit("Status"), "status", F.lit("part"), "part")),
        "roles": by_kind(text("FUNCTION", "DECLARATION"), F.when(F.col("flag") == "R", text("OPERATOR", "QUALIFIED")).otherwise(text("FUNCTION", "IDENTIFIER", "NAME")), F.when((F.col("flag") == "N") & (F.col("status") == "F"), text("LITERAL")).otherwise(text("EXPRESSION", "IDENTIFIER"))),
        "line": by_kind(F.lit(1), flagged(F.lit(2) + as_int("g")), odd(as_int("number") * 4)),
        "col": by_kind(F.lit(0), flagged(F.lit(1)), odd(as_int("number"))),
        "ancestors": by_kind(F.array().cast("array<long>"), F.array(zero), F.array(zero, g)),
    }
    return rows.select(*[c.alias(name) for name, c in columns.items()])
