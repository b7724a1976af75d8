"""Features of trees in the flat ``nodes`` table (see ``columns.NODES``).

What walks a tree elsewhere is a join here: on parent_id, or on one of the ancestors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walks
from ..session import ship, stored

Split = Callable[[Column], Column]
SEPARATOR = ">"


def with_namespace(bags: DataFrame, namespace: str, weight: float = 1.0) -> DataFrame:
    return bags.select(F.concat(F.lit(namespace), "token").alias("token"), "document", (F.col("value") * F.lit(weight)).cast("double").alias("value"))


def has_roles(*roles: str) -> Column:
    out = F.lit(True)
    for r in roles:
        out &= F.array_contains("roles", r)
    return out


def identifier_bag(nodes: DataFrame, split: Split, vocabulary: DataFrame | None = None) -> DataFrame:
    """Words of identifier nodes; an identifier with no token counts as the empty word."""
    words = nodes.where(has_roles("IDENTIFIER")).select("document", F.explode(F.when(F.coalesce("token", F.lit("")) == "", F.array(F.lit(""))).otherwise(split(F.col("token")))).alias("token"))
    if vocabulary is not None:
        words = words.join(vocabulary.select("token"), "token", "left_semi")
    return words.groupBy("token", "document").agg(F.count("*").alias("value"))


def literal_bag(nodes: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    return nodes.where(has_roles("LITERAL")).groupBy(hashed(F.coalesce("token", F.lit(""))).alias("token"), "document").agg(F.count("*").alias("value"))


def sequence_bag(nodes: DataFrame, lengths: tuple[int, ...] = (3, 4), stride: int = 1) -> DataFrame:
    """N-grams of node types in post-order, by ``lead`` within the document."""
    w = Window.partitionBy("document").orderBy("post")
    at = F.row_number().over(w) - 1
    most = max(lengths)
    placed = nodes.select("document", "internal_type", at.alias("at"), *[F.lead("internal_type", k).over(w).alias(f"n{k}") for k in range(1, most)])
    grams = [F.when(F.col(f"n{n - 1}").isNotNull() if n > 1 else F.lit(True), F.concat_ws(SEPARATOR, "internal_type", *[f"n{k}" for k in range(1, n)])) for n in lengths]
    starts = placed.where(F.col("at") % stride == 0)
    return starts.select("document", F.explode(F.array_compact(F.array(*grams))).alias("token")).groupBy("token", "document").agg(F.count("*").alias("value"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """(document, node_id, parent_id, internal_type, parent_type) of every node; the type is null where there is no such parent.

    Nodes meet their children under the parent's number in a window of the document, so nodes dealt by document are not dealt again.
    """
    own = F.struct(F.col("node_id").alias("at"), F.lit(0).alias("below"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), "internal_type")
    child = F.struct(F.col("parent_id").alias("at"), F.lit(1).alias("below"), "node_id", "parent_id", "internal_type")
    top = F.struct(F.lit(None).cast("long").alias("at"), F.lit(1).alias("below"), "node_id", "parent_id", "internal_type")
    met = nodes.select("document", F.explode(F.array(own, F.when(F.col("parent_id").isNull(), top).otherwise(child))).alias("x")).select("document", "x.*")
    above = F.first(F.when(F.col("below") == 0, F.col("internal_type"))).over(Window.partitionBy("document", "at").orderBy("below"))
    return met.withColumn("parent_type", F.when(F.col("at").isNotNull(), above)).where("below = 1").select("document", "node_id", "parent_id", "internal_type", "parent_type")


def with_families(nodes: DataFrame) -> DataFrame:
    """(document, node_id, internal_type, parent_id, parent_type, children): children (id, kind) by number."""
    known = with_parents(nodes)
    own = F.struct(F.col("node_id").alias("at"), F.struct("internal_type", "parent_id", "parent_type").alias("own"), F.lit(None).cast("struct<id:bigint,kind:string>").alias("child"))
    child = F.struct(F.col("parent_id").alias("at"), F.lit(None).cast("struct<internal_type:string,parent_id:bigint,parent_type:string>").alias("own"), F.struct(F.col("node_id").alias("id"), F.col("internal_type").alias("kind")).alias("child"))
    both = F.when(F.col("parent_id").isNull(), F.array(own)).otherwise(F.array(own, child))
    met = known.select("document", F.explode(both).alias("x")).select("document", "x.*")
    per = met.groupBy("document", F.col("at").alias("node_id")).agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("child")).alias("children"))
    return per.where("own is not null").select("document", "node_id", "own.*", "children")


def graphlet_bag(nodes: DataFrame) -> DataFrame:
    """parent's type, own type and the children's sorted types, joined by underscores."""
    kinds = F.array_sort(F.transform("children", lambda c: c["kind"]))
    key = F.concat_ws("_", F.coalesce("parent_type", F.lit("None")), "internal_type", kinds)
    return with_families(nodes).groupBy(key.alias("token"), "document").agg(F.count("*").alias("value"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """(document, internal_type, n_children) of every node."""
    own = F.struct(F.col("node_id").alias("at"), F.lit(True).alias("own"), "internal_type")
    child = F.struct(F.col("parent_id").alias("at"), F.lit(False).alias("own"), F.lit(None).cast("string").alias("internal_type"))
    both = F.when(F.col("parent_id").isNull(), F.array(own)).otherwise(F.array(own, child))
    met = nodes.select("document", F.explode(both).alias("x")).select("document", "x.*")
    n = F.count_if(~F.col("own")).over(Window.partitionBy("document", "at"))
    return met.withColumn("n_children", n).where("own").select("document", "internal_type", "n_children")


def quantization_levels(histogram: DataFrame, partitions: int) -> DataFrame:
    """(internal_type, levels) from (internal_type, n_children, freq).

    Greedy: a level ends where the frequencies since the last one exceed an even
    share; levels left over repeat the largest value, which always is the last level.
    """
    item = "struct<n:bigint,f:bigint>"
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("n_children").cast("long").alias("n"), F.col("freq").cast("long").alias("f")).cast(item)))
    per = histogram.groupBy("internal_type").agg(sorted_.alias("h"), F.sum("freq").alias("total"))
    cap = F.col("total") / F.lit(partitions)
    start = F.struct(F.array(F.get("h", F.lit(0))["n"]).alias("levels"), F.get("h", F.lit(0))["f"].alias("since"))

    def step(acc: Column, x: Column) -> Column:
        since = acc["since"] + x["f"]
        cut = since > cap
        room = F.size(acc["levels"]) < partitions + 1
        return F.struct(F.when(cut & room, F.concat(acc["levels"], F.array(x["n"]))).otherwise(acc["levels"]).alias("levels"), F.when(cut, x["f"]).otherwise(since).alias("since"))

    last = F.element_at("h", -1)["n"]
    made = F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), start, step, lambda acc: acc["levels"])
    full = F.when(F.size("made") < partitions + 1, F.concat("made", F.array_repeat(last, F.lit(partitions + 1) - F.size("made")))).otherwise(F.concat(F.slice("made", 1, partitions), F.array(last)))
    return per.withColumn("made", made).select("internal_type", full.alias("levels"))


def children_bag(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """type_level of every node; a type without levels fails."""
    return leveled(child_counts(nodes), levels).groupBy("token", "document").agg(F.count("*").alias("value"))


def leveled(counts: DataFrame, levels: DataFrame) -> DataFrame:
    """``counts`` of (internal_type, n_children) with the token of its level."""
    found = counts.join(F.broadcast(levels), "internal_type", "left")  # a row for each type
    known = F.coalesce("levels", F.raise_error(F.concat(F.lit("no levels for "), "internal_type")).cast("array<bigint>"))
    level = F.size(F.filter(known, lambda x: x <= F.col("n_children"))) - 1
    return found.withColumn("token", F.concat_ws("_", "internal_type", level.cast("string")))


#: Roles that do not tell what an identifier is for.
PLAIN_ROLES = ("EXPRESSION", "IDENTIFIER", "LEFT", "QUALIFIED", "BINARY", "ASSIGNMENT")


def role_pairs(nodes: DataFrame, order: list[str] | None = None, split: Split | None = None) -> DataFrame:
    """(document, token, roles) of identifiers with a token: their own roles or those of the nearest ancestor that says more.

    A node says more if it has a role besides ``PLAIN_ROLES`` and is no OPERATOR. An
    identifier without such an ancestor has null roles. ``order`` ranks role names (default: by name).
    ``split``: a row for each word of the identifier in place of the identifier.
    """
    ids = nodes.where(has_roles("IDENTIFIER") & (F.coalesce("token", F.lit("")) != ""))
    chain = F.concat(F.array("node_id"), F.reverse("ancestors"))
    steps = ids.select("document", F.col("node_id").alias("id_node"), "token", F.posexplode(chain).alias("distance", "node_id"))
    says = (F.size(F.array_except("roles", F.array(*map(F.lit, PLAIN_ROLES)))) > 0) & ~has_roles("OPERATOR")
    telling = nodes.where(says).select("document", "node_id", "roles")
    nearest = steps.join(telling, ["document", "node_id"]).groupBy("document", "id_node").agg(F.min_by("roles", "distance").alias("roles"))
    rank = F.array(*map(F.lit, order)) if order else None
    by = F.array_sort("roles") if rank is None else F.filter(rank, lambda r: F.array_contains("roles", r))
    found = ids.select("document", F.col("node_id").alias("id_node"), "token").join(nearest, ["document", "id_node"], "left")
    token = F.col("token") if split is None else F.explode(split(F.col("token")))
    return found.select("document", token.alias("token"), F.array_join(by, " | ").alias("roles"))


def points(nodes: DataFrame, split: Split) -> DataFrame:
    """(document, point, token, ancestors, line): a row for each word of an identifier, its line that of the nearest node with one."""
    words = placed(nodes, ["token", "ancestors"]).select("document", "node_id", "ancestors", "line", F.posexplode(split(F.col("token"))).alias("k", "token"))
    return words.select("document", F.struct("node_id", "k").alias("point"), "token", "ancestors", "line")


def placed(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """document, node_id, ``keep``, line and col of identifiers with a token: their own place or that of the nearest ancestor that has a line.

    Only identifiers without a line ask their ancestors, under whose numbers they meet them in a window of the document.
    """
    wanted = has_roles("IDENTIFIER") & (F.coalesce("token", F.lit("")) != "")
    fields = nodes.schema
    place_type = f"struct<line:{fields['line'].dataType.simpleString()},col:{fields['col'].dataType.simpleString()}>"
    payload = F.struct(*keep)
    kept_type = "struct<" + ",".join(f"{c}:{fields[c].dataType.simpleString()}" for c in keep) + ">"
    nothing, none = F.lit(None).cast(kept_type), F.array().cast(f"array<struct<at:bigint,of:bigint,distance:int,own:{kept_type},place:{place_type}>>")
    place = F.struct("line", "col")
    row = lambda at, of, distance, own, where: F.struct(at.alias("at"), of.alias("of"), distance.cast("int").alias("distance"), own.alias("own"), where.alias("place"))
    null_long, null_place = F.lit(None).cast("long"), F.lit(None).cast(place_type)
    gives = F.when(F.col("line").isNotNull(), F.array(row(F.col("node_id"), null_long, F.lit(-1), nothing, place))).otherwise(none)
    itself = F.array(row(null_long, F.col("node_id"), F.lit(0), payload, F.when(F.col("line").isNotNull(), place)))
    asks = F.transform(F.reverse("ancestors"), lambda a, k: row(a, F.col("node_id"), k + 1, nothing, null_place))
    asked = F.when(~wanted, none).when(F.col("line").isNotNull(), itself).otherwise(F.concat(itself, asks))
    met = nodes.select("document", F.explode(F.concat(gives, asked)).alias("x")).select("document", "x.*")
    there = F.first("place").over(Window.partitionBy("document", "at").orderBy("distance"))
    told = met.withColumn("place", F.when(F.col("at").isNull(), F.col("place")).otherwise(there)).where("of is not null")
    nearest = F.min_by("place", F.when(F.col("place").isNotNull(), F.col("distance"))).alias("place")
    per = told.groupBy("document", F.col("of").alias("node_id")).agg(F.first("own", ignorenulls=True).alias("own"), nearest)
    return per.select("document", "node_id", *[F.col("own")[c].alias(c) for c in keep], F.col("place.line").alias("line"), F.col("place.col").alias("col"))


def line_distances(nodes: DataFrame, split: Split, most: int = 10) -> DataFrame:
    """Pairs of different words of a document less than ``most`` lines apart.

    Points meet by equal bands of ``most`` lines, each in its own band and the next, so
    that a long document makes no more pairs than its lines hold.
    """
    p = stored(points(nodes, split).where("line is not null").withColumn("band", F.floor(F.col("line") / most)).drop("ancestors"), "points")
    both = p.withColumn("other", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    a, b = both.alias("a"), p.alias("b")
    on = (F.col("a.document") == F.col("b.document")) & (F.col("a.other") == F.col("b.band")) & (F.col("a.token") != F.col("b.token"))
    ahead = (F.col("a.band") < F.col("b.band")) | (F.col("a.point") < F.col("b.point"))
    gap = F.abs(F.col("a.line") - F.col("b.line")).cast("long")
    joined = a.join(b, on & ahead & (gap < most))
    return joined.select(F.col("a.document").alias("document"), F.greatest("a.token", "b.token").alias("first"), F.least("a.token", "b.token").alias("second"), gap.alias("distance"))


def near_identifiers(nodes: DataFrame, carried: Column, most: int) -> DataFrame:
    """(document, same, one, other, distance): pairs of identifiers of a document whose nodes are less than ``most`` steps apart, each with itself too.

    The steps are the lengths of both ancestor paths less twice the last index at which the
    paths were compared: where one path begins the other that is its last index, not its length.

    Identifiers meet under the ancestors that are near enough to lie on so short a way, in an array each: a pair has its
    deepest common ancestor before that index, and is made under this one alone. ``carried`` is what of an identifier is in the pair.
    """
    ids = nodes.where(has_roles("IDENTIFIER") & (F.coalesce("token", F.lit("")) != "")).select("document", "node_id", carried.alias("carried"), "ancestors", F.size("ancestors").alias("depth"))
    above = F.col("depth") - 2
    under = F.when(F.col("depth") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.least(F.greatest(F.col("depth") - most, F.lit(-1)), above), above))  # -1: no common ancestor
    met = ids.withColumn("under", F.explode(under))
    # the branch is the ancestor below the common one; an identifier is itself, or right under its branch, if its path ends there
    item = F.struct("node_id", "carried", "depth", F.get("ancestors", F.col("under") + 1).alias("branch"))
    groups = met.groupBy("document", "under", F.when(F.col("under") >= 0, F.get("ancestors", F.col("under"))).alias("ancestor")).agg(F.collect_list(item).alias("a"))
    pairs = groups.select("document", "under", F.explode("a").alias("one"), F.col("a").alias("others")).select("document", "under", "one", F.explode("others").alias("other"))
    ends = lambda at: (F.col("one.depth") == at) | (F.col("other.depth") == at)
    # a path that ends at the branch was compared up to it, whether the other is in it or not
    compared = ((F.col("under") == -1) & ends(F.lit(0))) | F.coalesce(F.col("one.branch") != F.col("other.branch"), F.lit(False)) | (F.col("one.branch").eqNullSafe(F.col("other.branch")) & ends(F.col("under") + 2))
    steps = (F.col("one.depth") + F.col("other.depth") - 2 * (F.col("under") + 1)).cast("long")
    found = pairs.where((F.col("one.node_id") <= F.col("other.node_id")) & (steps < most) & compared)
    return found.select("document", (F.col("one.node_id") == F.col("other.node_id")).alias("same"), F.col("one.carried").alias("one"), F.col("other.carried").alias("other"), steps.alias("distance"))


def word_pairs(pairs: DataFrame, *keep: str) -> DataFrame:
    """first, second and ``keep`` of the pairs of different words of two arrays, or of one if both are the ``same``."""
    words = pairs.select("*", F.posexplode("one").alias("i", "x")).select("*", F.posexplode("other").alias("j", "y"))
    apart = words.where((F.col("x") != F.col("y")) & (~F.col("same") | (F.col("i") < F.col("j"))))
    return apart.select(F.greatest("x", "y").alias("first"), F.least("x", "y").alias("second"), *keep)


def tree_distances(nodes: DataFrame, split: Split, most: int = 10) -> DataFrame:
    """Pairs of different words of a document whose nodes are less than ``most`` steps apart (see ``near_identifiers``)."""
    return word_pairs(near_identifiers(nodes, split(F.col("token")), most), "document", "distance").select("document", "first", "second", "distance")


def tree_distance_counts(nodes: DataFrame, split: Split, most: int = 10) -> DataFrame:
    """(first, second, distance, n): how often ``tree_distances`` has a pair.

    Pairs of identifiers are counted, and become pairs of words once for all that are alike.
    """
    ends = F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")
    n = near_identifiers(nodes, F.col("token"), most).groupBy("same", *ends, "distance").agg(F.count("*").alias("n"))
    split_up = n.select("same", split(F.col("one")).alias("one"), split(F.col("other")).alias("other"), "distance", "n")
    return word_pairs(split_up, "distance", "n").groupBy("first", "second", "distance").agg(F.sum("n").alias("n"))


def identifier_sequence(nodes: DataFrame, split: Split) -> DataFrame:
    """(document, sequence): words by line and column, equal places by a walk that takes the rightmost child first."""
    ids = placed(nodes, ["token", "post"])
    # the walk with the rightmost child first visits in the reverse order of ``post``
    item = F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"), (-F.col("post")).alias("walk"), split(F.col("token")).alias("words"))
    return ids.groupBy("document").agg(F.array_sort(F.collect_list(item)).alias("x")).select("document", F.array_join(F.flatten(F.transform("x", lambda s: s["words"])), " ").alias("sequence"))


def by_repository(nodes: DataFrame, repository: Column) -> DataFrame:
    """The trees of a repository as one document."""
    return nodes.withColumn("document", repository)


def outermost_functions(nodes: DataFrame) -> DataFrame:
    """(document, node_id, name, line): functions declared in no other function, with a name.

    The name is the tokens of all FUNCTION IDENTIFIER NAME nodes below, joined by +.
    """
    functions = nodes.where(has_roles("FUNCTION", "DECLARATION"))
    marks = functions.select("document", F.col("node_id").alias("outer"))
    nested = functions.select("document", "node_id", F.explode("ancestors").alias("outer")).join(marks, ["document", "outer"], "left_semi").select("document", "node_id")
    top = functions.join(nested, ["document", "node_id"], "left_anti")
    named = nodes.where(has_roles("FUNCTION", "IDENTIFIER", "NAME")).select("document", F.explode(F.concat(F.array("node_id"), "ancestors")).alias("function"), "pre", "token")
    names = named.groupBy("document", F.col("function").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "token"))), lambda s: s["token"]), "+").alias("name"))
    return top.join(names, ["document", "node_id"]).where("name <> ''").select("document", "node_id", "name", "line")


def by_function(nodes: DataFrame) -> DataFrame:
    """The nodes of each outermost function as a document of its own, ``document``_name:line."""
    f = outermost_functions(nodes).select("document", F.col("node_id").alias("function"), F.concat_ws("", "document", F.lit("_"), "name", F.lit(":"), F.col("line").cast("string")).alias("own"))
    below = nodes.withColumn("function", F.explode(F.concat(F.array("node_id"), "ancestors")))
    return below.join(f, ["document", "function"]).withColumn("document", F.col("own")).select(*nodes.columns)


def random_walk_bag(nodes: DataFrame, lengths: tuple[int, ...] = (2, 3), p: float = 0.79, q: float = 0.82, n_walks: int = 2, n_steps: int = 10, seed: int = 42, stride: int = 1) -> DataFrame:
    """N-grams of types over biased walks of ``n_steps`` nodes from every node of a document.

    A walk first goes to any neighbour; later it returns to the node before with weight 1/p against
    1/q for each child, and else goes to any neighbour; a node without neighbours is stayed on. What is drawn depends on the seed, the document, the walk and the step alone.

    Documents lie one after the other in the order of their nodes, and tasks take whole ones until they have some thousands of nodes, on which all walks take a step at a time.
    """
    ship(nodes.sparkSession)
    starts = F.row_number().over(Window.partitionBy("document").orderBy("node_id")) == 1
    rows = nodes.select("document", "node_id", "parent_id", "internal_type", starts.alias("starts"))
    rows = rows.select(F.when(F.col("starts"), F.col("document")).alias("document"), F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "internal_type", "starts")
    run = walks.bag(lengths=tuple(lengths), p=p, q=q, n_walks=n_walks, n_steps=n_steps, seed=seed, stride=stride, separator=SEPARATOR)
    return rows.mapInArrow(run, "token string, document string, value long")


def combined(*bags: DataFrame) -> DataFrame:
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out
