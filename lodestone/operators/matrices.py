"""Co-occurrence, bags as rows, and what embeddings and topic models need.

A matrix is a long table of its nonzero cells. Names are joined, positions never: so merging
tables with different vocabularies cannot shift a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contexts
from ..functions.scalars import namespace, vw_name
from ..functions.tokens import stemmed
from ..session import ship, stored
from .frequencies import indexed
from .trees import Split, has_roles

MOST = 2**31 - 1


#: Distinct words of a context that meet in one place; of contexts with more, blocks of so many.
WORDS_AT_ONCE = 1000


def cooccurrence(words: DataFrame, vocabulary: DataFrame | None = None, block: int = WORDS_AT_ONCE, context: tuple[str, ...] = ("context",)) -> DataFrame:
    """(row, col, weight) from (context, token): ordered pairs of words of a context, summed over contexts.

    A word that a context has n times and another that it has m times make n m pairs, a word with
    itself n (n - 1): so the distinct words of a context meet with counts, and no pair of occurrences is
    made one by one. With a vocabulary (token, token_id) words outside of it are dropped before
    they meet, and rows and columns are ids. ``context`` names the columns of a context: of words dealt by one of them those of light contexts stay where they are. A context of more than ``block`` distinct words is dealt into blocks of words, of
    which every two meet under a key of their own.
    """
    return counted_cooccurrence(words.groupBy(*context, "token").agg(F.count("*").alias("n")), vocabulary, block, context)


def counted_cooccurrence(n: DataFrame, vocabulary: DataFrame | None = None, block: int = WORDS_AT_ONCE, context: tuple[str, ...] = ("context",), times: Column | int = 1) -> DataFrame:
    """``cooccurrence`` from the distinct words of contexts (context, token, n). ``times``, one of the columns of a context: how many contexts are just like it."""
    times = F.lit(times) if isinstance(times, int) else times
    if vocabulary is not None:
        n = n.join(vocabulary.select("token", "token_id"), "token").select(*context, F.col("token_id").alias("token"), "n")
    known = n.where(" and ".join(f"`{c}` is not null" for c in context))
    counted = known.withColumn("words", F.count("*").over(Window.partitionBy(*context)))
    item = F.struct("token", "n")
    light = counted.where(F.col("words") <= block).groupBy(*context).agg(F.collect_list(item).alias("one")).select("one", F.col("one").alias("other"), times.alias("times"))
    # a word of a heavy context is a row of the one and of the other side of each pair of blocks
    heavy = counted.where(F.col("words") > block).select(F.struct(*context).alias("context"), times.alias("times"), "token", "n", F.pmod(F.xxhash64("token"), F.ceil(F.col("words") / block)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / block).cast("int") - 1)).alias("to"))
    sides = F.array(F.struct(F.col("own").alias("first"), F.col("to").alias("second"), item.alias("one"), F.lit(None).alias("other")), F.struct(F.col("to").alias("first"), F.col("own").alias("second"), F.lit(None).alias("one"), item.alias("other")))
    keys = heavy.select("context", "times", F.explode(sides).alias("s")).select("context", "times", "s.*").repartition("context", "first", "second")
    blocks = keys.groupBy("context", "first", "second").agg(F.collect_list("one").alias("one"), F.collect_list("other").alias("other"), F.first("times").alias("times")).select("one", "other", "times")
    pairs = light.unionByName(blocks).select("times", F.explode("one").alias("a"), "other").select("times", "a", F.explode("other").alias("b"))
    weight = F.col("times") * F.col("a.n") * (F.col("b.n") - (F.col("a.token") == F.col("b.token")).cast("long"))
    return pairs.groupBy(F.col("a.token").alias("row"), F.col("b.token").alias("col")).agg(F.sum(weight).alias("weight")).where("weight > 0")


def dealt(n: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (context, token, n) as the one and as the other side of pairs, for every two blocks (first, second) of a context."""
    heavy = n.groupBy("context").agg(F.count("*").alias("words")).where(F.col("words") > block)
    blocks = F.coalesce(F.ceil(F.col("words") / block), F.lit(1)).cast("int")
    rows = n.join(heavy, "context", "left").select("context", "token", "n", F.pmod(F.xxhash64("token"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    left = rows.select("context", F.col("own").alias("first"), F.col("other").alias("second"), "token", "n")
    return left, rows.select("context", F.col("other").alias("first"), F.col("own").alias("second"), "token", "n")


def tree_contexts(nodes: DataFrame, split: Split) -> DataFrame:
    """(document, at, token): words of identifiers in their own context (the node ``at``) and in that of the nearest identifier above, else the root.

    Identifiers meet those that ask for them in a window of the document, and nothing is dealt again.
    """
    ids = nodes.where(has_roles("IDENTIFIER")).select("document", "node_id", "ancestors", split(F.coalesce("token", F.lit(""))).alias("words"))
    null, no_words = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    row = lambda up, of, distance, words, root: F.struct(up.alias("up"), of.alias("of"), distance.cast("int").alias("distance"), words.alias("words"), root.alias("root"))
    mark = F.array(row(F.col("node_id"), null, F.lit(-1), no_words, null))
    own = F.array(row(null, F.col("node_id"), F.lit(0), F.col("words"), F.get("ancestors", F.lit(0))))
    asks = F.transform(F.reverse("ancestors"), lambda a, k: row(a, F.col("node_id"), k + 1, no_words, null))
    met = ids.select("document", F.explode(F.concat(mark, own, asks)).alias("x")).select("document", "x.*")
    there = F.min("distance").over(Window.partitionBy("document", "up")) == -1
    told = met.withColumn("near", F.when(F.col("up").isNotNull() & there, F.col("up"))).where("of is not null")
    nearest = F.min_by("near", F.when(F.col("near").isNotNull(), F.col("distance"))).alias("near")
    found = told.groupBy("document", F.col("of").alias("node_id")).agg(F.first("words", ignorenulls=True).alias("words"), F.max("root").alias("root"), nearest)
    contexts = F.array_distinct(F.array_compact(F.array("node_id", F.coalesce("near", "root"))))
    return found.select("document", F.explode(contexts).alias("at"), "words").select("document", "at", F.explode("words").alias("token"))


class Contexts:
    """The contexts of ``tree_contexts`` as those that have the same identifiers, and how many there are of each; likewise the documents.

    Documents lie one after the other, and tasks take whole ones; what is alike is counted there and then summed up, stored once, and each
    distinct identifier is split once (and its words stemmed, with ``above``).
    """

    def __init__(self, nodes: DataFrame, split: Split, above: int | None = None):
        ship(nodes.sparkSession)
        ids = nodes.where(has_roles("IDENTIFIER") & F.col("document").isNotNull())
        starts = F.row_number().over(Window.partitionBy("document").orderBy("node_id")) == 1
        rows = ids.select("document", F.col("node_id").cast("long").alias("node_id"), F.col("ancestors").cast("array<long>").alias("ancestors"), "token").select(starts.alias("starts"), "node_id", "ancestors", "token")
        found = rows.mapInArrow(contexts.counted, "whole boolean, tokens array<string>, n long").groupBy("whole", "tokens").agg(F.sum("n").alias("times"))
        self.alike = stored(found.withColumn("context", F.monotonically_increasing_id()), "alike")
        names = self.alike.select(F.explode("tokens").alias("identifier")).distinct().select("identifier", F.explode(split(F.col("identifier"))).alias("token"))
        names = names if above is None else stemmed(names, "token", above)
        self.names = stored(names.groupBy("identifier", "token").agg(F.count("*").alias("n")), "names")  # so that they are broadcast if they are few

    def words(self, whole: bool) -> DataFrame:
        """(context, times, token, n): the distinct words of distinct contexts, or of distinct documents."""
        of = self.alike.where(F.col("whole") == whole).select("context", "times", F.explode("tokens").alias("identifier")).join(self.names, "identifier")
        return of.groupBy("context", "times", "token").agg(F.sum("n").alias("n"))

    def document_frequency(self) -> DataFrame:
        """(token, freq): as ``identifier_bag`` has them, where an identifier without a token is the empty word."""
        empty = self.alike.where(F.col("whole") & F.array_contains("tokens", "")).agg(F.sum("times").alias("freq")).where("freq is not null")
        return self.words(True).where("token <> ''").groupBy("token").agg(F.sum("times").alias("freq")).unionByName(empty.select(F.lit("").alias("token"), "freq"))

    def cooccurrence(self, vocabulary: DataFrame | None = None, block: int = WORDS_AT_ONCE) -> DataFrame:
        return counted_cooccurrence(stored(self.words(False), "context-words"), vocabulary, block, context=("context", "times"), times=F.col("times"))


def merged_cooccurrences(parts: list[DataFrame], vocabulary: DataFrame | None = None) -> DataFrame:
    """Sum of tables (row, col, weight) by token, at most ``MOST``; a table with a negative weight is left out."""
    total = None
    for part in parts:
        bad = part.agg(F.coalesce(F.min("weight"), F.lit(0)).alias("least")).where("least < 0")
        good = part.join(bad, F.lit(True), "left_anti").withColumn("weight", F.least("weight", F.lit(MOST)))
        total = good if total is None else total.unionByName(good)
    if vocabulary is not None:
        tokens = vocabulary.select("token")
        total = total.join(tokens.withColumnRenamed("token", "row"), "row", "left_semi").join(tokens.withColumnRenamed("token", "col"), "col", "left_semi")
    return total.groupBy("row", "col").agg(F.least(F.sum("weight"), F.lit(MOST)).alias("weight"))


def bow_rows(bags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(document, tokens, values): a document's token ids in order, with their values."""
    return rows_of_cells(bags.join(vocabulary.select("token", "token_id"), "token"))


def rows_of_cells(cells: DataFrame) -> DataFrame:
    """``bow_rows`` of cells (document, token_id, value)."""
    row = cells.select("document", F.struct("token_id", "value").alias("cell")).groupBy("document").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return row.select("document", F.transform("cells", lambda c: c["token_id"]).alias("tokens"), F.transform("cells", lambda c: c["value"]).alias("values"))


def bow_lines(bags: DataFrame) -> DataFrame:
    """(line): name token:weight ... with the tokens in order."""
    cell = F.struct("token", F.concat_ws(":", "token", F.col("value").cast("string")).alias("text"))
    row = bags.groupBy("document").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return row.select(F.concat_ws(" ", vw_name(F.col("document")), F.array_join(F.transform("cells", lambda c: c["text"]), " ")).alias("line"))


def merged_bows(parts: list[DataFrame], features: list[str] | None = None) -> DataFrame:
    """Rows of several bags; with ``features`` only tokens of those namespaces (with or without the dot)."""
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    if features is None:
        return total
    return total.where(namespace(F.col("token")).isin(*[f.rstrip(".") for f in features]))


def average_bag(bags: DataFrame) -> DataFrame:
    return bags.groupBy("document").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_tokens"))


def write_bows(rows: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    rows.write.option("maxRecordsPerFile", per_file).parquet(path)


def shard_places(cooc: DataFrame, vocabulary: DataFrame, n_shards: int) -> DataFrame:
    """(token, sums, shard, place): the cells of each row, its shard by falling number of cells (ties by token), its place in it."""
    sums = cooc.groupBy(F.col("row").alias("token")).agg(F.count("*").alias("sums"))
    all_ = vocabulary.select("token").join(sums, "token", "left").select("token", F.coalesce("sums", F.lit(0)).alias("sums"))
    order = all_.select(F.struct((-F.col("sums")).alias("falling"), "token").alias("place")).where("place.token is not null")
    ranked = indexed(order, "place", "rank")
    shard = F.pmod("rank", F.lit(n_shards)).cast("int").alias("shard")
    return ranked.select("place.token", (-F.col("place.falling")).alias("sums"), shard, F.expr(f"rank div {n_shards}").alias("place"))


def shards(cooc: DataFrame, vocabulary: DataFrame, n_shards: int) -> DataFrame:
    """(token, sums, shard) of ``shard_places``."""
    return shard_places(cooc, vocabulary, n_shards).select("token", "sums", "shard")


def pmi_targets(cooc: DataFrame) -> DataFrame:
    """(row, col, target, confidence): what an embedding is fitted to in each cell.

    ln(count) - ln(row sum + 1) - ln(column sum + 1) + ln(sum + 1), sums in cells and not in
    weights; an error counts 0.1 + 0.25 count^0.5.
    """
    rows = cooc.groupBy("row").agg(F.count("*").alias("row_sum"))
    cols = cooc.groupBy("col").agg(F.count("*").alias("col_sum"))
    total = rows.agg(F.sum("row_sum").alias("total"))
    cells = cooc.join(rows, "row").join(cols, "col").join(F.broadcast(total))  # one row
    target = F.log("weight") - F.log(F.col("row_sum") + 1) - F.log(F.col("col_sum") + 1) + F.log(F.col("total") + 1)
    return cells.select("row", "col", target.alias("target"), (0.1 + 0.25 * F.sqrt("weight")).alias("confidence"))


def factorized(targets: DataFrame, rank: int = 50, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(token, embedding): averaged row and column factors of the targets, by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    tokens = targets.select(F.col("row").alias("token")).union(targets.select("col")).distinct()
    ids = indexed(tokens).withColumn("token_id", F.col("token_id").cast("int"))
    r = ids.select(F.col("token").alias("row"), F.col("token_id").alias("user"))
    c = ids.select(F.col("token").alias("col"), F.col("token_id").alias("item"))
    cells = targets.join(r, "row").join(c, "col").select("user", "item", F.col("target").cast("float").alias("target")).persist()
    model = ALS(rank=rank, maxIter=rounds, regParam=0.1, seed=seed, ratingCol="target").fit(cells)
    cells.unpersist()
    both = model.userFactors.withColumnRenamed("features", "u").join(model.itemFactors.withColumnRenamed("features", "i"), "id")
    return both.join(ids, both["id"] == ids["token_id"]).select("token", averaged(F.col("u"), F.col("i")).alias("embedding"))


def averaged(row: Column, col: Column) -> Column:
    return F.zip_with(row, col, lambda a, b: (a + b) / 2)


def embeddings_of(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(token, embedding) from row and column vectors (token, embedding), joined by name; long names are cut."""
    both = rows.join(cols.withColumnRenamed("embedding", "__col"), "token")
    return both.select(F.substring("token", 1, 256).alias("token"), averaged(F.col("embedding"), F.col("__col")).alias("embedding"))


def projected(embeddings: DataFrame, frequencies: DataFrame | None = None, most: int = 10_000, seed: int = 777) -> DataFrame:
    """The tokens to show with their vectors and, if there are frequencies, those.

    No more than ``most`` are all shown, with the frequency 0 where there is none. Of more the most frequent, of equal ones the last by name;
    without frequencies some that the seed and the names alone decide.
    """
    few = embeddings.limit(most + 1).count() <= most
    if frequencies is None:
        return embeddings if few else embeddings.orderBy(F.xxhash64(F.lit(seed), "token"), "token").limit(most)
    if few:
        return embeddings.join(frequencies, "token", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return embeddings.join(frequencies, "token").orderBy(F.desc("freq"), F.desc("token")).limit(most)


def write_projector(chosen: DataFrame, path: str) -> None:
    """Tab-separated names, with frequencies if there are any, and vectors."""
    chosen.select("token", *[c for c in chosen.columns if c == "freq"]).coalesce(1).write.mode("overwrite").csv(f"{path}/meta", sep="\t")
    chosen.select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), "\t").alias("v")).coalesce(1).write.mode("overwrite").text(f"{path}/data")


def topic_tokens(topics: DataFrame, most: int | None = None) -> DataFrame:
    """(topic, place, token, weight): tokens with a weight by falling weight, then id."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), F.asc("token_id")))
    out = topics.where("weight <> 0").withColumn("place", place)
    return (out if most is None else out.where(F.col("place") <= most)).select("topic", "place", "token", "weight")


def labelled_topics(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """Topics with names (topic, label); a topic without a name fails."""
    return topics.join(labels, "topic", "left").withColumn("label", F.coalesce("label", F.raise_error(F.lit("a topic has no label")).cast("string")))


def read_topic_text(spark: SparkSession, path: str) -> DataFrame:
    """(topic, token, weight) from a semicolon-separated table with a row for each token."""
    wide = spark.read.csv(path, sep=";", header=True)
    token, *topics = wide.columns
    long = wide.unpivot([token], topics, "topic", "text").where("text <> '0'")
    return long.select("topic", F.col(token).alias("token"), F.col("text").cast("double").alias("weight"))


def lda_topics(rows: DataFrame, size: int, topics: int = 10, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(topic, token_id, weight) of a topic model over (document, tokens, values)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def vector(tokens, values):  # sparse vectors have no builder among the functions
        return SparseVector(size, tokens, values)

    model = LDA(k=topics, maxIter=rounds, seed=seed, optimizer="online").fit(rows.select(vector("tokens", F.col("values").cast("array<double>")).alias("features")))
    return model.describeTopics(size).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("topic", F.col("t.termIndices").alias("token_id"), F.col("t.termWeights").alias("weight"))


def swivel_loss(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """(loss): the weighted squared error over nonzero cells of vectors (token, embedding)."""
    r, c = vectors.select(F.col("token").alias("row"), F.col("embedding").alias("r")), vectors.select(F.col("token").alias("col"), F.col("embedding").alias("c"))
    dot = F.aggregate(F.zip_with("r", "c", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    error = dot - F.col("target")
    return targets.join(r, "row").join(c, "col").agg(F.avg(0.5 * F.col("confidence") * error * error).alias("loss"))
