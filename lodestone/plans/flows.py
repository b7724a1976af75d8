"""The flows behind the commands: from files to bags, vocabularies, matrices and tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import features, lexers, tokens
from ..functions.scalars import document_name
from ..operators import frequencies, matrices, trees
from ..operators.relational import non_empty
from ..session import ship, stored

WORD = "[A-Za-z]+"
#: Bag makers by name: (namespace, nodes to bag).
EXTRACTORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def register_extractor(name: str, namespace: str):
    """Add a bag maker to the registry."""

    def add(make: Callable[[DataFrame], DataFrame]):
        if not callable(make):
            raise TypeError(f"{name} is not a function")
        EXTRACTORS[name] = (namespace, make)
        return make

    return add


@register_extractor("id", "i.")
def _identifiers(nodes: DataFrame, stem_above: int = tokens.STEM_ABOVE, least_length: int = tokens.LEAST_SPLIT, most_length: int = tokens.MOST_LENGTH) -> DataFrame:
    if stem_above < 1:
        raise ValueError("the length above which words are stemmed is at least 1")
    return stemmed_bag(trees.identifier_bag(nodes, lambda t: tokens.split_identifier(t, least=least_length, most=most_length)), stem_above)


def stemmed_bag(bag: DataFrame, above: int = tokens.STEM_ABOVE) -> DataFrame:
    """A bag (token, document, value) of stems: each distinct word is stemmed once, and equal stems are summed."""
    return tokens.stemmed(bag, "token", above).groupBy("token", "document").agg(F.sum("value").alias("value"))


register_extractor("lit", "l.")(lambda nodes: trees.literal_bag(nodes, tokens.hashed_token))
register_extractor("uast2seq", "s.")(trees.sequence_bag)
register_extractor("node2vec", "r.")(trees.random_walk_bag)
register_extractor("graphlet", "g.")(trees.graphlet_bag)


@register_extractor("children", "c.")
def _children(nodes: DataFrame, partitions: int = 20, levels: DataFrame | None = None) -> DataFrame:
    return trees.children_bag(nodes, levels_of(nodes, partitions) if levels is None else levels)


def levels_of(nodes: DataFrame, partitions: int = 20) -> DataFrame:
    """(internal_type, levels): how many children a node has, cut into levels of like frequency."""
    histogram = trees.child_counts(nodes).groupBy("internal_type", "n_children").agg(F.count("*").alias("freq"))
    return trees.quantization_levels(histogram, partitions)


class Features:
    """Bags of identifiers, graphlets and children from one walk through the trees.

    Documents lie one after the other, and tasks take whole ones; what a document has is counted there and stored once, for all documents
    that have the same. Bags are of one document of those alike, which a digest of 128 bits stands for: ``documents`` has (document, alike), ``counts`` (alike, times, has).
    Each distinct identifier is split once and its words stemmed, and levels come from the counts.
    """

    def __init__(self, nodes: DataFrame):
        ship(nodes.sparkSession)
        starts = F.row_number().over(Window.partitionBy("document").orderBy("node_id")) == 1
        long = lambda c: F.col(c).cast("long").alias(c)
        identifier = F.coalesce(trees.has_roles("IDENTIFIER"), F.lit(False))
        rows = nodes.select("document", long("node_id"), long("parent_id"), "internal_type", F.when(identifier, F.col("token")).alias("token"), identifier.alias("identifier")).withColumn("starts", starts)
        rows = rows.withColumn("document", F.when(F.col("starts"), F.col("document")))
        has = "array<struct<kind:string,token:string,n_children:bigint,n:bigint>>"
        found = stored(rows.mapInArrow(features.of_documents, f"document string, alike string, has {has}"), "features")
        self.documents = found.select("document", "alike")
        self.counts = stored(found.groupBy("alike").agg(F.first("has", ignorenulls=True).alias("has"), F.count("document").alias("times")), "alike")

    def of(self, kind: str) -> DataFrame:
        """(document, times, token, n_children, n), where a document stands for all that are alike."""
        return self.counts.select(F.col("alike").alias("document"), "times", F.explode(F.filter("has", lambda x: x["kind"] == kind)).alias("x")).select("document", "times", "x.token", "x.n_children", "x.n")

    def id(self, stem_above: int = tokens.STEM_ABOVE, least_length: int = tokens.LEAST_SPLIT, most_length: int = tokens.MOST_LENGTH) -> DataFrame:
        if stem_above < 1:
            raise ValueError("the length above which words are stemmed is at least 1")
        words = F.when(F.col("identifier") == "", F.array(F.lit(""))).otherwise(tokens.split_identifier(F.col("identifier"), least=least_length, most=most_length))
        names = tokens.stemmed(self.of("id").select(F.col("token").alias("identifier")).distinct().select("identifier", F.explode(words).alias("word")), "word", stem_above)
        names = stored(names.groupBy("identifier", "word").agg(F.count("*").alias("m")), "names")  # so that they are broadcast if they are few
        return self.of("id").join(names, F.col("token") == F.col("identifier")).select(F.col("word").alias("token"), "document", (F.col("n") * F.col("m")).alias("value"))

    def graphlet(self) -> DataFrame:
        return self.of("graphlet").select("token", "document", F.col("n").alias("value"))

    def children(self, partitions: int = 20, levels: DataFrame | None = None) -> DataFrame:
        found = self.of("children").withColumnRenamed("token", "internal_type")
        if levels is None:
            levels = stored(trees.quantization_levels(found.groupBy("internal_type", "n_children").agg(F.sum(F.col("n") * F.col("times")).alias("freq")), partitions), "levels")
        return trees.leveled(found, levels).select("token", "document", F.col("n").alias("value"))

    def bags(self, extractors: list[str], **options: dict) -> DataFrame:
        """(token, document, value) with namespaces."""
        return trees.combined(*[trees.with_namespace(getattr(self, e)(**options.get(e, {})), EXTRACTORS[e][0]) for e in extractors])


def options_of(extractor: str) -> dict[str, int | float | str]:
    """The options of an extractor that a command line can give, with their defaults."""
    own = inspect.signature(EXTRACTORS[extractor][1]).parameters
    return {n: p.default for n, p in own.items() if type(p.default) in (int, float, str)}


def bags_of(nodes: DataFrame, extractors: list[str], weights: dict[str, float] | None = None, options: dict[str, dict] | None = None, least: int = 1) -> DataFrame:
    """Bags of several extractors, each with its weight and options, of tokens that ``least`` documents have."""
    unknown = set(extractors) - set(EXTRACTORS)
    if unknown:
        raise ValueError(f"no such extractors: {sorted(unknown)}")
    if least < 1:
        raise ValueError("a document frequency is at least 1")
    made = {e: EXTRACTORS[e][1](nodes, **(options or {}).get(e, {})) for e in extractors}
    bags = trees.combined(*[trees.with_namespace(bag, EXTRACTORS[e][0], (weights or {}).get(e, 1.0)) for e, bag in made.items()])
    if least == 1:
        return bags
    bags = stored(bags, "bags")
    once = len({EXTRACTORS[e][0] for e in made}) == len(made)  # a bag has a token of a document once, and no two bags share a namespace
    df = bags.groupBy("token").agg(F.count("document").alias("freq")) if once else frequencies.document_frequency(bags)
    often = stored(frequencies.pruned(df, least).select("token"), "often")  # so that they are broadcast if they are few
    return bags.join(often, "token", "left_semi").select(*bags.columns)


def saved_vocabulary(spark: SparkSession, path: str | None, bags: DataFrame | None = None, save_to: str | None = None, least: int = 1, size: int | None = None) -> tuple[DataFrame, dict]:
    """The vocabulary (token, freq, token_id) at ``path``, or that of ``bags``, which is saved; and its facts."""
    if path:
        return models.load(spark, path, "docfreq")
    if bags is None or not save_to:
        raise ValueError("without a saved vocabulary, bags and a place to save theirs are needed")
    models.save(vocabulary(bags, least, size), save_to, "docfreq", docs=frequencies.n_documents(bags).first()[0])
    return models.load(spark, save_to, "docfreq")


def saved_levels(spark: SparkSession, path: str, nodes: DataFrame | None = None, partitions: int = 20) -> DataFrame:
    """The quantization levels at ``path``; if there are none, those of ``nodes``, which are saved there."""
    if not models.exists(spark, path):
        if nodes is None:
            raise ValueError(f"no levels at {path}, and no trees to make them from")
        models.save(levels_of(nodes, partitions), path, "quant")
    return models.load(spark, path, "quant")[0]


def word_identifiers(files: DataFrame) -> DataFrame:
    """(token, repository_id, path) of every word in the files' content."""
    path = F.concat_ws("/", "repository_id", "path")
    return non_empty(files).select(F.explode(F.regexp_extract_all("content", F.lit(WORD), F.lit(0))).alias("token"), "repository_id", path.alias("path"))


def source_identifiers(files: DataFrame, split: bool = False) -> DataFrame:
    """(token, repository_id, path) of every name in the files' code; ``split``: only names of several words."""
    path = F.concat_ws("/", "repository_id", "path")
    names = non_empty(files).select(F.explode(lexers.names_in(F.col("content"), F.col("lang"))).alias("token"), "repository_id", path.alias("path"))
    return names.where(F.size(tokens.split_identifier(F.col("token"), least=1)) > 1) if split else names


def word_bags(files: DataFrame) -> DataFrame:
    """(token, document, value) of the words of each file, one row a word and file."""
    document = document_name(F.col("repository_id"), F.col("path"), F.lit(""))
    words = non_empty(files).select(F.explode(F.regexp_extract_all("content", F.lit(WORD), F.lit(0))).alias("token"), document.alias("document"))
    return words.groupBy("token", "document").agg(F.count("*").alias("value"))


def vocabulary(bags: DataFrame, least: int = 1, size: int | None = None) -> DataFrame:
    df = frequencies.pruned(frequencies.document_frequency(bags), least)
    return frequencies.ordered(df if size is None else frequencies.greatest(df, size))


def repos2bow(bags: DataFrame, least: int = 1, size: int | None = None, cache_hook=None, save_hook=None, words: DataFrame | None = None, found: Features | None = None) -> DataFrame:
    """TF-IDF rows (document, tokens, values) of bags, over their own vocabulary or a saved one (``words``).

    ``cache_hook`` sees the term frequencies (and may persist them), ``save_hook`` the weighted bags. With ``found`` the documents of
    the bags stand for all that are alike: these count in frequencies, and get the rows at the end.
    """
    tf = stored(frequencies.term_frequency(bags), "tf")  # read three times, made once
    if cache_hook:
        cache_hook(tf)
    times = None if found is None else found.counts.select(F.col("alike").alias("document"), "times")
    if words is None:
        # a term frequency has a token of a document once
        df = tf.groupBy("token").agg(F.count("document").alias("freq")) if times is None else tf.join(times, "document").groupBy("token").agg(F.sum("times").alias("freq"))
        df = frequencies.pruned(df, least)
        words = stored(frequencies.ordered(df if size is None else frequencies.greatest(df, size)), "words")  # so that it is broadcast if it is small
    n = frequencies.n_documents(tf) if times is None else times.join(tf, "document", "left_semi").agg(F.sum("times").alias("ndocs"))
    weighted = _weighted(tf, words, n, "token_id")
    if save_hook:
        save_hook(weighted.drop("token_id"))
    rows = matrices.rows_of_cells(weighted)
    if found is None:
        return rows
    rows = stored(rows.withColumnRenamed("document", "alike"), "rows")  # so that they are broadcast if they are few
    return found.documents.join(rows, "alike").select("document", "tokens", "values")


def _weighted(tf: DataFrame, words: DataFrame, n: DataFrame, *more: str) -> DataFrame:
    counted = words.select("token", "freq", *more).join(F.broadcast(n))  # one row
    return tf.join(counted, "token").select("token", "document", *more, frequencies.log_tf_log_idf(F.col("value"), F.col("freq"), F.col("ndocs")).alias("value"))


def tf_idf_words(files: DataFrame) -> DataFrame:
    """(token, document, value): the first whole flow."""
    tf = stored(word_bags(files), "tf")  # read three times, made once
    df = stored(tf.groupBy("token").agg(F.count("document").alias("freq")), "df")  # a file has a word once
    return _weighted(tf, df, frequencies.n_documents(tf))


def repos2coocc(nodes: DataFrame, least: int = 1, size: int | None = None, split: trees.Split = tokens.split_identifier) -> DataFrame:
    """Co-occurrences of the stems that ``least`` documents have, as ids of their vocabulary."""
    found = matrices.Contexts(nodes, split, tokens.STEM_ABOVE)
    df = frequencies.pruned(found.document_frequency(), least)
    words = stored(frequencies.ordered(df if size is None else frequencies.greatest(df, size)), "words")  # so that it is broadcast if it is small
    return found.cooccurrence(words)


def repos2ids(files: DataFrame, with_frequencies: bool = True, split: bool = True) -> DataFrame:
    """Names in source code with their words; ``split``: only names of several words."""
    make = frequencies.identifier_frequencies if with_frequencies else frequencies.distinct_identifiers
    return make(source_identifiers(files, split), tokens.split_identifier(F.col("token"), least=1))
