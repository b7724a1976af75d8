"""A trained splitter of names that are written in one: a tagger over characters, counted in Spark, decoded by Viterbi.

A tag says whether a word begins at a character. What a tag depends on are the characters around it, those before it, those from it on,
and the tag before. The model has how often words begin in each of these contexts; a wide context that is rare leans on the one
within it, and the three kinds add their log odds. A name's best tags together are found by
dynamic programming over its characters, as column functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import precision_recall

#: (kind of context, its weight, the most characters: to each side around, else in all)
KINDS = (("around", 0.5, 3), ("before", 1.0, 6), ("from", 1.0, 6))
#: A context counts as much as so many of its own occurrences when it stands in for a wider one.
LEAN = 2.0
LEAST_CHANCE = 1e-6
PAD = max(most for *_, most in KINDS)
Model = tuple[DataFrame, dict]


def word_begins(split: Column) -> Column:
    """1 where a word begins, for each letter of words with something else between them."""
    words = F.filter(F.split(F.lower(split), r"[^a-z]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.length(w) - 1))))


def letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def tagged(df: DataFrame, split: str = "token_split") -> DataFrame:
    """(plain, flags) of words with blanks between them: letters in a row, and 1 where a word begins."""
    return df.select(letters(F.col(split)).alias("plain"), word_begins(F.col(split)).alias("flags")).where("plain <> ''")


def contexts(names: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, kind, size, context) of each place of ``plain`` but the first."""
    padded = F.concat(F.lit("^" * PAD), "plain", F.lit("$" * PAD))
    places = F.when(F.length("plain") > 1, F.sequence(F.lit(1), F.length("plain") - 1)).otherwise(F.array().cast("array<int>"))
    rows = names.select(*keep, F.explode(places).alias("at"), padded.alias("__padded"))
    cut = lambda lo, n: F.substring(F.col("__padded"), F.col("at") + (PAD + 1 + lo), F.lit(n))
    spans = {"around": lambda n: (-n, 2 * n), "before": lambda n: (-n, n), "from": lambda n: (0, n)}
    own = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("size"), cut(*spans[kind](n)).alias("context")) for kind, _, most in KINDS for n in range(most + 1)]
    return rows.select(*keep, "at", F.explode(F.array(*own)).alias("c")).select(*keep, "at", "c.*")


def trained(df: DataFrame, split: str = "token_split") -> Model:
    """((kind, context, n, begins), facts) of names with known words.

    Facts: the log odds of a beginning, and by the tag before how much more often a tag follows it than it occurs, as a logarithm.
    """
    names = tagged(df, split)
    counts = contexts(names, "flags").groupBy("kind", "context").agg(F.count("*").alias("n"), F.sum(F.get("flags", F.col("at"))).cast("long").alias("begins"))
    pairs = names.select(F.explode(F.arrays_zip(F.slice("flags", 1, F.size("flags") - 1).alias("a"), F.slice("flags", 2, F.size("flags")).alias("b"))).alias("p"))
    seen = {(r.a, r.b): r.n for r in pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).collect()}  # four rows
    n = lambda a, b: seen.get((a, b), 0) + 1
    begins = (n(0, 1) + n(1, 1)) / sum(n(a, b) for a in (0, 1) for b in (0, 1))
    gain = [[math.log(n(a, b) / (n(a, 0) + n(a, 1))) - math.log(begins if b else 1 - begins) for b in (0, 1)] for a in (0, 1)]
    return counts, {"prior": math.log(begins / (1 - begins)), "gain": gain}


def begin_chances(names: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(keep, at, chance): how likely a word begins at each place."""
    counts, facts = model
    found = contexts(names, *keep).join(counts, ["kind", "context"], "left").groupBy(*keep, "at").agg(F.array_sort(F.collect_list(F.struct("kind", "size", "n", "begins"))).alias("seen"))
    odds: Column = F.lit(facts["prior"])
    for kind, weight, _ in KINDS:
        own = F.filter("seen", lambda c: c["kind"] == kind)
        lean = F.aggregate(own, F.lit(0.5), lambda p, c: (F.coalesce(c["begins"], F.lit(0)) + LEAN * p) / (F.coalesce(c["n"], F.lit(0)) + LEAN))
        chance = F.least(F.greatest(lean, F.lit(LEAST_CHANCE)), F.lit(1 - LEAST_CHANCE))
        odds = odds + weight * (F.log(chance / (1 - chance)) - facts["prior"])
    return found.select(*keep, "at", (1 / (1 + F.exp(-odds))).alias("chance"))


def best_tags(chances: Column, gain: list[list[float]]) -> Column:
    """A string of 0 and 1 for the array of chances at the places after the first, where a word begins: the likeliest tags together."""
    start = F.struct(F.lit(float("-inf")).alias("s0"), F.lit(0.0).alias("s1"), F.lit("").alias("p0"), F.lit("1").alias("p1"))

    def step(acc: Column, chance: Column) -> Column:
        out = []
        for tag in (0, 1):
            from0, from1 = acc["s0"] + gain[0][tag], acc["s1"] + gain[1][tag]
            own = F.log(chance if tag else 1 - chance)
            out.append((F.greatest(from0, from1) + own, F.concat(F.when(from0 >= from1, acc["p0"]).otherwise(acc["p1"]), F.lit(str(tag)))))
        (s0, p0), (s1, p1) = out
        return F.struct(s0.alias("s0"), s1.alias("s1"), p0.alias("p0"), p1.alias("p1"))

    return F.aggregate(chances, start, step, lambda acc: F.when(acc["s0"] >= acc["s1"], acc["p0"]).otherwise(acc["p1"]))


def split_names(df: DataFrame, model: Model, token: str = "token") -> DataFrame:
    """(token, token_split) of the distinct names with a letter in ``df``: their letters, with a blank before each word but the first."""
    names = df.select(F.col(token).alias("token")).distinct().withColumn("plain", letters(F.col("token"))).where("plain <> ''")
    rows = begin_chances(names, model, "token").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("at", "chance"))).alias("places"))
    chances = F.coalesce(F.col("places.chance"), F.array().cast("array<double>"))
    tags = names.join(rows, "token", "left").withColumn("tags", best_tags(chances, model[1]["gain"]))
    spaced = F.zip_with(F.split("plain", ""), F.split("tags", ""), lambda c, t: F.when(t == "1", F.concat(F.lit(" "), c)).otherwise(c))
    return tags.select("token", F.ltrim(F.array_join(spaced, "")).alias("token_split"))


def begins(df: DataFrame, split: str = "token_split") -> DataFrame:
    """(token, at, begin) of each place after the first, to compare splits of the same names."""
    return df.select("token", F.posexplode(word_begins(F.col(split))).alias("at", "begin")).where("at > 0")


def quality(names: DataFrame, model: Model) -> DataFrame:
    """(precision, recall, f1) of the places where words begin, over names (token, token_split) whose words are known."""
    truth = begins(names.where(letters(F.col("token")) == letters(F.col("token_split"))))
    said = begins(split_names(names, model)).withColumnRenamed("begin", "said")
    return precision_recall(truth.join(said, ["token", "at"]), "begin", "said")
