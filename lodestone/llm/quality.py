"""Quality rules: base counts of a text, and n-gram perplexity bands by language.

The perplexity is that of an interpolated modified Kneser-Ney model of order
``ORDER`` over the characters of words, each word with its borders, one model
for each language, counted in Spark over all documents. (Characters because the
distinct n-grams then hardly grow with the corpus, while any word, also one never
seen, gets a probability.) Grams with their probabilities, and contexts with
their back-off weights, lie in sorted hash arrays in the shared folder, which
the workers map into memory. A second model of each language, of the same order,
reads whole texts across the borders of words, so it sees which word follows which; both
share the grams within a word. Texts are read as rows of code points, some ``CHARS`` at a time, so
what a task holds is bounded by that and by how many different grams it keeps, not by its words. A text has two figures, its mean log10 probability a
word by either model. A band of a language is the median plus and minus ``WIDTH`` robust
standard deviations over all documents that pass the base rules; a text above or
below either band is rejected.

A language is known by the hash of its whole name. What there is one of for each language (its
discounts, its band) is broadcast while there are at most ``LANGUAGES`` of them, so a language
that most rows have is not gathered in one task; beyond that Spark joins by language.

Edge cases: a null text is the empty text and fails the base rules; a null
language is a language of its own; a language whose documents all have one figure
has a band of that figure; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, fresh_path, given_back, ship, slices, small_batches, table, written
from .kneser_ney import HashArrays, discount_columns, mixed

ORDER = 5
WIDTH = 5.0
LEAST_WORDS, MOST_REPEAT = 50, 50
#: None can occur in a word: before a word read alone, after each word, before a text.
BEGIN, END, TOP = "\t", "\n", "\v"
#: No code point.
NONE = 0x110000
#: Marks the model of a language that reads across the borders of words.
ACROSS = ">"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bytes of texts, and of these code points, that are worked on at once.
TEXTS, CHARS = 2 << 20, 1 << 19
#: Grams that a task counts before it sums them up, or passes them on.
HELD = 1 << 20
#: Grams whose probabilities a task keeps, 24 bytes each.
KEPT = 1 << 19
EXACT = 1 << 21
#: Languages whose models a task has at hand.
SCORERS = 16
#: Rows of one a language that are broadcast: some 100 bytes each.
LANGUAGES = 50_000


def words_of(text: str) -> list[bytes]:
    return text.encode(errors="replace").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    own = dict.fromkeys(words)
    own.update(zip(own, range(len(own))))
    return np.fromiter(map(own.__getitem__, words), np.int64, len(words))


def base_counts(text: str, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ``words`` are numbers that stand for the words."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeat = 0
    if len(words) > 3:
        if words.max() < EXACT:
            key = (words[:-2] << 42) | (words[1:-1] << 21) | words[2:]
        else:
            pair = np.unique((words[:-1] << 32) | words[1:], return_inverse=True)[1]
            key = (pair[:-1] << 32) | words[2:]
        in_order = np.sort(key)
        again = in_order[1:][in_order[1:] == in_order[:-1]]
        if len(again):
            twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeat = int(covered.sum())
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def language() -> Column:
    """The name of a row's language, which null does not share with any."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def by_language(few: DataFrame, name: str) -> DataFrame:
    """``few``, a row for each language, written; for a broadcast if that is small for sure."""
    few = written(few, name)
    return F.broadcast(few) if few.count() <= LANGUAGES else few


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def in_a_row(texts: list[list[bytes]]) -> np.ndarray:
    """The code points of the words of all texts: before each text ``ORDER - 1`` times ``TOP``, after each of its words an ``END``, after all texts zeros."""
    lead, end = TOP.encode() * (ORDER - 1), END.encode()
    joined = b"".join([lead + end.join(words) + end if words else lead for words in texts])
    return np.frombuffer((joined + bytes(ORDER - 1)).decode().encode("utf-32-le"), "<u4")


def portions(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of ``in_a_row``, ``CHARS`` at a time: where windows of ``ORDER`` begin, their hashes, where words begin, the hashes of their heads."""
    last = len(chars) - ORDER + 1
    for lo in range(ORDER - 1, last, CHARS):
        hi = min(lo + CHARS, last)
        here, before = chars[lo:hi], chars[lo - 1 : hi - 1]
        at = np.flatnonzero(here != ord(TOP))
        first = at[(before[at] == ord(END)) | (before[at] == ord(TOP))] + lo
        yield at + lo - ORDER + 1, hashed([chars[lo - ORDER + 1 + k : hi - ORDER + 1 + k] for k in range(ORDER)])[at], first, hashed(heads(chars, first).T)


def heads(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A ``BEGIN`` and the first ``ORDER - 1`` code points of the words, with their ends, that begin there, ``NONE`` after an end."""
    out = np.empty((len(first), ORDER), "<u4")
    out[:, 0], going = ord(BEGIN), np.ones(len(first), bool)
    for k in range(1, ORDER):
        out[:, k] = np.where(going, chars[first + k - 1], NONE)
        going &= (out[:, k] != ord(END)) & (out[:, k] != NONE)
    return out


def begun(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows with a ``BEGIN`` of words with these heads, and the head of each."""
    chars = np.concatenate([np.full((len(rows), ORDER - 2), ord(BEGIN), "<u4"), rows], 1)
    own = [np.flatnonzero(chars[:, k] != NONE) for k in range(ORDER - 1, chars.shape[1])]
    return np.concatenate([chars[at, k : k + ORDER] for k, at in enumerate(own)]), np.concatenate(own)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each different key, and which of these each key is."""
    which = pa.array(keys.view(np.int64)).dictionary_encode().indices.to_numpy()
    one = np.empty(int(which.max()) + 1 if len(which) else 0, np.int64)
    one[which] = np.arange(len(which))
    return one, which


class Counted:
    """How often rows of code points occur."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.parts)

    def add(self, keys: np.ndarray, rows) -> None:
        """Rows by their hashes; ``rows`` gives those at some places."""
        one, which = distinct(keys)
        self.parts.append((keys[one], np.bincount(which, minlength=len(one)), rows(one)))

    def sum_up(self) -> None:
        if len(self.parts) > 1:
            keys, count, rows = (np.concatenate(x) for x in zip(*self.parts))
            one, which = distinct(keys)
            self.parts = [(keys[one], np.bincount(which, count, len(one)).astype(np.int64), rows[one])]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row once, and how often it occurs."""
        self.sum_up()
        return (self.parts[0][2], self.parts[0][1]) if self.parts else (np.empty((0, ORDER), "<u4"), np.empty(0, np.int64))


def as_strings(rows: np.ndarray) -> pa.Array:
    """Rows of code points as a string each."""
    size = 1 + (rows >= 0x80).astype(np.int32) + (rows >= 0x800) + (rows >= 0x10000)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size.sum(1), dtype=np.int32)])
    content = rows.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(content))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): character n-grams of the highest order over all words of all rows, read one by one and across their borders, summed up in each task first.

    Grams within a word are there once; with ``BEGIN`` they are of words read one by one, with ``TOP`` or an ``END`` before the last place of whole texts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counted, Counted]] = {}
        size = lambda x: sum(map(len, held[x]))

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            (grams, count), (firsts, times) = (x.all() for x in held.pop(lang))
            windows, owner = begun(firsts)
            one, which = distinct(hashed(windows.T))
            grams, count = np.concatenate([grams, windows[one]]), np.concatenate([count, np.bincount(which, times[owner], len(one)).astype(np.int64)])
            for at in range(0, len(count), 1 << 16):
                part = count[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part)), as_strings(grams[at : at + len(part)]), pa.array(part, pa.int64())], ["lang", "gram", "c"])

        for batch in batches:
            for lo, hi in slices(batch.column(1), TEXTS):
                own: dict[str, list[list[bytes]]] = {}
                for lang, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                    own.setdefault(lang, []).append(words_of(text))
                for lang, found in own.items():
                    grams, firsts = held.setdefault(lang, (Counted(), Counted()))
                    chars = in_a_row(found)
                    for at, keys, begin, head_keys in portions(chars):
                        grams.add(keys, lambda one, at=at: chars[at[one][:, None] + np.arange(ORDER)])
                        firsts.add(head_keys, lambda one, begin=begin: heads(chars, begin[one]))
                if sum(map(size, held)) > HELD:
                    for x in held.values():
                        x[0].sum_up(), x[1].sum_up()
                while sum(map(size, held)) > HELD * 3 // 4:
                    yield from rows(max(held, key=size))
        for lang in list(held):
            yield from rows(lang)

    source = docs.select(language().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(given_back(run), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def of_models(grams: DataFrame) -> DataFrame:
    """``grams`` of either model under the name that it has for the language."""
    across = F.col("gram").contains(TOP) | (F.instr("gram", END).between(1, ORDER - 1))
    words = grams.where(~across)
    return words.unionByName(grams.where(~F.col("gram").contains(BEGIN)).withColumn("lang", F.concat(F.lit(ACROSS), "lang")))


#: What the code points of a gram are multiplied by, its last one by the last: odd numbers of 64 bits.
FACTORS = mixed(np.arange(1, ORDER + 1)) | np.uint64(1)


def hashed(columns) -> np.ndarray:
    """A hash of grams, given as a column of code points for each place; ``gram_keys`` mixes it with the language."""
    out = columns[0].astype(np.uint64) * FACTORS[-len(columns)]
    for x, factor in zip(columns[1:], FACTORS[len(FACTORS) - len(columns) + 1 :]):
        out += x.astype(np.uint64) * factor
    return out


def model_seed(langs: np.ndarray, size: int, space: int) -> np.ndarray:
    """What is added to the hashes of grams of ``size`` code points; ``langs`` are codes of languages, ``space`` keeps contexts apart from grams."""
    return mixed(mixed(langs.astype(np.uint64) + np.uint64(space + 1)) + np.uint64(size + 1))


def gram_keys(langs: np.ndarray, chars: np.ndarray, space: int) -> np.ndarray:
    """Keys of grams given as rows of code points."""
    seed = model_seed(langs, chars.shape[1], space)
    return mixed(seed + hashed(chars.T)) if chars.shape[1] else seed


def lang_code(lang: str) -> int:
    """The hash of a whole name as ``language`` gives it."""
    return xxhash.xxh64_intdigest(lang.encode(errors="replace"))


def train(docs: DataFrame) -> HashArrays:
    """Count, smooth and store the models of all languages."""
    spark = docs.sparkSession
    with small_batches(spark):
        counted = written(count_grams(docs), "grams")
    counts = [written(of_models(counted), "model-grams")]
    begins = lambda x: F.startswith(x, F.lit(BEGIN)) | F.startswith(x, F.lit(TOP))
    for n in range(ORDER - 1, 0, -1):  # below the highest order: in how many contexts, but how often after a begin
        shorter = counts[0].withColumn("gram", F.substring("gram", 2, n)).groupBy("lang", "gram")
        counts.insert(0, written(shorter.agg(F.when(begins(F.col("gram")), F.sum("c")).otherwise(F.count("*")).alias("c")), f"grams{n}"))
    lower, parts = None, []
    for n, grams in enumerate(counts, 1):
        grams = grams.where(~F.endswith(F.col("gram"), F.lit(BEGIN)) & ~F.endswith(F.col("gram"), F.lit(TOP)))
        tally = lambda k: F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}")
        cut = by_language(grams.groupBy("lang").agg(*map(tally, range(1, 5)), F.count("*").alias("v")).select("lang", "v", *discount_columns()), f"discounts{n}")
        grams = grams.join(cut, "lang").withColumn("context", F.substring("gram", 1, n - 1)).withColumn("suffix", F.substring("gram", 2, n - 1))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = grams.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(off).alias("cut"))
        contexts = contexts.select("lang", "context", "total", (F.col("cut") / F.col("total")).alias("gamma"))
        grams = grams.join(contexts, ["lang", "context"])
        if lower is None:
            below = 1 / (F.col("v") + 1)
            parts.append(cut.select("lang", F.lit("").alias("gram"), F.lit(0).alias("space"), below.alias("value")))
        else:
            grams, below = grams.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"]), F.col("below")
        lower = written(grams.select("lang", "gram", ((F.col("c") - off) / F.col("total") + F.col("gamma") * below).alias("p")), f"p{n}")
        parts += [lower.select("lang", "gram", F.lit(0).alias("space"), F.col("p").alias("value")), contexts.select("lang", F.col("context").alias("gram"), F.lit(1).alias("space"), F.col("gamma").alias("value"))]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    size = sum(x.count() for x in counts)
    store = HashArrays(fresh_path(spark, "quality-model"), max(0, (size // 500_000).bit_length()), {"p": "<f4"})

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, gram, space, value = (c.to_pylist() for c in b.columns)
            code = {x: lang_code(x) for x in set(lang)}
            keys = np.zeros(len(gram), np.uint64)
            length = np.fromiter(map(len, gram), int, len(gram)) * 2 + np.array(space, int)
            codes = np.fromiter(map(code.__getitem__, lang), np.uint64, len(lang))
            for kind in np.unique(length):
                at = np.flatnonzero(length == kind)
                chars = np.frombuffer("".join([gram[i] for i in at.tolist()]).encode("utf-32-le"), "<u4").reshape(len(at), int(kind // 2))
                keys[at] = gram_keys(codes[at], chars, int(kind % 2))
            yield pa.RecordBatch.from_arrays([pa.array(store.shard(keys)), pa.array(keys.view(np.int64)), pa.array(value, pa.float64())], ["shard", "key", "p"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        n = 0
        if held:
            shard, key, p = (np.concatenate(x) for x in zip(*held))
            for s in np.unique(shard).tolist():
                own = shard == s
                store.save(s, key[own].view(np.uint64), p=p[own])
                n += int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    made = everything.mapInArrow(given_back(keyed), "shard long, key long, p double")
    made.repartition(1 << store.bits, "shard").mapInArrow(given_back(save), "n long").agg(F.sum("n")).first()
    return store


class Model:
    """log10 probabilities of grams under the model of one name."""

    def __init__(self, store: HashArrays, name: str):
        self.store, self.code = store, np.array([lang_code(name)], np.uint64)
        there, found = store.find(gram_keys(self.code, np.empty((1, 0)), 0))
        self.uniform = float(found["p"][0]) if there[0] else 1e-6

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        there, found = self.store.find(gram_keys(self.code, grams, 0))
        p = found["p"].astype(float)
        if not there.all():
            p[~there] = self._backed_off(grams[~there])
        return np.log10(np.maximum(p, 1e-30))

    def _backed_off(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.uniform)
        for n in range(1, ORDER + 1):
            there, found = self.store.find(gram_keys(self.code, grams[:, ORDER - n :], 0))
            _, weight = self.store.find(gram_keys(self.code, grams[:, ORDER - n : ORDER - 1], 1))
            gamma = weight["p"].astype(float)
            p = np.where(there, found["p"], np.where(gamma > 0, gamma * p, p))
        return p


class Known:
    """What a task knows of grams of all languages, ``KEPT`` at least, each at the place that its key has: a newer one replaces what is there."""

    def __init__(self):
        self.bits = max(1, (KEPT - 1).bit_length())
        self.table = np.zeros(1 << self.bits, [("key", "<u8"), ("word", "<f8"), ("text", "<f8")])
        self.table["key"][0] = ~np.uint64(0)  # that key has another place, and key 0 is not known

    def __call__(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """What keys add to the figures of words and of texts; ``make`` gives both for the places of new ones."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.table.take(at)
        word, text = found["word"], found["text"]
        new = np.flatnonzero(found["key"] != keys)
        if len(new):
            one, which = distinct(keys[new])
            made = np.empty(len(one), self.table.dtype)
            made["key"] = keys[new[one]]
            made["word"], made["text"] = make(new[one])
            self.table[at[new[one]]] = made
            word[new], text[new] = made["word"][which], made["text"][which]
        return word, text


class Scorer:
    """log10 probabilities of texts of a language by both of its models."""

    def __init__(self, store: HashArrays, lang: str | None, known: Known | None = None):
        name = "" if lang is None else f"={lang}"
        self.alone, self.across, self.known = Model(store, name), Model(store, ACROSS + name), known or Known()
        self.seed = model_seed(self.across.code, ORDER, 0)

    def sums(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum over its words read one by one, and that over the words after each other."""
        chars = in_a_row(texts)
        start = np.flatnonzero(chars == ord(TOP))[:: ORDER - 1]
        word, text = np.zeros(len(texts)), np.zeros(len(texts))
        for at, keys, begin, head_keys in portions(chars):
            for places, hashes, make in ((at, keys, self._windows), (begin, head_keys, self._heads)):
                if not len(places):
                    continue
                values = self.known(mixed(hashes + self.seed), lambda new, places=places, make=make: make(chars, places[new]))
                cuts = np.searchsorted(places, start)
                own = np.flatnonzero(np.diff(cuts, append=len(places)))
                for out, x in zip((word, text), values):
                    out[own] += np.add.reduceat(x, cuts[own])
        return word, text

    def _windows(self, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = chars[at[:, None] + np.arange(ORDER)]
        within = ~((grams[:, :-1] == ord(END)) | (grams[:, :-1] == ord(TOP))).any(1)
        word = np.zeros(len(grams))
        word[within] = self.alone(grams[within])
        return word, self.across(grams)

    def _heads(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, owner = begun(heads(chars, first))
        return np.bincount(owner, self.alone(grams), len(first)), np.zeros(len(first))

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers of the words of each text; ``p`` has by number the probabilities of these words read alone."""
        number = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
        self.p = self.sums([[w] for w in number])[0]
        return [np.array([number[w] for w in words], np.int64) for words in texts]


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("word_logp", "double"), ("text_logp", "double")]


def measured(docs: DataFrame, store: HashArrays, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the base counts, word_logp and text_logp (null without words) of every row."""

    def make():
        scorers: dict[str | None, Scorer] = {}
        known = Known()

        def of(rows: list[str], langs: list[str | None]):
            by_lang: dict[str | None, list[int]] = {}
            for i, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(i)
            made: list[tuple] = [()] * len(rows)
            for lang, own in by_lang.items():
                if lang not in scorers and len(scorers) >= SCORERS:
                    scorers.clear()
                if lang not in scorers:
                    scorers[lang] = Scorer(store, lang, known)
                column = pa.array([rows[i] for i in own], pa.string())
                for lo, hi in slices(column, TEXTS):
                    texts = [words_of(rows[i]) for i in own[lo:hi]]
                    for i, words, word, text in zip(own[lo:hi], texts, *scorers[lang].sums(texts)):
                        n = len(words)
                        made[i] = (*base_counts(rows[i], numbered(words)), *((word / n, text / n) if n else (None, None)))
            return list(map(list, zip(*made)))

        return of

    return annotate(docs, keep, FIELDS, make, also=("lang",))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, word_low, word_high, text_low, text_high) from all ``rows`` (lang, word_logp, text_logp) that pass the base rules."""
    figures = ("word", "text")
    passed = rows.where(~base_failed() & F.col("word_logp").isNotNull()).select(language().alias("lang"), *[f"{x}_logp" for x in figures])
    middle = by_language(passed.groupBy("lang").agg(*[F.percentile_approx(f"{x}_logp", 0.5, 10_000).alias(f"{x}_middle") for x in figures]), "middles")
    off = lambda x: F.abs(F.col(f"{x}_logp") - F.col(f"{x}_middle"))
    spread = passed.join(middle, "lang").groupBy("lang", *[f"{x}_middle" for x in figures]).agg(*[(1.4826 * F.percentile_approx(off(x), 0.5, 10_000)).alias(f"{x}_spread") for x in figures])
    edge = lambda x, sign, name: (F.col(f"{x}_middle") + sign * WIDTH * F.col(f"{x}_spread")).alias(f"{x}_{name}")
    return spread.select("lang", *[edge(x, sign, name) for x in figures for sign, name in ((-1, "low"), (1, "high"))])


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (lang among them), the base counts, word_logp, text_logp, base_failed and kept of every row."""
    store = train(docs)
    with small_batches(docs.sparkSession):
        rows = written(measured(docs, store, keep), "quality-rows")
    edges = ["word_low", "word_high", "text_low", "text_high"]
    own = by_language(bands(rows).select(F.col("lang").alias("__lang"), *edges), "bands")
    inside = lambda x: F.coalesce(F.col(f"{x}_logp").between(F.col(f"{x}_low"), F.col(f"{x}_high")), F.lit(False))
    return rows.join(own, language() == F.col("__lang"), "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside("word") & inside("text")).drop("__lang", *edges)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id", "lang"])
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_logp", "text_logp")
