"""Benchmark decontamination on canonical templates.

Every word becomes a template token: numbers (digits or words), units and names
(capitalised words) become typed placeholders, anything else its lower-cased core
without the punctuation around it. Windows of ``WINDOW`` template tokens of all
documents are hash-joined with those of the benchmark items. The windows of one place of a document and
item count if their templates are equal token by token and their slots are consistent:
each value in the item stands for one value in the document, and the other way round. So a
question with other numbers or names in it is caught, and a chance fit of placeholders is
not. Template windows with fewer than half literal tokens are not used.

Windows are made in three ways, and a pair is reported if one of them finds it, with the figures of the
first that does:

* ``TYPED``: as above.
* ``FOLDED``: words case-folded and names literal, since capitals tell names and a copy in capitals has others.
* ``VERBATIM``: every word literal and case-folded. These need no consistency: what is word for word
  the item's counts whatever its slots, and whatever was changed around it.

Number words and units depend on the language: ``WORDS`` by default, or a parameter. A document is
read with the list of its ``lang``, one without (or without that column) with all lists together; an
item, whose language is not given, with each of them.

An item of fewer than ``WINDOW`` words is one window of its own length.

Documents' windows pass a table of the benchmark's window hashes first, so
that only those reach the shuffle that can join. The table is sent to the tasks and the item windows are
broadcast if there are at most ``BROADCAST_MOST`` of them in at most ``BROADCAST_BYTES``; beyond that all windows go to the join.

Edge cases: a null or empty text or item has no windows; repeated rows of one id
are one document; a row whose doc_id is null cannot be named and is not reported (``without_leaks``
filters such rows too, each by itself).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded_words, given_back, ship, slices, table, written

WINDOW = 13
BROADCAST_MOST, BROADCAST_BYTES = 2_000_000, 256 << 20
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
TYPED, FOLDED, VERBATIM = 0, 1, 2
#: Words whose hashes a task keeps, and bytes of texts that it works on at once.
CACHE_MOST, CHUNK = 120_000, 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Units that are written alike in most languages.
SIGNS = "mm cm m km mg g kg t ml cl l ms s min h hz kb mb gb w kw v usd eur gbp chf °c °f"
#: (number words, units) by language.
WORDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    lang: (frozenset(numbers.split()), frozenset(f"{SIGNS} {units}".split()))
    for lang, numbers, units in (
        (
            "en",
            "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
            "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half",
            "inch inches ft foot feet yard yards mile miles lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons "
            "liter liters litre litres gallon gallons cup cups sec second seconds minute minutes hr hour hours day days week weeks month months year years "
            "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mph kph cent cents dollar dollars euro euros percent degree degrees",
        ),
        (
            "de",
            "null eins ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
            "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden dutzend halb",
            "zoll meile meilen pfund gramm kilogramm tonne tonnen liter tasse tassen sekunde sekunden minute minuten stunde stunden std tag tage tagen woche wochen monat monate monaten jahr jahre jahren "
            "meter metern kilometer kilometern zentimeter cent euro dollar prozent grad",
        ),
        (
            "fr",
            "zéro un une deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante septante huitante nonante "
            "cent cents mille million millions milliard milliards douzaine demi demie",
            "pouce pouces pied pieds mille milles livre livres gramme grammes kilogramme kilogrammes tonne tonnes litre litres tasse tasses seconde secondes minute minutes heure heures jour jours semaine semaines mois an ans année années "
            "mètre mètres kilomètre kilomètres centimètre centimètres centime centimes euro euros dollar dollars pourcent degré degrés",
        ),
        (
            "es",
            "cero uno un una dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa "
            "cien ciento mil millón millones docena medio media",
            "pulgada pulgadas pie pies milla millas libra libras gramo gramos kilogramo kilogramos kilo kilos tonelada toneladas litro litros taza tazas segundo segundos minuto minutos hora horas día días semana semanas mes meses año años "
            "metro metros kilómetro kilómetros centímetro centímetros céntimo céntimos euro euros dólar dólares grado grados",
        ),
    )
}
DIGITS = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
DIGITS_UNIT = re.compile(r"[-+]?[$€£]?\d[\d.,]*([a-z]+)")
NAME_HASH = xxhash.xxh64_intdigest(NAME)
EDGES = ".,;:!?\"'()[]{}<>*_`~#&|…«»“”‘’-–—"


Lists = tuple[frozenset[str], frozenset[str]]


def template_token(word: str, folded: bool = False, lists: Lists = WORDS["en"]) -> str:
    """The token of a word; ``folded``: the same for all spellings in capitals and small letters, with names literal."""
    numbers, units = lists
    core = word.strip(EDGES) or word
    low = core.casefold() if folded else core.lower()
    if any(c.isdigit() for c in core):
        if DIGITS.fullmatch(low if folded else core):
            return NUMBER
        if (m := DIGITS_UNIT.fullmatch(low)) and m[1] in units:
            return NUMBER + UNIT
        return low
    if low in numbers:
        return NUMBER
    if low in units:
        return UNIT
    if not folded and len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME
    return low


def literal_token(word: str) -> str:
    return (word.strip(EDGES) or word).casefold()


def token_of(word: str, way: int, lists: Lists) -> str:
    return literal_token(word) if way == VERBATIM else template_token(word, way == FOLDED, lists)


def is_slot(token: str) -> bool:
    return token in (NUMBER, UNIT, NAME, NUMBER + UNIT)


def all_lists(words: dict[str, Lists]) -> dict[str, Lists]:
    """``words`` with all lists together under the empty name."""
    return {"": (frozenset().union(*(n for n, _ in words.values())), frozenset().union(*(u for _, u in words.values())))} | words


class Hashes(dict):
    """The number of a word, by which ``plain`` has the hashes of its literal, typed and folded token.

    Words whose tokens depend on the list have a row of ``listed`` instead: typed and folded for each list.
    """

    def __init__(self, lists: dict[str, Lists]):
        super().__init__()
        self.lists, self.column = list(lists.values()), {name: k for k, name in enumerate(lists)}
        self.words = {x for own in self.lists for x in (*own[0], *own[1])}
        self.words |= {x.casefold() for x in self.words}
        self.plain, self.row, self.listed = (array("Q"), array("Q"), array("Q")), array("l"), []

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES) or word
        low, literal = core.lower(), core.casefold()
        of = xxhash.xxh64_intdigest(literal)
        typed = folded = of
        row = -1
        if low in self.words or literal in self.words or not core.isalpha() and (DIGITS_UNIT.fullmatch(low) or DIGITS_UNIT.fullmatch(literal)):
            row = len(self.listed)
            self.listed.append([xxhash.xxh64_intdigest(template_token(word, f, own)) for own in self.lists for f in (False, True)])
        elif not core.isalpha():
            typed, folded = (xxhash.xxh64_intdigest(template_token(word, f, self.lists[0])) for f in (False, True))
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            typed = NAME_HASH
        elif low != literal:
            typed = xxhash.xxh64_intdigest(low)
        for held, value in zip(self.plain, (of, typed, folded)):
            held.append(value)
        self.row.append(row)
        n = self[word] = len(self)
        return n

    def of(self, codes: np.ndarray, words: list[str], names: np.ndarray) -> list[np.ndarray]:
        """The hashes of words given as ``codes`` of ``words``, by way; ``names`` has the column of the list that each is read with."""
        if len(self) >= CACHE_MOST:
            self.clear()
            self.plain, self.row, self.listed = (array("Q"), array("Q"), array("Q")), array("l"), []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        literal, typed, folded = (np.array(x, np.uint64)[at][codes] for x in self.plain)
        row = np.array(self.row, np.int64)[at][codes]
        if len(own := np.flatnonzero(row >= 0)):
            rows = np.array(self.listed, np.uint64)
            typed[own], folded[own] = rows[row[own], 2 * names[own]], rows[row[own], 2 * names[own] + 1]
        return [typed, folded, literal]


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` token hashes, by doubling."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    out, power, factor, done, need = tokens[:0], tokens, FACTOR, 0, size
    length = 1
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                out = power if not done else out[: len(out) - length] * factor + power[done : done + len(out) - length]
                done += length
            need >>= 1
            if need:
                power, factor, length = power[:-length] * factor + power[length:], factor * factor, length * 2
        return out[: len(tokens) - size + 1]


def windows_of(words: list[str], at: int, size: int, way: int = TYPED, lists: Lists = WORDS["en"]) -> tuple[str, list[str]] | None:
    """(template, slot values) of a window, None if placeholders outweigh its words."""
    own = words[at : at + size]
    tokens = [token_of(w, way, lists) for w in own]
    if way == VERBATIM:
        return " ".join(tokens), []
    slots = [w.strip(EDGES) or w for w, t in zip(own, tokens) if is_slot(t)]
    if way == FOLDED:
        slots = [s.casefold() for s in slots]
    return (" ".join(tokens), slots) if 2 * len(slots) <= size else None


WINDOWS = [("way", "int"), ("hash", "long"), ("at", "int"), ("template", "string"), ("slots", "array<string>")]
ARROW = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]


def template_windows(source: DataFrame, sizes, words: dict[str, Lists], wanted=None) -> DataFrame:
    """A row for each window of the rows (id, text, lang) of ``source``, in each way.

    sizes: gives the window sizes of a text of so many words. wanted: a broadcast
    of sorted window hashes; other windows are left out.
    """
    ship(source.sparkSession)
    schema = T.StructType([source.schema[0]] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in WINDOWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = all_lists(words)
        known = Hashes(lists)
        if wanted is not None:
            own = wanted.value
            first = np.zeros(1 << 20, bool)
            first[own >> np.uint64(44)] = True
        for batch in batches:
            for lo, hi in slices(batch.column(1), CHUNK):
                keys, langs = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2))
                codes, vocabulary, lengths = coded_words(batch.column(1).slice(lo, hi - lo))
                starts = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(keys)), lengths)
                hashes = known.of(codes, vocabulary, np.array([known.column.get(x, 0) for x in langs])[owner])
                asked = [sizes(n) for n in lengths.tolist()]
                cols: list[list] = [[], [], [], [], [], []]
                for size in sorted(set().union(*asked)):
                    takes = np.array([size in x for x in asked])
                    for way in (TYPED, FOLDED, VERBATIM):
                        found = window_hashes(hashes[way], size)
                        at = np.arange(len(found))
                        if wanted is not None:
                            at = np.flatnonzero(first[found >> np.uint64(44)])
                            at = at[own[np.minimum(np.searchsorted(own, found[at]), len(own) - 1)] == found[at]]
                        at = at[(owner[at] == owner[at + size - 1]) & takes[owner[at]]]
                        for i in at.tolist():
                            k = owner[i]
                            window = [vocabulary[c] for c in codes[i : i + size]]
                            if made := windows_of(window, 0, size, way, lists.get(langs[k], lists[""])):
                                for col, value in zip(cols, (keys[k], way, int(found[i].view(np.int64)), i - int(starts[k]), *made)):
                                    col.append(value)
                            if len(cols[0]) >= 50_000:
                                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *map(pa.array, cols[1:], ARROW)], schema.names)
                                cols = [[], [], [], [], [], []]
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *map(pa.array, cols[1:], ARROW)], schema.names)

    return source.mapInArrow(given_back(run), schema)


def item_sizes(n: int) -> tuple[int, ...]:
    return (min(n, WINDOW),) if n else ()


def item_windows(benchmark: DataFrame, words: dict[str, Lists]) -> DataFrame:
    """(item_id, w, hash, item_at, t, item_slots): the windows of all items with every list, written once."""
    items = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.select("item_id", "text", F.explode(F.array(*map(F.lit, all_lists(words)))).alias("lang"))
    own = template_windows(items, item_sizes, words)
    own = own.select("item_id", F.col("way").alias("w"), "hash", F.col("at").alias("item_at"), F.col("template").alias("t"), F.col("slots").alias("item_slots"))
    return written(own.distinct(), "item-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: dict[str, Lists] = WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, n_slots, reparameterised) of each document that holds an item's text."""
    spark = docs.sparkSession
    own = item_windows(benchmark, words)
    size = F.octet_length("t") + F.coalesce(F.octet_length(F.array_join("item_slots", "")), F.lit(0)) + 64
    sums = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.collect_set(F.size(F.split("t", " "))).alias("lengths")).first()
    lengths = sorted(sums.lengths)  # up to WINDOW of them
    wanted = None
    joined_to = own
    if sums.n <= BROADCAST_MOST and sums.bytes <= BROADCAST_BYTES:
        hashes = own.select("hash").distinct().toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)
        wanted = spark.sparkContext.broadcast(np.sort(hashes.astype(np.int64).view(np.uint64)))
        joined_to = F.broadcast(own)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    source = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    found = template_windows(source, lambda n: [s for s in lengths if s <= n], words, wanted if sums.n else None)
    found = found.where(F.lit(sums.n > 0)).select("doc_id", "way", "hash", "at", "template", "slots").distinct()
    joined = found.join(joined_to, (found["hash"] == own["hash"]) & (F.col("template") == F.col("t")) & (F.col("way") == F.col("w")))
    slot = F.explode_outer(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    pairs = joined.select("doc_id", "item_id", "way", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", slot.alias("slot"))
    place = ["doc_id", "item_id", "way", "offset"]
    by_value = pairs.groupBy(*place, F.col("slot.a").alias("a")).agg(F.min("slot.b").alias("b"), (F.min("slot.b") != F.max("slot.b")).alias("split"), F.collect_set("item_at").alias("windows"))
    seen = by_value.groupBy(*place).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("windows")))).cast("long").alias("n_windows"),
        F.count("a").alias("n_slots"),
        F.countDistinct("b").alias("n_values"),
        F.coalesce(F.bool_or("split"), F.lit(False)).alias("split"),
        F.coalesce(F.bool_or(F.col("a") != F.col("b")), F.lit(False)).alias("reparameterised"),
    )
    whole = own.groupBy("item_id", F.col("w").alias("way")).agg(F.countDistinct("item_at").alias("n_item_windows"))
    good = seen.where(~F.col("split") & (F.col("n_values") == F.col("n_slots"))).groupBy("doc_id", "item_id")
    best = good.agg(F.max(F.struct((-F.col("way")).alias("first"), "n_windows", "n_slots", "reparameterised")).alias("x"))
    best = best.withColumn("way", -F.col("x.first")).join(whole, ["item_id", "way"])
    return best.select("doc_id", "item_id", "x.n_windows", "n_item_windows", "x.n_slots", "x.reparameterised")


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: dict[str, Lists] = WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; rows of one doc_id are judged together, rows without one each by their text."""
    named = docs.where("doc_id is not null")
    found = written(contaminated(named, benchmark, words).select("doc_id").distinct(), "contaminated")
    clean = named.join(found, "doc_id", "left_anti").select(*docs.columns)
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rest = docs.where("doc_id is null")
    if not rest.limit(1).count():
        return clean
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts_of = rest.select(key.alias("doc_id"), "text", lang.alias("lang")).where("text is not null")
    leaks = written(contaminated(texts_of, benchmark, words).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    rest = rest.withColumn("__key", key).join(leaks, "__key", "left_anti").select(*docs.columns)
    return clean.unionByName(rest)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
