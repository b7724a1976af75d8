"""SimHash near-duplicate groups with pivot distance tables.

Texts become 64-bit fingerprints; equal ones collapse to one row before
anything is compared. Each fingerprint gets a table of its Hamming distances to
``PIVOTS`` reference fingerprints. By the triangle inequality two fingerprints
within ``MOST_BITS`` differ by no more than that in every coordinate, so a pair
is discarded as soon as one coordinate differs by more, and the survivors are
verified on all 64 bits.

Coordinates alone cannot find candidates without comparing all pairs (of two
random fingerprints one coordinate discards some 40 %), so pairs are only formed
within bands: of ``BLOCKS`` blocks of bits at most ``MOST_BITS`` hold a
difference, hence two linked fingerprints agree on all bits of some choice of
``BLOCKS - MOST_BITS`` blocks. One band exists for each choice; none is left out.

A band of more than ``CHUNK`` fingerprints is cut in the same way by the bits that it does not compare
(``INNER_BLOCKS`` blocks of those); what is still larger is dealt into chunks, and a task sees
two chunks at a time. It reports a spanning forest of the links that it finds and
not all of them, which leaves the components as they are.

Edge cases: texts without words have fingerprint 0 and link like any other; a null
text is the empty text; rows with a null doc_id get a fingerprint, and their
component is that of the others with that fingerprint (null if there are none);
repeated rows stay, each with its component.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, annotate, given_back, mapped, put_bytes, ship, small_batches, table, texts, written
from .components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BLOCKS = 7
PIVOTS = 16
CHUNK = 512
INNER_BLOCKS = 6
#: Keys of crowded bands that are broadcast, eight bytes each.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode(errors="replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= size:
        starts, stops = [0], [len(joined)]
    else:
        starts = [0, *ends[:-size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
    xx = xxhash.xxh64_intdigest
    hashes = np.array([xx(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    n = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        n += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * n > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signed(fingerprint(t, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    source = texts(docs)
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())]))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: rows of a 64-column Hadamard matrix, half of whose bits differ from each other's."""
    return [signed(sum(1 << c for c in range(64) if bin(r & c).count("1") % 2)) for r in range(1, 64, 64 // n)][:n]


def bands(blocks: int = BLOCKS, most_bits: int = MOST_BITS) -> list[int]:
    """Masks of the bits that each band compares."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [signed(sum(c)) for c in itertools.combinations(block, blocks - most_bits)]


def inner_bands(mask: int, most_bits: int = MOST_BITS, blocks: int = INNER_BLOCKS) -> list[int]:
    """The same over the bits that ``mask`` leaves out: of ``blocks`` blocks all but ``most_bits`` agree too."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(rest) * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in rest[lo:hi]) for lo, hi in itertools.pairwise(edges)]
    return [signed(sum(c)) for c in itertools.combinations(block, blocks - most_bits)]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which of the links (a[i], b[i]) of n nodes make a spanning forest."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (p := top(x)) != (q := top(y)):
            up[p] = q
            kept.append(i)
    return kept


def _survivors(fp: np.ndarray, coords: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose every coordinate is close, then those whose bits are."""
    for k in range(coords.shape[1]):
        near = np.abs(coords[i, k] - coords[j, k]) <= most
        i, j = i[near], j[near]
    near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most
    return i[near], j[near]


def links(rows: DataFrame, masks: list[int], most_bits: int) -> DataFrame:
    """(a, b): ids of ``rows`` (id, fp) that make the same components as all links do.

    A link is a pair that differs in at most ``most_bits`` bits; such a pair agrees on one of the masks.
    """
    scratch = Scratch(rows.sparkSession)
    keyed = rows.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "part"))
    keyed = keyed.withColumn("key", F.xxhash64("band", "part"))
    sizes = scratch.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    met = keyed.join(sizes.where(F.col("n") <= CHUNK).select("key"), "key").select(F.col("key").alias("task"), "id", "fp")
    if hot := sizes.where(F.col("n") > CHUNK).count():
        inner = F.array(*[F.array(*map(F.lit, inner_bands(m, most_bits))) for m in masks])
        crowded = keyed.join(F.broadcast(sizes.where(F.col("n") > CHUNK).select("key")) if hot <= BROADCAST_KEYS else sizes.where(F.col("n") > CHUNK).select("key"), "key")
        crowded = crowded.select("id", "fp", "key", F.explode(inner[F.col("band")]).alias("mask"))
        crowded = crowded.select("id", "fp", F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        chunks = crowded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        shared = crowded.join(chunks, "key")
        own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")
        dealt = shared.select("key", "id", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        met = met.unionByName(dealt.withColumn("task", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select("task", "id", "fp"))
    coords = F.transform(F.array(*map(F.lit, pivots())), lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)).cast("short"))
    met = met.repartition("task").sortWithinPartitions("task").select("task", "id", "fp", coords.alias("coords"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(task, ids, fp, coords):
            """Links of whole tasks, which follow each other in these arrays."""
            starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            n = np.diff(np.r_[starts, len(task)])
            i, j = _survivors(fp, coords, starts[n == 2], starts[n == 2] + 1, most_bits)
            out_a, out_b = [ids[i]], [ids[j]]
            for at, k in zip(starts[n > 2].tolist(), n[n > 2].tolist()):
                for lo in range(0, k, 256):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(lo + 256, k)), np.arange(lo + 1, k), indexing="ij"))
                    ahead = j > i
                    i, j = _survivors(fp, coords, i[ahead] + at, j[ahead] + at, most_bits)
                    keep = _forest(i - at, j - at, k)
                    out_a.append(ids[i[keep]])
                    out_b.append(ids[j[keep]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            cut = np.searchsorted(part[0], part[0][-1])
            if cut:
                yield found(*(x[:cut] for x in part))
            rest = [x[cut:] for x in part]
        if rest is not None:
            yield found(*rest)

    made = written(met.mapInArrow(given_back(run), "a long, b long").distinct(), "links")
    scratch.drop()
    return made


def groups(docs: DataFrame, size: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row."""
    made = written(fingerprints(docs, size), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = components(links(distinct.select(F.col("fp").alias("id"), "fp"), bands(BLOCKS, most_bits), most_bits))
    classes = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    classes = written(classes, "classes")
    ids = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = classes.join(ids, "class").select("fp", "component_id")
    return made.join(written(named, "named"), "fp").select("doc_id", "fp", "component_id")


NEAR_SIMILARITY, NEAR_SHINGLE = (4, 5), 5
SAMPLED, COMMON_MOST = 64, 1 << 15
SET_FILE_BYTES = 1 << 22
NEAR_CENTERS = 4
SKETCH_BITS = 512
#: Under a shingle of more texts than this, not all in one group, pairs are judged by their sketches as they are made.
CROWDED = 16


def few(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts of column 1, as strings only a few at a time."""
    for at in range(0, batch.num_rows, 200):
        yield from batch.column(1).slice(at, 200).to_pylist()


def near_key(text: str) -> bytes:
    return xxhash.xxh128_digest(b" ".join(text.encode(errors="replace").lower().split()))


def near_set(text: str) -> tuple[bytes, np.ndarray]:
    """The hash of the words of ``text``, and its distinct shingles of ``NEAR_SHINGLE`` words as sorted hashes."""
    words = text.encode(errors="replace").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= NEAR_SHINGLE:
        own = {xxhash.xxh64_intdigest(joined)}
    else:
        own = {xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[NEAR_SHINGLE - 1 :])}
    return xxhash.xxh128_digest(joined), np.sort(np.fromiter(own, np.uint64, len(own)))


def near_sketch(own: np.ndarray) -> np.ndarray:
    """A bit is 1 if an odd number of the shingles fall on it: two sets differ in as many members at least as their sketches in bits."""
    odd = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def near_prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: those not in ``common`` by hash, then ``common`` by rank.

    A set that shares the similarity asked for misses at most ``len // 5`` of these shingles, so
    one of ``len // 5 + 1`` is in both sets, and in the like prefix of the other.
    """
    n = len(own) * (NEAR_SIMILARITY[1] - NEAR_SIMILARITY[0]) // NEAR_SIMILARITY[1] + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, rank[at], 0)))]
    return own[:n]


def _enough(overlap, n, m):
    """Whether sets of n and m members that share ``overlap`` reach the similarity: overlap / (n + m - overlap) >= p / q."""
    p, q = NEAR_SIMILARITY
    return (p + q) * overlap >= p * (n + m)


def _alike_sketches(x, y, n, m):
    """Whether sets of n and m members can reach the similarity by their sketches: with the overlap asked for they differ in (n + m) / 9 members at most."""
    p, q = NEAR_SIMILARITY
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return (p + q) * apart <= (q - p) * (n + m)


def _common_shingles(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles of a sample, and their ranks: only the order of prefixes depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in few(batch):
                yield pa.RecordBatch.from_arrays([pa.array(near_set(t)[1].view(np.int64))], ["h"])

    sample = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    top = sample.mapInArrow(given_back(run), "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON_MOST).collect()
    hashes = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(top) - order).astype(np.int32)


def _near_sets(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, file, at, n): where in the shared folder the set of each text is."""
    folder = scratch.path("near-set-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rows, size = [], [], 0

        def flushed():
            file = f"{folder}/{uuid.uuid4().hex}"
            put_bytes(file, np.concatenate(sets).tobytes())
            made = [(t, file, at, n) for t, at, n in rows]
            kinds = [pa.binary(), pa.string(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["text_key", "file", "at", "n"])

        for batch in batches:
            for t in few(batch):
                key, own = near_set(t)
                rows.append((key, size, len(own)))
                sets.append(own)
                size += len(own)
                if 8 * size >= SET_FILE_BYTES:
                    yield flushed()
                    sets, rows, size = [], [], 0
        if rows:
            yield flushed()

    with small_batches(docs.sparkSession):
        made = scratch.written(docs.mapInArrow(given_back(run), "text_key binary, file string, at int, n int"), "near-sets")
    places = made.groupBy("text_key").agg(F.min(F.struct("file", "at", "n")).alias("x"))
    return places.select(F.xxhash64("text_key").alias("t"), "x.*")


def _verified(pairs: DataFrame, distinct: DataFrame, source: DataFrame, keep: Scratch) -> DataFrame:
    """Those of the pairs (a, b) of ``distinct`` texts whose sets reach the similarity, counted on the sets of all texts in a pair."""
    scratch = Scratch(source.sparkSession)
    pairs = pairs.distinct()
    for side in ("a", "b"):
        pairs = pairs.join(distinct.select(F.col("t").alias(side), F.col("sketch").alias(f"{side}_sketch"), F.col("n").alias(f"{side}_n")), side)
    pairs = pairs.where(_alike_sketches(F.col("a_sketch"), F.col("b_sketch"), F.col("a_n"), F.col("b_n"))).select("a", "b")
    pairs = scratch.written(pairs, "near-pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    rows = distinct.join(members, "t", "left_semi").select("id", "text_key")
    ids = scratch.written(rows.select(F.col("id").alias("doc_id")).where("doc_id is not null").distinct(), "near-ids")
    texts_of = source.join(ids, "doc_id", "left_semi")
    if rows.where("id is null").limit(1).count():
        texts_of = texts_of.unionByName(source.where("doc_id is null"))
    sets = _near_sets(texts_of, scratch)
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("t").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("file", "at", "n")]), side)
    pairs = pairs.select("a", "b", "a_file", "a_at", "a_n", "b_file", "b_at", "b_n").sortWithinPartitions("a_file", "b_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, np.ndarray] = {}

        def own(file, at, n):
            if file not in opened:
                if len(opened) >= 16:
                    opened.clear()
                opened[file] = mapped(file, np.uint64)
            return opened[file][at : at + n]

        for batch in batches:
            good = []
            for fa, i, n, fb, j, m in zip(*(c.to_pylist() for c in batch.columns[2:])):
                x, y = own(fa, i, n), own(fb, j, m)
                overlap = int((y[np.minimum(np.searchsorted(y, x), m - 1)] == x).sum())
                good.append(bool(_enough(overlap, n, m)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = keep.written(pairs.mapInArrow(given_back(run), "a long, b long"), "near-links")
    scratch.drop()
    return found


def near_keys(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and text_key, the hash of the words in lower case, of every row."""
    return annotate(docs, keep, [("text_key", "binary")], lambda: lambda ts: [[near_key(t) for t in ts]])


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, first, group of every row: first is the smallest doc_id of its group of near copies (null if none has one).

    Near copies share ``NEAR_SIMILARITY`` of their distinct shingles of ``NEAR_SHINGLE`` words.
    Texts of the same words in the same order are collapsed first; text_key is the hash of those.

    Candidates come in two rounds and are verified on their whole sets. The first round takes texts whose
    SimHash fingerprints over those shingles link (pivot distances, as ``groups`` does), and
    pairs each text under a shingle of its prefix (``near_prefix``) with one that is there too. The second makes the groups those of all near copies: two near
    copies always share a shingle of their prefixes, so all texts under one that are still in
    different groups are compared, if their sizes, places of that shingle and sketches allow the similarity. Texts of one doc_id are in one group.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    source = texts(docs)
    order = spark.sparkContext.broadcast(_common_shingles(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = order.value
        for batch in batches:
            keys, fps, sizes, prefixes, sketches = [], [], [], [], []
            for t in few(batch):
                key, own = near_set(t)
                keys.append(key)
                fps.append(signed(majority(own)))
                sizes.append(len(own))
                prefixes.append(near_prefix(own, common, rank).view(np.int64))
                sketches.append(near_sketch(own))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(np.concatenate([*sketches, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), prefix, sketch], ["doc_id", "text_key", "fp", "n", "prefix", "sketch"])

    schema = T.StructType([source.schema["doc_id"], *T._parse_datatype_string("text_key binary, fp long, n int, prefix array<long>, sketch array<long>")])
    rows = Scratch(spark)
    with small_batches(spark):
        every = rows.written(source.mapInArrow(given_back(run), schema), "near-rows")
    made = written(every.select("doc_id", "text_key"), "near-keys")
    distinct = every.groupBy("text_key").agg(F.min("doc_id").alias("id"), *[F.any_value(c).alias(c) for c in ("fp", "n", "prefix", "sketch")])
    distinct = scratch.written(distinct.select("text_key", F.xxhash64("text_key").alias("t"), "id", "fp", "n", "prefix", "sketch"), "near-distinct")
    rows.drop()

    shared = scratch.written(_under_one_shingle(distinct, scratch), "near-shared")
    alike = _alike(distinct, scratch)
    met = alike.unionByName(shared.where("center is not null").select(F.col("t").alias("a"), F.col("center").alias("b")))
    first_links = _verified(met, distinct, source, scratch)
    same_id = distinct.groupBy("id").agg(F.min("t").alias("b"), F.max("t").alias("m")).where("id is not null and b <> m").drop("m")
    same_id = distinct.join(same_id, "id").select(F.col("t").alias("a"), "b")
    grouped = scratch.written(components(first_links.unionByName(same_id)), "near-grouped")

    named = shared.drop("center").join(grouped.withColumnRenamed("node", "t"), "t", "left").withColumn("group", F.coalesce("component", "t")).drop("component")
    mixed = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("others")).where("lo <> hi")
    one = scratch.written(named.join(mixed.select("key", (F.col("others") > CROWDED).alias("crowded")), "key"), "near-mixed")
    crowded = scratch.written(one.where("crowded").join(distinct.select("t", "sketch"), "t"), "near-crowded")
    together = (F.col("x.key") == F.col("y.key")) & (F.col("x.t") < F.col("y.t")) & (F.col("x.group") != F.col("y.group"))
    together &= _possible(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
    pairs = lambda rows, near: rows.alias("x").join(rows.alias("y"), near).select(F.col("x.t").alias("a"), F.col("y.t").alias("b"))
    met = pairs(one.where("not crowded"), together).unionByName(pairs(crowded, together & _alike_sketches(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))))
    second_links = _verified(met, distinct, source, scratch)
    nodes = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second_links))

    classes = distinct.select("text_key", "t", "id").join(nodes, F.col("t") == F.col("node"), "left").select("text_key", "id", F.coalesce("component", "t").alias("group"))
    classes = scratch.written(classes, "near-classes")
    firsts = written(classes.join(classes.groupBy("group").agg(F.min("id").alias("first")), "group").select("text_key", "first", "group"), "near-firsts")
    scratch.drop()
    return made.join(firsts, "text_key", "left")


def _possible(n, at, m, other):
    """Whether sets of n and m members that share the one at the place ``at`` and ``other`` can reach the similarity: by their sizes, and by what is left from there on."""
    p, q = NEAR_SIMILARITY
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & _enough(F.least(n - at, m - other), n, m)


def _under_one_shingle(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, t, n, at, center) of the texts that share a shingle of their prefixes with another; center: one of those, if it can be near this text.

    The centers of a shingle are summed up before the shuffle and joined to its texts, so
    that a shingle of very many texts is gathered nowhere.
    """
    held = distinct.select("t", "n", F.posexplode("prefix").alias("at", "key"))
    turned = lambda x: x.bitwiseXOR(F.shiftleft(F.pmod("key", F.lit(NEAR_CENTERS)), 62))  # noqa: E731  t is a hash: its order, by quarters
    center = F.min(F.struct(turned(F.col("t")).alias("h"), "n", "at"))
    centers = held.groupBy("key").agg(F.count("*").alias("others"), center.alias("c")).where("others > 1")
    centers = centers.select("key", F.struct(turned(F.col("c.h")).alias("t"), "c.n", "c.at").alias("c"))
    shared = held.join(scratch.written(centers, "near-centers"), "key")
    met = (F.col("t") != F.col("c.t")) & _possible(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"))
    return shared.select("key", "t", "n", "at", F.when(met, F.col("c.t")).alias("center"))


def _alike(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): texts of one fingerprint, each with the first of them, and the first ones of fingerprints that link."""
    firsts = scratch.written(distinct.groupBy("fp").agg(F.min("t").alias("f")), "near-fingerprints")
    same = distinct.select("t", "fp").join(firsts, "fp").where("t <> f").select(F.col("t").alias("a"), F.col("f").alias("b"))
    near = scratch.written(links(firsts.select(F.col("fp").alias("id"), "fp"), bands(), MOST_BITS), "near-fingerprint-links")
    for side in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(side), F.col("f").alias(f"{side}_t")), side)
    return same.unionByName(near.select(F.col("a_t").alias("a"), F.col("b_t").alias("b")))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
