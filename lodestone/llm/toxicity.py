"""Toxicity by compression distance.

A Zstandard dictionary of toxic text and a separate one of ordinary text are made from
labelled rows; a text is cut into windows of ``WINDOW`` words, each window is
compressed with either, and the lengths are compared. What the toxic one saves in a text's
windows goes into a logistic calibration, fitted on folds whose dictionaries
have not seen them.

A window is spelt with every byte ``SPELL`` times. A match costs some bytes however long it
is, so in windows of a few bytes it would hardly be shorter than the letters themselves; spelt
this way a word that a dictionary holds stands out. Windows of one word keep the figures of a window free
of what stands beside it; figures of windows that recur are kept by the task.

Each dictionary holds the phrases (words, and beginnings of words) that tell its class from the other,
the most telling last, where a match costs least. (The library's own trainer takes the most
frequent segments; in toxic text that is ordinary text. Its dictionaries had an area under the curve of 0.60 to 0.84 in trials.)
Near copies count once: of texts that share their smallest shingle hash a phrase is counted in one.

Training takes a bounded sample: the labelled rows with the smallest id hashes,
at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` of them. Scoring covers all rows
and whole texts.

Edge cases: a null text is the empty text and is scored like any other; if the
training rows lack one of the two labels, every score is 0; null labels are
not used, and several labels of one id count as the highest.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table, texts

SAMPLE_TOXIC, SAMPLE_ORDINARY = 2_000, 4_000
WINDOW, SPELL, LEVEL = 1, 3, 15
CACHE_MOST = 500_000
TOXIC_BYTES, ORDINARY_BYTES = 2_048, 16_384
#: A phrase goes into the toxic dictionary if it is so many times as frequent there, with so large a log-likelihood ratio.
RATIO, EVIDENCE = 3.0, 25.0
#: Beginnings of words of so many bytes compete with whole words.
STEMS = range(4, 8)
STEPS = np.arange(2, 24)
THRESHOLD = 0.7


def windows(text: str) -> list[bytes]:
    words = text.encode(errors="replace").lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


def spelt(raw: bytes) -> bytes:
    return np.repeat(np.frombuffer(raw, np.uint8), SPELL).tobytes()


def phrases(text: str) -> set[bytes]:
    """Whole words between blanks, and the beginnings of longer ones."""
    words = set(text.encode(errors="replace").lower().split())
    return {b" " + w + b" " for w in words} | {b" " + w[:k] for w in words for k in STEMS if len(w) > k}


def copies(text: str) -> int:
    """A number that near copies mostly share: the smallest hash of their shingles of five words."""
    words = text.encode(errors="replace").lower().split()
    return min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))


def dictionary_content(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): the phrases of each class, the most telling and the most frequent last."""
    groups: dict[tuple[int, int], set[bytes]] = {}
    for text, toxic in rows:
        groups.setdefault((toxic, copies(text)), set()).update(phrases(text))
    seen, n = (Counter(), Counter()), [0, 0]
    for (toxic, _), own in groups.items():
        seen[toxic].update(own)
        n[toxic] += 1

    def evidence(word: bytes) -> float:
        a, b = seen[1][word], seen[0][word]
        p = (a + b) / (n[0] + n[1])
        return 2 * (a * math.log(a / (n[1] * p)) + (b * math.log(b / (n[0] * p)) if b else 0))

    ratio = lambda w: (seen[1][w] + 0.5) / (n[1] + 1) * (n[0] + 1) / (seen[0][w] + 0.5)
    telling = {w: e for w, a in seen[1].items() if a >= 2 and ratio(w) >= RATIO and (e := evidence(w)) >= EVIDENCE}
    toxic, room = [], TOXIC_BYTES
    for w in sorted(telling, key=lambda w: (-telling[w], w)):
        if room >= len(w) and not any(w in x for x in toxic):
            toxic.append(w)
            room -= len(w)
    common = (w for w, b in seen[0].items() if b >= 2 and w.endswith(b" ") and ratio(w) < 1)
    ordinary = b"".join(sorted(common, key=lambda w: (seen[0][w], w)))
    return b"".join(reversed(toxic)), ordinary[-ORDINARY_BYTES:]


class Distances:
    """Compressors with either dictionary, and what the toxic one saved lately."""

    #: The last one of this process: what it knows serves the tasks that follow in it.
    last: tuple[tuple[bytes, bytes], "Distances"] | None = None

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.known: dict[bytes, int] = {}

    @classmethod
    def of(cls, content: tuple[bytes, bytes]) -> "Distances":
        if cls.last is None or cls.last[0] != content:
            cls.last = content, cls(*content)
        return cls.last[1]

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(spelt(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def saved(self, window: bytes) -> int:
        """By how many bytes the window is shorter with the toxic dictionary than with the ordinary one."""
        if (found := self.known.get(window)) is None:
            if len(self.known) >= CACHE_MOST:
                self.known.clear()
            raw = spelt(window)
            self.known[window] = found = len(self.ordinary(raw)) - len(self.toxic(raw))
        return found

    def features(self, text: str) -> list[float]:
        saved = np.sort(np.array(list(map(self.saved, windows(text))), np.float64))
        over = (saved[:, None] >= STEPS).sum(0)
        return [min(saved[-1], 30) / 4, min(saved[-3:].sum(), 60) / 10, *np.log1p(over), *np.log1p(30 * over / len(saved)), np.log1p(len(saved)), saved.mean(), saved[0]]


class Model:
    """Dictionaries and the calibration; small enough for any broadcast (under 20 kB)."""

    def __init__(self, rows: list[tuple[int, str, int]], share: float | None = None):
        """share: of toxic rows among all labelled ones, where ``rows`` holds them in other parts."""
        self.content, self.weights = None, None
        labels = {x for *_, x in rows}
        if labels != {0, 1}:
            return
        fold = lambda doc_id: zlib.crc32(str(doc_id).encode()) // 3 % 2
        x, y = [], []
        for k in (0, 1):
            seen = [(t, x) for i, t, x in rows if fold(i) != k]
            own = [(t, x) for i, t, x in rows if fold(i) == k]
            if {x for _, x in seen} == {0, 1} and own:
                distances = Distances(*dictionary_content(seen))
                x += [distances.features(t) for t, _ in own]
                y += [label for _, label in own]
        self.content = dictionary_content([(t, x) for _, t, x in rows])
        if not x:
            distances = Distances(*self.content)
            x, y = [distances.features(t) for _, t, _ in rows], [label for *_, label in rows]
        self._calibrate(np.array(x), np.array(y, float))
        if share is not None and 0 < share < 1:
            here = sum(label for *_, label in rows) / len(rows)
            self.weights[0] += math.log(share / (1 - share)) - math.log(here / (1 - here))

    def _calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        penalty = ridge * np.r_[0.0, np.ones(len(w) - 1)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
        self.weights = w

    def scorer(self):
        if self.weights is None:
            return lambda text: 0.0
        distances = Distances.of(self.content)

        def score(text: str) -> float:
            z = (np.array(distances.features(text)) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))

        return score


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    least = lambda x, n: known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = least(1, SAMPLE_TOXIC).unionByName(least(0, SAMPLE_ORDINARY))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    share = known.agg(F.avg("toxic")).first()[0]
    return Model(sorted((r.doc_id, r.text, r.toxic) for r in rows), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every row's whole text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for batch in batches:
            values = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    source = texts(docs)
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
