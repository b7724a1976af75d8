"""Byte-level BPE by replaying the merges over the words of many texts at once instead of text by text.

A task takes its share of the corpus in portions of some megabytes. Texts are cut by the byte-level pattern into words; the
distinct words of a portion that the task has not met are laid out, block by block, as one row of parts, bytes at first. An inverted index
has, for the rank of each pair that can merge, the positions of the pair; the ranks wait in a heap. The least
rank is replayed at all its positions, left to right; each merge looks up only the pairs with its two
neighbours and enters them in the index. A merge may make a pair of a lower rank than its own: the rest of that
word then waits for the lower rank. Texts are put together from the ids of their words.

A word that is itself a token has that token's id, as in the library. Nothing is shuffled or written: most words are rare, and
to bring the words of all portions together cost more than to replay them (figures in the README). ``PORTION``, ``BLOCK`` and
``KNOWN_MOST`` bound what a task holds; a longer text is a portion of its own.

Edge cases: a null text is the empty text, without ids; texts of special tokens are ordinary text; a null doc_id and equal
rows pass through; an empty table gives no rows; other columns are not read; a long run without a blank is one word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import PATTERN, PLAIN_BELOW, digests, plain_pattern
from .common import ship, slices, table, texts

#: Characters of the texts of a portion, bytes of the words that are replayed together, and bytes of words that a task keeps the ids of.
PORTION, BLOCK, KNOWN_MOST = 4 << 20, 4 << 20, 4 << 20
ID = 32
NONE = -1


class Merges:
    """The ranks of a vocabulary: token bytes to id, which is the rank."""

    def __init__(self, source: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.spelt = {r: t for t, r in self.ranks.items()}
        # two tokens that follow each other merge if they spell a token together
        get = self.ranks.get
        pairs = [(a << ID | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        pairs.sort()
        self.codes, self.made = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        self.codes_of: dict[int, list[int]] = {}
        for code, r in pairs:
            self.codes_of.setdefault(r, []).append(code)
        # tokens that can be part of one of a lower rank
        highest = np.maximum(self.codes >> ID, self.codes & (1 << ID) - 1)
        self.early = set(highest[highest > self.made].tolist())

    def replayed(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian numbers of 32 bits."""
        whole = [self.ranks.get(w) for w in words]
        found = iter(self._replay([w for w, r in zip(words, whole) if r is None]))
        return [next(found) if r is None else r.to_bytes(4, "little") for r in whole]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        after[ends[lengths > 0] - 1], before[(ends - lengths)[lengths > 0]] = NONE, NONE
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(at: np.ndarray) -> None:
            """The positions whose pairs can merge, by rank."""
            codes = ids[at] << ID | ids[after[at]]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[place] == codes if len(self.codes) else np.zeros(len(at), bool)
            at, ranks = at[hit], self.made[place[hit]]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(at, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(part)

        enter(np.flatnonzero(after != NONE))
        while waiting:
            rank = heapq.heappop(waiting)
            at = np.unique(np.concatenate(index.pop(rank)))
            right = after[at]
            # a neighbour's merge may have taken either part
            there = (ids[at] != NONE) & (right != NONE)
            at, right = at[there], right[there]
            codes, (one, *more) = ids[at] << ID | ids[right], self.codes_of[rank]
            there = codes == one
            for code in more:
                there |= codes == code
            at, right = at[there], right[there]
            if len(at) > 1 and rank in self.early:
                word = np.searchsorted(ends, at, "right")
                first = np.append(True, word[1:] != word[:-1])
                if not first.all():  # what the first merge of a word makes may go before the others
                    index[rank] = [at[~first]]
                    heapq.heappush(waiting, rank)
                    at, right = at[first], right[first]
            elif len(at) > 1 and (touch := np.append(False, at[1:] == right[:-1])).any():
                heads = np.flatnonzero(~touch)  # of pairs in a row that share parts every second one merges
                nth = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                at, right = at[nth % 2 == 0], right[nth % 2 == 0]
            if not len(at):
                continue
            next_ = after[right]
            ids[at], ids[right], after[at] = rank, NONE, next_
            there = next_ != NONE
            before[next_[there]] = at[there]
            left = before[at]
            enter(np.concatenate([left[left != NONE], at[there]]))
        there = ids != NONE
        packed = ids[there].astype("<i4").tobytes()
        stops = (4 * np.append(0, np.cumsum(there))[ends]).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *stops], stops)]


class Numbers(dict):
    """Distinct words, numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Packed ids and decoded bytes of words, replayed when a portion first holds them."""

    def __init__(self, merges: Merges):
        self.merges, self.known, self.size = merges, {}, 0

    def of(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian numbers of 32 bits, the bytes that they decode to) of distinct words."""
        known, spelt = self.known, self.merges.spelt.__getitem__
        new = [w for w in words if w not in known]
        if self.size > KNOWN_MOST:
            known = {w: known[w] for w in words if w in known}
            self.size = sum(map(len, known))
        raw = [w.encode() for w in new]
        block = np.cumsum([len(w) for w in raw]) // BLOCK
        cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(raw)]):
            for word, ids in zip(new[lo:hi], self.merges.replayed(raw[lo:hi])):
                known[word] = ids, b"".join(map(spelt, memoryview(ids).cast("i")))
        self.known, self.size = known, self.size + sum(map(len, raw))
        return list(map(known.__getitem__, words))


def encode(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, input_ids array<int>, decoded binary of every row; ``vocabulary`` is the content of a file of ranks."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)  # a file of the vocabulary's size, whatever the data's
    source = texts(docs)
    schema = T.StructType([source.schema["doc_id"]]).add("input_ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plain, full = Words(Merges(sent.value)), plain_pattern().findall, regex.compile(PATTERN).findall
        for batch in batches:
            for lo, hi in slices(batch.column(1), PORTION):
                numbers, places = Numbers(), []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    found = (plain if text.isascii() or ord(max(text)) < PLAIN_BELOW else full)(text)
                    places.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                made = words.of(list(numbers))
                sizes = np.array([len(ids) // 4 for ids, _ in made], np.int64)
                order = np.concatenate(places)
                values = np.frombuffer(b"".join([made[k][0] for k in order.tolist()]), "<i4")
                ends = np.append(0, np.cumsum([len(x) for x in places]))
                tokens = np.append(0, np.cumsum(sizes[order]))[ends]
                ids = pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(values, pa.int32()))
                back = [b"".join([made[k][1] for k in x.tolist()]) for x in places]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, pa.array(back, pa.binary())], ["doc_id", "input_ids", "decoded"])
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def vocabulary_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary_file()))
