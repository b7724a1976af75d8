"""Biased walks over the trees of whole documents, on arrays of all nodes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

#: Nodes, and walks, that are worked on at once; a document with more nodes is one part all the same.
NODES_AT_ONCE, WALKS_AT_ONCE = 20_000, 100_000
SCHEMA = pa.schema([("token", pa.string()), ("document", pa.string()), ("value", pa.int64())])


def whole_documents(batches: Iterator[pa.RecordBatch], least: int = NODES_AT_ONCE) -> Iterator[pa.Table]:
    """Parts of at least ``least`` rows that end where a document does; ``starts`` marks a document's first row."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        starts = np.flatnonzero(batch.column("starts").to_numpy(zero_copy_only=False))
        if n >= least and len(starts):
            rest = batch.num_rows - starts[-1]
            held[-1] = batch.slice(0, starts[-1])
            if n > rest:
                yield pa.Table.from_batches(held)
            held, n = [batch.slice(starts[-1])], rest
    if n:
        yield pa.Table.from_batches(held)


class Trees:
    """The trees of a part as arrays: what is near a node are its children by number, then its parent."""

    def __init__(self, part: pa.Table):
        starts = part["starts"].to_numpy()
        self.documents = part["document"].filter(part["starts"]).combine_chunks()
        if part["node_id"].null_count:
            raise ValueError("a node without a number")
        ids, above = part["node_id"].to_numpy(), part["parent_id"]
        has, above = above.is_valid().to_numpy(), above.fill_null(0).to_numpy()
        kinds = part["internal_type"].combine_chunks().dictionary_encode()
        kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
        #: Names of types; a node without one has the number behind the last.
        self.names = [*kinds.dictionary.to_pylist(), None]
        kind = kinds.indices.fill_null(len(self.names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        document = np.cumsum(starts) - 1
        rank, at = np.unique(np.concatenate([ids, above]), return_inverse=True)
        key, up = document * len(rank) + at[: len(ids)], document * len(rank) + at[len(ids) :]
        first = np.concatenate([[True], key[1:] != key[:-1]])  # rows are in the order of documents and numbers
        known, row = key[first], np.cumsum(first) - 1
        #: The node that each row of the part is.
        self.row = row
        self.document, self.ids, self.kind = document[first], ids[first], kind[first]
        place = np.minimum(np.searchsorted(known, up), len(known) - 1)
        below = has & (known[place] == up)
        self.children = row[below][np.argsort(place[below], kind="stable")]
        self.n_children = np.bincount(place[below], minlength=len(known))
        self.begin = np.cumsum(self.n_children) - self.n_children
        self.parent = np.where(below, place, -1)[first]
        self.degree = self.n_children + ((self.parent >= 0) & (self.kind[self.parent] < len(self.names) - 1))

    def neighbour(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        child = k < self.n_children[at]
        out = self.parent[at]
        out[child] = self.children[self.begin[at[child]] + k[child]]
        return out


def drawn(texts: list[bytes], which: np.ndarray, what: str) -> np.ndarray:
    """Numbers below 2^32, of the texts with ``what`` behind."""
    end = what.encode()
    return np.frombuffer(b"".join([md5(texts[i] + end).digest() for i in which.tolist()]), ">u4")[::4].astype(np.int64)


def paths(trees: Trees, nodes: np.ndarray, walk: int, p: float, q: float, n_steps: int, seed: int) -> np.ndarray:
    """The types that walks from ``nodes`` meet, a row for each step. Where only one way leads on, nothing is drawn."""
    names = [f"{seed}/" if d is None else f"{seed}/{d}/" for d in trees.documents.take(pa.array(trees.document[nodes])).to_pylist()]
    texts = [f"{d}{i}/{walk}/".encode() for d, i in zip(names, trees.ids[nodes].tolist())]
    at = before = nodes
    out = [trees.kind[at]]
    for step in range(1, n_steps):
        degree, to = trees.degree[at], at.copy()
        some = degree > 0
        to[some] = trees.neighbour(at[some], np.zeros(some.sum(), np.int64))
        drawing = np.flatnonzero((degree > 1) | ((degree == 1) & (step > 1) & (to != before)))
        if step > 1:
            back = (1 / p) / ((1 / p) + trees.n_children[at[drawing]] / q)
            returns = drawn(texts, drawing, f"{step}/back") / 4294967296.0 < back
            to[drawing[returns]] = before[drawing[returns]]
            drawing = drawing[~returns]
        to[drawing] = trees.neighbour(at[drawing], drawn(texts, drawing, f"{step}/next") % degree[drawing])
        before, at = at, to
        out.append(trees.kind[at])
    return np.stack(out)


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their ``n``."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def grams(part: pa.Table, lengths: tuple[int, ...], p: float, q: float, n_walks: int, n_steps: int, seed: int, stride: int, separator: str) -> pa.RecordBatch:
    """(token, document, value) of a part."""
    trees = Trees(part)
    tokens: dict[str, int] = {}
    cells, base = [], len(trees.names)
    for walk in range(n_walks):
        for begin in range(0, len(trees.ids), WALKS_AT_ONCE):
            nodes = np.arange(begin, min(begin + WALKS_AT_ONCE, len(trees.ids)))
            path, document = paths(trees, nodes, walk, p, q, n_steps, seed), trees.document[nodes]
            for n in (n for n in lengths if n <= n_steps):
                at = range(0, n_steps - n + 1, stride)
                code = np.concatenate([path[i] for i in at])
                kinds = [(k,) for k in range(base)]
                for j in range(1, n):
                    code, kinds = shortened(code * base + np.concatenate([path[i + j] for i in at]), kinds, base)
                texts = [separator.join(trees.names[k] for k in ks if trees.names[k] is not None) for ks in kinds]
                number = np.array([tokens.setdefault(t, len(tokens)) for t in texts], np.int64)
                found, many = np.unique(np.tile(document, len(at)) << 32 | number[code], return_counts=True)
                cells.append((found, many))
    keys, value = counted(np.concatenate([k for k, _ in cells]), np.concatenate([n for _, n in cells]))
    token = pa.array(list(tokens), pa.string()).take(pa.array(keys & 0xFFFFFFFF))
    return pa.RecordBatch.from_arrays([token, trees.documents.take(pa.array(keys >> 32)), pa.array(value)], schema=SCHEMA)


def shortened(code: np.ndarray, kinds: list[tuple], base: int) -> tuple[np.ndarray, list[tuple]]:
    """Numbers of the sequences that occur, and the sequences; ``code`` is one of ``kinds`` times ``base``, and the next type."""
    if len(kinds) * base <= 1 << 20:
        there = np.flatnonzero(np.bincount(code, minlength=len(kinds) * base))
        number = np.zeros(len(kinds) * base, np.int64)
        number[there] = np.arange(len(there))
        code = number[code]
    else:
        there, code = np.unique(code, return_inverse=True)
    return code, [(*kinds[c // base], c % base) for c in there.tolist()]


def bag(**options) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_documents(batches):
            yield grams(part, **options)

    return run
