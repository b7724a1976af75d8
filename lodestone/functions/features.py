"""Identifiers, graphlets and numbers of children in trees of whole documents, counted on arrays of all nodes at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .walks import Trees, whole_documents

HAS = pa.struct([("kind", pa.string()), ("token", pa.string()), ("n_children", pa.int64()), ("n", pa.int64())])
SCHEMA = pa.schema([("document", pa.string()), ("alike", pa.string()), ("has", pa.list_(HAS))])


def graphlets(trees: Trees) -> tuple[np.ndarray, list[str]]:
    """The graphlet of each node, as a number, and their texts: the parent's type, the own one and the children's in order."""
    order = sorted(range(len(trees.names)), key=lambda k: (trees.names[k] is None, trees.names[k] or ""))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))  # that of no type is the last
    none = len(order) - 1
    kind = rank[trees.kind]
    up = np.where(trees.parent >= 0, kind[trees.parent], none).astype(np.int32)
    parent = np.repeat(np.arange(len(kind)), trees.n_children)  # children lie by parent
    below = kind[trees.children]
    below = below[np.lexsort((below, parent))].astype(np.int32)
    number: dict[tuple[int, int, bytes], int] = {}
    keys = zip(up.tolist(), kind.tolist(), trees.begin.tolist(), trees.n_children.tolist())
    found = np.array([number.setdefault((a, b, below[at : at + n].tobytes() if n else b""), len(number)) for a, b, at, n in keys], np.int64)
    name = [trees.names[k] for k in order]
    texts = ["_".join(t for t in ("None" if a == none else name[a], name[b], *(name[c] for c in np.frombuffer(kinds, np.int32).tolist())) if t is not None) for a, b, kinds in number]
    return found, texts


def features(part: pa.Table) -> pa.RecordBatch:
    """A row for each document, with the digest of what it has; what that is, for the first document of those alike."""
    trees = Trees(part)
    documents = np.cumsum(part["starts"].to_numpy()) - 1
    named = part["identifier"].to_numpy()
    token = pc.fill_null(part["token"], "").combine_chunks().dictionary_encode()
    token = token.combine_chunks() if isinstance(token, pa.ChunkedArray) else token
    code, texts = graphlets(trees)
    pairs, children = np.unique(trees.kind[trees.row] << 32 | trees.n_children[trees.row], return_inverse=True)
    known = [("id", t, None) for t in token.dictionary.to_pylist()] + [("graphlet", t, None) for t in texts]
    known += [("children", trees.names[k >> 32], k & 0xFFFFFFFF) for k in pairs.tolist()]
    order = sorted(range(len(known)), key=lambda k: repr(known[k]))
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    begin = len(token.dictionary), len(token.dictionary) + len(texts)
    code = np.concatenate([token.indices.to_numpy().astype(np.int64)[named], code + begin[0], children + begin[1]])
    keys, n = np.unique(np.concatenate([documents[named], trees.document, documents]) << 32 | rank[code], return_counts=True)
    cells, cell = np.unique((keys & 0xFFFFFFFF) << 32 | n, return_inverse=True)
    cell = cell.astype(np.int32)
    what = [(*known[order[c >> 32]], c & 0xFFFFFFFF) for c in cells.tolist()]
    said = [repr(w).encode() for w in what]
    ends = np.cumsum(np.bincount(keys >> 32, minlength=len(trees.documents))).tolist()
    seen: dict[bytes, str] = {}
    digests, lists = [], []
    for a, b in zip([0, *ends], ends):
        own = cell[a:b].tobytes()
        lists.append(None if own in seen else cell[a:b])
        if own not in seen:
            seen[own] = blake2b(b"".join([said[c] for c in cell[a:b].tolist()]), digest_size=16).hexdigest()
        digests.append(seen[own])
    size = [0 if x is None else len(x) for x in lists]
    flat = np.concatenate([x for x in lists if x is not None])
    columns = [pa.array([w[k] for w in what], t).take(pa.array(flat)) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
    offsets = pa.array(np.cumsum([0, *size]), pa.int32(), mask=np.array([*(x is None for x in lists), False]))
    has = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(HAS)))
    return pa.RecordBatch.from_arrays([trees.documents, pa.array(digests), has], schema=SCHEMA)


def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_documents(batches):
        yield features(part)
