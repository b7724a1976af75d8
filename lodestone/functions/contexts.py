"""The contexts of identifiers in trees of whole documents, on arrays of all identifiers at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .walks import whole_documents

SCHEMA = pa.schema([("whole", pa.bool_()), ("tokens", pa.list_(pa.string())), ("n", pa.int64())])


def alike(part: pa.Table) -> pa.RecordBatch:
    """(whole, tokens, n): how many contexts, and how many ``whole`` documents, have the same identifiers; a document's count once each."""
    if part["node_id"].null_count:
        raise ValueError("a node without number")
    document, ids = np.cumsum(part["starts"].to_numpy()) - 1, part["node_id"].to_numpy()
    token = pc.fill_null(part["token"], "").combine_chunks().dictionary_encode()
    token = token.combine_chunks() if isinstance(token, pa.ChunkedArray) else token
    code, ancestors = token.indices.to_numpy(), part["ancestors"].combine_chunks()
    size = pc.list_value_length(ancestors).fill_null(0).to_numpy(zero_copy_only=False)
    above, of = ancestors.flatten().to_numpy(), np.repeat(np.arange(len(ids)), size)
    rank, at = np.unique(np.concatenate([ids, above]), return_inverse=True)
    own, up = document * len(rank) + at[: len(ids)], document[of] * len(rank) + at[len(ids) :]
    named = np.flatnonzero(own[np.minimum(np.searchsorted(own, up), len(own) - 1)] == up)  # rows are in the order of documents and numbers
    nearest = np.full(len(ids), -1)
    below = size > 0
    nearest[below] = up[(np.cumsum(size) - size)[below]]  # the root, but for those with an identifier above, of which the last counts
    last = np.flatnonzero(np.concatenate([of[named][1:] != of[named][:-1], [True]])) if len(named) else named
    nearest[of[named[last]]] = up[named[last]]
    second = (nearest >= 0) & (nearest != own)
    found: Counter[tuple[bool, bytes]] = Counter()
    once = np.unique(document << 32 | code.astype(np.int64))
    for whole, key, codes in ((False, np.concatenate([own, nearest[second]]), np.concatenate([code, code[second]])), (True, once >> 32, once & 0xFFFFFFFF)):
        order = np.lexsort((codes, key))
        key, codes = key[order], codes[order].astype(np.int32)
        ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        found.update((whole, codes[a:b].tobytes()) for a, b in zip([0, *ends], ends))
    flat = np.frombuffer(b"".join(c for _, c in found), np.int32)
    offsets = np.cumsum([0, *(len(c) // 4 for _, c in found)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), token.dictionary.take(pa.array(flat)))
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), tokens, pa.array(list(found.values()), pa.int64())], schema=SCHEMA)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_documents(batches):
        yield alike(part)
