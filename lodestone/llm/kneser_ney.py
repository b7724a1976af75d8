"""What both Kneser-Ney models share: discounts, and sorted hash arrays in files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .common import mapped, put_bytes

MIX = np.uint64(0x9E3779B97F4A7C15)


def discounts(n1, n2, n3, n4) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x or 0) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratio = lambda a, b: b / a if a and b else 0.5
    d = (1 - 2 * y * ratio(n1, n2), 2 - 3 * y * ratio(n2, n3), 3 - 4 * y * ratio(n3, n4))
    return tuple(min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1))


def discount_columns():
    """The same as columns, from columns n1 to n4 of a counts-of-counts row."""
    n = [F.col(f"n{k}").cast("double") for k in range(1, 5)]
    y = F.when((n[0] > 0) & (n[1] > 0), n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
    ratio = lambda a, b: F.when((a > 0) & (b > 0), F.try_divide(b, a)).otherwise(0.5)
    return [F.least(F.greatest(F.lit(k) - F.lit(k + 1) * y * ratio(n[k - 1], n[k]), F.lit(0.1)), F.lit(k - 0.1)).alias(f"d{k}") for k in (1, 2, 3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over the whole range."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class HashArrays:
    """Sorted 64-bit keys and their values, in files by the keys' leading bits, memory-mapped where they are read."""

    def __init__(self, uri: str, bits: int, columns: dict[str, str]):
        self.uri, self.bits, self.columns, self._open = uri, bits, columns, {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def save(self, shard: int, keys: np.ndarray, **values: np.ndarray) -> None:
        order = np.argsort(keys)
        put_bytes(f"{self.uri}/{shard}.key", keys[order].astype("<u8").tobytes())
        for name, kind in self.columns.items():
            put_bytes(f"{self.uri}/{shard}.{name}", values[name][order].astype(kind).tobytes())

    def _files(self, shard: int):
        if shard not in self._open:
            keys = mapped(f"{self.uri}/{shard}.key", "<u8")
            self._open[shard] = keys if keys is None else (keys, {n: mapped(f"{self.uri}/{shard}.{n}", k) for n, k in self.columns.items()})
        return self._open[shard]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(whether each key is there, the values; 0 where it isn't)."""
        order = np.argsort(keys)
        asked = keys[order]
        there = np.zeros(len(keys), bool)
        out = {n: np.zeros(len(keys), k) for n, k in self.columns.items()}
        shards = self.shard(asked)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1)) if len(asked) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(asked)]):
            if not (files := self._files(int(shards[lo]))):
                continue
            own, values = files
            at = np.minimum(np.searchsorted(own, asked[lo:hi]), len(own) - 1)
            hit = own[at] == asked[lo:hi]
            to = order[lo:hi][hit]
            there[to] = True
            for n in self.columns:
                out[n][to] = values[n][at[hit]]
        return there, out
