"""License scan: MinHash bands retrieve templates, exact containment verifies.

Texts are cut into overlapping windows of words. A window and a template are sets of
word shingles; the MinHash signature of each is cut into bands, and a window is
a candidate for a template if the two agree in a band. Templates of one length class
are compared with windows of that length, so that a window around a copy is nearly
the template itself. With ``BANDS`` bands of ``ROWS`` rows a window of similarity s is
retrieved with probability 1 - (1 - s^ROWS)^BANDS: over 0.999 from s = 0.5 on. A candidate is
reported if the share of the template's shingles in the window is at least
``CONTAINED``.

Windows step by a quarter of their length: of some window a copy fills four fifths,
which gives a similarity of over 0.5 even if a word of it was changed. Each template, built in or
passed, has a gate: so many of its own shingles that whatever holds ``CONTAINED`` of them holds one
of the gate. Only windows with a shingle of a gate are hashed; the others cannot reach the containment.

The templates are the whole license texts of ``license_texts`` and the short notices and grants below, or any others that are passed.
They are a parameter of bounded size and are sent to the tasks as such. Of matches that overlap the one with the most
shingles stays, so a whole text goes before the grant that it holds.

Edge cases: a null or empty text has no matches; templates of fewer words than a shingle
are compared as one shingle; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table, texts
from .license_texts import WHOLE

BANDS, ROWS = 64, 3
SHINGLE = 2
CONTAINED = 0.8
WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

#: What public licenses ask to be written, shortened to the words that tell them apart.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL notice": "This work is licensed under the GNU Lesser General Public License",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC BY 4.0 notice": "Licensed under CC BY 4.0.",
    "CC BY-SA 4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense grant": "This is free and unencumbered software released into the public domain.",
    "All rights reserved": "All rights reserved.",
}


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or [" ".join(words)] * bool(words)


def gate(own: set[str]) -> list[str]:
    """The longest shingles of a template, one more than a text of ``CONTAINED`` of them can lack."""
    least = next(k for k in range(len(own) + 1) if k / len(own) >= CONTAINED)
    return sorted(own, key=lambda s: (-len(s), s))[: len(own) - least + 1]


class Matcher:
    def __init__(self, templates: dict[str, str]):
        rng = np.random.default_rng(11)
        self.a, self.b = rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.sets, self.words, self.by_size, self.gates = {}, {}, {}, {}
        for name, text in templates.items():
            words = WORDS.findall(text.lower())
            if not words:
                continue
            self.sets[name], self.words[name] = set(shingles(words)), set(words)
            for shingle in gate(self.sets[name]):
                self.gates.setdefault(shingle, set()).add(len(words))
            bands = self.by_size.setdefault(len(words), {})
            for band in self.bands(self.sets[name]):
                bands.setdefault(band, set()).add(name)

        self.firsts = {s.split()[0] for s in self.gates}

    def bands(self, own) -> list[tuple[int, bytes]]:
        h = np.array([xxhash.xxh64_intdigest(s) for s in own], np.uint64)
        with np.errstate(over="ignore"):
            low = ((h[:, None] * self.a + self.b) >> np.uint64(16)).min(0)
        return [(k, low[k * ROWS : (k + 1) * ROWS].tobytes()) for k in range(BANDS)]

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, containment) with offsets in code points: the best window of each run of overlapping ones."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words, near = WORDS.findall(low), {}
        for at, pair in enumerate(zip(words, [*words[1:], ""])):
            for shingle in (" ".join(pair), pair[0]) if pair[0] in self.firsts else ():
                for size in self.gates.get(shingle, ()):
                    near.setdefault(size, []).append(at)
        if not near:
            return []
        spans = [m.span() for m in WORDS.finditer(low)]
        found = []
        for name, windows in self.hits(words, near).items():
            best = None
            for i, j, share in [*windows, (1 << 60, 0, 0.0)]:
                if best and i >= best[1]:
                    lo, hi = best[0], best[1] - 1
                    while lo < hi and words[lo] not in self.words[name]:
                        lo += 1
                    while hi > lo and words[hi] not in self.words[name]:
                        hi -= 1
                    found.append((name, spans[lo][0], spans[hi][1], best[2]))
                    best = None
                if best is None or share > best[2]:
                    best = (i, j, share)
        out: list[tuple[str, int, int, float]] = []
        for f in sorted(found, key=lambda f: (-round(f[3] * len(self.sets[f[0]])), -f[3], f[1], f[0])):  # of overlapping ones the fullest
            if all(f[2] <= g[1] or f[1] >= g[2] for g in out):
                out.append(f)
        return sorted(out, key=lambda f: (f[1], f[0]))

    def starts(self, n: int, size: int, near: list[int]) -> list[int]:
        """Where windows of a size begin that hold the shingle at one of the places ``near``, in a text of n words."""
        step, starts = max(1, size // 4), set()
        for at in near:
            lo = max(0, at - size) // step * step
            starts.update(range(lo, min(at, n - 1) + 1, step))
            starts.add(max(0, min(at, n - size)))
        return sorted(starts)

    def hits(self, words: list[str], near: dict[int, list[int]]) -> dict[str, list[tuple[int, int, float]]]:
        """(start, end, containment) of the windows in which a template is contained, by its name."""
        hits: dict[str, list] = {}
        for size, bands in self.by_size.items():
            width = size + max(1, size // 4)
            for i in self.starts(len(words), size, near.get(size, [])):
                own = set(shingles(words[i : i + width]))
                for name in set().union(*(bands.get(b, ()) for b in self.bands(own))):
                    share = len(self.sets[name] & own) / len(self.sets[name])
                    if share >= CONTAINED:
                        hits.setdefault(name, []).append((i, min(i + width, len(words)), share))
        return hits


FIELDS = "template string, start int, end int, containment double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, template, start, end, containment): a row for each match."""
    ship(docs.sparkSession)
    own = WHOLE | TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(own)
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matcher.find(t)]
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "template", "start", "end", "containment"])

    source = texts(docs)
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *T._parse_datatype_string(FIELDS)]))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))
