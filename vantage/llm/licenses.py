"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

Templates and texts become words (lower case, ASCII punctuation as gaps) and
word shingles.  For every template length T the text is cut into overlapping
windows, so spaced that each occurrence spread over up to 2T shingles (words
put in between) lies whole in some window.  A window's MinHash signature is
cut into bands; a band equal to a template's retrieves the template for that
part of the text, and there the exact share of the template's shingles within
2T decides: matches are taken from left to right, each from its last possible
start to its last new shingle, and none overlaps another, so touching copies
count one by one.

Bands: an occurrence that keeps the share c of a template's T shingles lies
in a window of W shingles with similarity j >= cT / (W + (1 - c)T).
``bands_for`` chooses the number of bands so that such a window is retrieved
with probability 1 - (1 - j^rows)^bands >= GUARANTEE.

A minimum can only agree with a template's if the window holds one of the
template's shingles, so signatures are computed for those windows alone; no
other window can be retrieved.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col

SHINGLE, CONTAINMENT, ROWS, GUARANTEE, SEED = 3, 0.8, 2, 0.999, 5

# Fixed texts: notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                         "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                  "published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def stride_of(shingles: int) -> int:
    return max(1, shingles // 4)


def window_of(shingles: int) -> int:
    """Shingles of a window: twice the template's, and room for the step."""
    return 2 * shingles + stride_of(shingles) - 1


def bands_for(shingles: int, containment: float = CONTAINMENT, rows: int = ROWS, guarantee: float = GUARANTEE) -> int:
    """Bands that retrieve a window with the least similarity allowed with probability ``guarantee``."""
    window = window_of(shingles)
    kept = max(1, ceil(containment * shingles))
    j = kept / (window + shingles - kept)
    return 1 if j >= 1 else max(1, ceil(log(1 - guarantee) / log(1 - j ** rows)))


class Index:
    """Band tables of the templates, by template length."""

    def __init__(self, templates: dict[str, str] | None = None, k: int = SHINGLE, containment: float = CONTAINMENT, rows: int = ROWS, seed: int = SEED):
        self.k, self.rows, self.containment = k, rows, containment
        self.shingles: dict[str, set[bytes]] = {}
        self.sizes: dict[int, list[str]] = {}
        for name, text in (templates if templates is not None else TEMPLATES).items():
            w = words_of(text)
            got = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
            if not got:
                raise ValueError(f"{name}: fewer than {k} words")
            self.shingles[name] = set(got)
            self.sizes.setdefault(len(got), []).append(name)
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for s in self.shingles.values() for x in s for w in x.split()}), 1)}
        self.known = np.unique([self._code([self.vocabulary[w] for w in x.split()]) for s in self.shingles.values() for x in s]).astype(np.int64)
        self.bands = {t: bands_for(t, containment, rows) for t in self.sizes}
        rng = np.random.default_rng(seed)
        n = rows * max(self.bands.values(), default=1)
        self.mul, self.add = rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
        self.table: dict[tuple, list[str]] = {}
        for t, names in self.sizes.items():
            for name in names:
                for band in self._bands(np.array([self._hash(x) for x in self.shingles[name]], np.uint64), t):
                    self.table.setdefault((t, *band), []).append(name)

    def _code(self, ids: list[int]) -> int:
        code = 0
        for i in ids:
            code = code * (len(self.vocabulary) + 1) + i
        return code

    @staticmethod
    def _hash(x: bytes) -> int:
        return xxhash.xxh64_intdigest(x)

    def _bands(self, h: np.ndarray, t: int) -> list[tuple]:
        n = self.rows * self.bands[t]
        sig = (h[None, :] * self.mul[:n, None] + self.add[:n, None] >> np.uint64(20)).min(axis=1).tolist()
        return [(b, *sig[b * self.rows:(b + 1) * self.rows]) for b in range(self.bands[t])]

    def matches(self, text: str) -> list[tuple[str, int, int, float]]:
        """``(template, first word, end word, containment)`` of each match."""
        words = words_of(text)
        n = len(words) - self.k + 1
        if n <= 0:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        code, every = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(self.k):
            code = code * (len(self.vocabulary) + 1) + ids[i:n + i]
            every &= ids[i:n + i] > 0
        at = np.flatnonzero(every)
        hits = at[np.isin(code[at], self.known)] if len(at) else at
        if not len(hits):
            return []
        regions: dict[str, list[list[int]]] = {}  # of the windows that retrieve a template, overlapping ones joined
        for t in self.sizes:
            step, size = stride_of(t), window_of(t)
            starts = np.unique(np.concatenate([(hits // step - d) * step for d in range(-(-size // step) + 1)]))
            # a window with too few of any template's shingles cannot hold a match
            inside = np.searchsorted(hits, starts + size) - np.searchsorted(hits, starts)
            for a in starts[(starts > -size) & (starts < n) & (inside >= self.need(t))].tolist():
                a, b = max(a, 0), min(n, a + size)
                bands = self._bands(np.array([self._hash(b" ".join(words[i:i + self.k])) for i in range(a, b)], np.uint64), t)
                for name in {x for band in bands for x in self.table.get((t, *band), ())}:
                    held = regions.setdefault(name, [])
                    if held and a <= held[-1][1]:
                        held[-1][1] = max(held[-1][1], b)
                    else:
                        held.append([a, b])
        out = []
        for name, held in regions.items():
            own = self.shingles[name]
            for a, b in held:
                spots = [(i, x) for i in hits[np.searchsorted(hits, a):np.searchsorted(hits, b)].tolist() if (x := b" ".join(words[i:i + self.k])) in own]
                out += [(name, first, last + self.k, share) for first, last, share in self.spans(spots, len(own))]
        return sorted(out, key=lambda m: (m[1], m[0], m[2]))

    def need(self, shingles: int) -> int:
        return max(1, ceil(self.containment * shingles - 1e-9))

    def spans(self, spots: list[tuple[int, bytes]], shingles: int) -> list[tuple[int, int, float]]:
        """Disjoint ``(first, last, share)`` of the places ``spots`` of a template's shingles, each within twice its length."""
        need, out, left, k = self.need(shingles), [], 0, 0
        seen: dict[bytes, int] = {}

        def drop() -> None:
            x = spots[left][1]
            seen[x] -= 1
            if not seen[x]:
                del seen[x]

        while k < len(spots):
            at, x = spots[k]
            seen[x] = seen.get(x, 0) + 1
            while at - spots[left][0] >= 2 * shingles:
                drop()
                left += 1
            k += 1
            if len(seen) < need:
                continue
            while seen[spots[left][1]] > 1 or len(seen) > need:  # the last start that still holds enough
                drop()
                left += 1
            while k < len(spots) and spots[k][0] - spots[left][0] < 2 * shingles and spots[k][1] not in seen:
                seen[spots[k][1]] = 1
                k += 1
            out.append((spots[left][0], spots[k - 1][0], len(seen) / shingles))
            seen.clear()
            left = k
        return out


def found(text: Column, templates: dict[str, str] | None = None, k: int = SHINGLE, containment: float = CONTAINMENT) -> Column:
    """Struct ``n_matches, licenses, matches`` of a text column."""

    @F.pandas_udf("n_matches bigint, licenses string, matches string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, k, containment)
        for part in parts:
            rows = []
            for t in part:
                m = index.matches(t)
                rows.append((len(m), ",".join(sorted({x[0] for x in m})), ",".join(f"{x[0]}:{x[1]}:{x[2]}:{x[3]:.3f}" for x in m)))
            yield pd.DataFrame(rows, columns=["n_matches", "licenses", "matches"])

    return each(F.coalesce(text, F.lit("")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, k: int = SHINGLE,
                 containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: ``id_col, n_matches, licenses, matches`` (``template:first word:end word:containment``).

    No shuffle; the template index is a few hundred entries.  A null text is
    empty (no match); a null id stays null; repeated rows stay repeated; an
    empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    got = docs.select(col(id_col).alias("id"), found(col(text_col), templates, k, containment).alias("m"))
    return got.select(F.col("id").alias(id_col), "m.*")
