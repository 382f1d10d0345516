"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three transducers.  The *normaliser* maps white
space to the piece mark and puts one mark in front (identity on all else).
The *pieces* form a lexicon whose arcs read a piece's characters and write its
id.  The *byte fallback* reads one character that no piece knows and writes
the ids of its UTF-8 bytes.  An input is composed with them and the shortest
path in the tropical semiring (weights add along a path, the least path wins)
is the encoding.

Weights: a unigram model's arcs weigh minus the piece's score.  A merge (BPE)
model has no piece weights that add up to its result, so its transducer
carries the last piece as context: an arc from piece a to piece b weighs 0 if
the merges of the joined text a b end in exactly a, b, and infinity
otherwise.  Exactly one path stays finite, the merge result, and the state
reduces to the position, as one piece can end a finite path there.

The composition is done segment by segment.  No piece reads a mark after
another character, so every path of a whole text passes between them and the
shortest path of the text is the shortest paths of its segments in a row;
segments of common length are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col

MARK = "▁"
#: Bounds of the caches of a worker: segments and their length, pairs of pieces.
CACHE, CACHED_CHARS, CONTEXTS = 250_000, 32, 1_000_000
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER_DEFINED, _BYTE = 1, 2, 4, 6
_UNKNOWN_WEIGHT = 1e6


class Transducer:
    """Compiled model: ``encode`` and ``decode`` of texts."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisers with escaped white space are compiled")
        if kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if any(p.type == _USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined symbols are not compiled")
        self.merges, self.prefix = kind == _BPE, norm.add_dummy_prefix
        self.lexicon = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.weight = [-p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.out = [p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else b"" for p in model.pieces]
        for b, k in self.bytes.items():
            self.out[k] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.lexicon):
            raise ValueError("a piece reads a mark after another character")
        line = "\n" not in "".join(self.lexicon)
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if line else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.text = [p.piece for p in model.pieces]
        self.compile_lexicon()

    def compile_lexicon(self) -> None:
        """Lexicon as a deterministic automaton over characters that keeps, in each state, the arcs of the pieces that end there.

        ``step[s][c]`` is the state after c, ``back[s]`` the state of the
        longest proper suffix, ``ends[s]`` the arcs (length, id), longest
        first.  A piece that its own merges do not produce is on no path.
        """
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.back = [0]
        for piece, k in self.lexicon.items():
            if self.merges and len(piece) > 1 and self.merged(piece) != [piece]:
                continue
            s = 0
            for c in piece:
                if c not in self.step[s]:
                    self.step[s][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                    self.back.append(0)
                s = self.step[s][c]
            self.ends[s] = ((len(piece), k),)
        level = list(self.step[0].values())
        while level:
            nxt = []
            for s in level:
                for c, t in self.step[s].items():
                    f = self.back[s]
                    while f and c not in self.step[f]:
                        f = self.back[f]
                    self.back[t] = self.step[f].get(c, 0)
                    nxt.append(t)
                self.ends[s] += self.ends[self.back[s]]
            level = nxt

    def merged(self, text: str) -> list[str]:
        """Merge result of a short text: the best-scored adjacent pair first, the leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = inf, -1
            for i in range(len(parts) - 1):
                k = self.lexicon.get(parts[i] + parts[i + 1])
                if k is not None and (w := self.weight[k]) < best:
                    best, at = w, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def context(self, a: int, b: int) -> bool:
        """Weight of the arc from piece a to piece b is 0 (else infinite)."""
        got = self.fits.get(a << 32 | b)
        if got is None:
            if len(self.fits) >= CONTEXTS:
                self.fits.clear()
            x, y = self.text[a], self.text[b]
            got = self.fits[a << 32 | b] = self.merged(x + y) == [x, y]
        return got

    def fallback(self, c: str) -> tuple[int, ...]:
        """Output of the byte-fallback arc for one character."""
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    def shortest_path(self, seg: str) -> tuple[int, ...]:
        """Output of the least path through the composition of ``seg`` with lexicon and fallback."""
        n, step, back, ends, fits = len(seg), self.step, self.back, self.ends, self.fits
        last = [0] * (n + 1)  # id on the arc into each position, -1: fallback
        size = [1] * (n + 1)  # and the characters it reads
        dist = [0.0] * (n + 1)
        s = j = 0
        for c in seg:
            j += 1
            while c not in step[s] and s:
                s = back[s]
            s = step[s].get(c, 0)
            if self.merges:
                for m, k in ends[s]:
                    if m == j or (a := last[j - m]) < 0:
                        break
                    fit = fits.get(a << 32 | k)
                    if fit or fit is None and self.context(a, k):
                        break
                else:  # a character that no piece reads
                    m, k = 1, -1
            else:
                best, m, k = inf, 1, -1
                for x, y in ends[s]:
                    w = dist[j - x] + self.weight[y]
                    if w < best:
                        best, m, k = w, x, y
                if (not ends[s] or ends[s][-1][0] > 1) and dist[j - 1] + _UNKNOWN_WEIGHT < best:
                    best, m, k = dist[j - 1] + _UNKNOWN_WEIGHT, 1, -1
                dist[j] = best
            last[j], size[j] = k, m
        ids: list[int] = []
        j = n
        while j:
            if last[j] < 0:
                ids += self.fallback(seg[j - 1])[::-1]
            else:
                ids.append(last[j])
            j -= size[j]
        return tuple(ids[::-1])

    def normalise(self, text: str) -> str:
        """Output of the normaliser transducer."""
        flat = text.replace(" ", MARK)
        return MARK + flat if self.prefix and flat else flat

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for seg in self.cut.findall(self.normalise(text)):
            ids = known.get(seg)
            if ids is None:
                ids = self.older.get(seg) or self.shortest_path(seg)
                if len(seg) <= CACHED_CHARS:
                    if len(known) >= CACHE:  # the older half goes, what is met again moves to the younger
                        self.older, self.known = known, {}
                        known = self.known
                    known[seg] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Inverse transducer: bytes of the pieces, the prefix mark removed."""
        raw = b"".join([self.out[k] for k in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def transducer(model_file: str) -> Transducer:
    """One compiled model per worker process."""
    return Transducer(model_file)


def encoded(text: Column, model_file: str, with_ids: bool = False) -> Column:
    """Struct ``n_ids, ids_sha256`` (ids as little-endian 32-bit integers), ``decoded_sha256, round_trip`` and on demand ``ids``."""
    names = "n_ids bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids

    @F.pandas_udf(names)
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fst = transducer(model_file)
        for part in parts:
            rows = []
            for t in part:
                ids = fst.encode(t)
                back = fst.decode(ids)
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
                             back == t.replace(MARK, " "), *([ids] if with_ids else [])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in names.split(", ")])

    return each(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_ids, ids_sha256, decoded_sha256, round_trip`` and on demand ``ids``.

    No shuffle.  A null text is empty (no ids); a literal mark reads as a
    space, as the normaliser has it; a null id stays null; repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    got = docs.select(col(id_col).alias("id"), encoded(col(text_col), model_file, with_ids).alias("e"))
    return got.select(F.col("id").alias(id_col), "e.*")
