"""Token counts by overlap resynchronisation.

A document up to ``chunk_chars`` is encoded whole by the tokenizer library.
A longer one is encoded in overlapping chunks with offsets.  Two
neighbouring chunks are spliced at a *proven stable common boundary*: a
position in their overlap where both encodings end a token and whose two
neighbouring characters stand next to each other in no vocabulary piece.  No
merge can cross such a position, so the encodings of both sides are
independent of each other and the splice equals the encoding of the whole.
Where an overlap holds none, the next chunk starts earlier and earlier (the
overlap doubles), down to the last proven splice: then the two chunks become
one.  Memory is that of a chunk as long as stable boundaries exist.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col

CHUNK_CHARS, OVERLAP_CHARS, TOKEN_LIMIT = 16_384, 256, 4096
_NORMAL, _USER_DEFINED = 1, 4


class ChunkedEncoder:
    """Token counts of texts of any length for one sentencepiece model file."""

    def __init__(self, model_file: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        if not 0 < overlap_chars < chunk_chars:
            raise ValueError("overlap_chars must lie between 0 and chunk_chars")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        #: The proof reads raw characters, so it needs a normaliser that maps each alone.
        self.provable = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        pieces = [p.piece.replace("▁", " ") for p in model.pieces if p.type in (_NORMAL, _USER_DEFINED)]
        self.joined = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No piece of the vocabulary holds the characters on both sides of ``at``."""
        return self.provable and 0 < at < len(text) and text[at - 1:at + 1].replace("▁", " ") not in self.joined

    def ends(self, text: str, lo: int, hi: int) -> list[int]:
        """End offsets in ``text`` of the tokens of ``text[lo:hi]``, in order."""
        part = text[lo:hi]
        ends = [p.end for p in self.sp.encode(part, return_type="proto").pieces]  # in UTF-8 bytes
        if part.isascii():
            return [lo + x for x in ends]
        starts = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        return (lo + np.concatenate([[0], np.cumsum(starts)])[ends]).tolist()

    def splice(self, text: str, left: list[int], right: list[int], lo: int, hi: int) -> int | None:
        """Latest stable position in ``(lo, hi)`` where both encodings end a token."""
        mine = set(right[:bisect.bisect_left(right, hi)])
        for at in reversed(left[:bisect.bisect_left(left, hi)]):
            if at <= lo:
                return None
            if at in mine and self.stable(text, at):
                return at
        return None

    def count_long(self, text: str) -> int:
        n, total, begin = len(text), 0, -1  # begin: tokens that end there or before are counted; 0 is for the prefix mark
        lo, hi = 0, min(len(text), self.chunk)
        ends = self.ends(text, lo, hi)
        while hi < n:
            overlap = self.overlap
            while True:
                nxt = hi - overlap
                far = min(n, hi + self.chunk - self.overlap)
                if nxt <= max(begin, lo):  # nothing proven since the last splice: one larger chunk
                    hi = min(n, hi + max(self.chunk, hi - lo))
                    ends = self.ends(text, lo, hi)
                    break
                new = self.ends(text, nxt, far)
                at = self.splice(text, ends, new, nxt, hi)
                if at is not None:
                    total += bisect.bisect_right(ends, at) - bisect.bisect_right(ends, begin)
                    ends, lo, hi, begin = new, nxt, far, at
                    break
                overlap *= 2
        return total + len(ends) - bisect.bisect_right(ends, begin)

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk else "" for t in texts]
        out = [len(x) for x in self.sp.encode(short, num_threads=1)]
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count_long(t)
        return out


@lru_cache(maxsize=4)
def encoder(model_file: str, chunk_chars: int, overlap_chars: int) -> ChunkedEncoder:
    """One encoder per worker process."""
    return ChunkedEncoder(model_file, chunk_chars, overlap_chars)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit``.

    No shuffle.  A null text counts as empty (0 bytes, 0 tokens); a null id
    stays null; repeated rows stay repeated; an empty table gives no rows;
    other columns of the input are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(model_file, chunk_chars, overlap_chars)
        for part in parts:
            yield pd.Series(enc.counts(part.tolist()), dtype="int64")

    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    got = src.select("id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
