"""Token counts (1) and SentencePiece transducer (4) against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from vantage.llm.sentencepiece_fst import MARK, Transducer, encode_documents
from vantage.llm.token_counts import ChunkedEncoder, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n_tokens string, e int"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(3)
    odd = ["", " ", "a", "  a", "a" * 700, " " * 300, "abc " * 300, "\n" * 200, " a" * 200, "x" * 37 + " " * 80 + "y" * 90, "<s></s><unk>", "▁▁a ▁", "\x00\x01",
           "é 😀 ﬁ　b" * 40]
    return odd + ["".join(r.choice("  ▁\n\x00taeinrsßé😀<>.") for _ in range(300)) for _ in range(40)]


@pytest.mark.parametrize("chunk,overlap", [(40, 3), (300, 40), (16384, 256)])
def test_spliced_counts_equal_whole_texts(sp, chunk, overlap):
    enc = ChunkedEncoder(MODEL, chunk, overlap)
    every = texts() + [" ".join(texts()) * 3]
    assert enc.counts(every) == [len(x) for x in sp.encode(every)]


def test_counts_of_rows(spark, sp):
    rows = [(1, "one two", "en", "s", 7, "x", "y", 1), (1, "one two", "en", "s", 7, "x", "y", 1), (None, None, None, None, None, None, None, None), (3, "", "", "", 0, "", "", 0)]
    got = token_counts(spark.createDataFrame(rows, SCHEMA), MODEL, limit=1).collect()
    n = len(sp.encode("one two"))
    assert sorted(map(tuple, got), key=str) == sorted([(1, 7, n, True), (1, 7, n, True), (None, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_counts_over_documents(spark, sf_small, sp):
    from vantage.llm.queries import op1_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = op1_token_counts(spark, sf_small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs.items()}


def test_paths_equal_the_library(sp, spark, sf_small):
    fst = Transducer(MODEL)
    every = texts() + [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    for t in every:
        ids = fst.encode(t)
        assert ids == sp.encode(t), repr(t[:60])
        assert fst.decode(ids) == t.replace(MARK, " ")


def test_unigram_path_is_the_least_weight():
    fst = Transducer(MODEL)
    fst.merges = False
    fst.lexicon = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    fst.weight, fst.text = [1.0, 1.0, 1.5, 0.7, 3.0], list(fst.lexicon)
    fst.compile_lexicon()

    def brute(seg):
        if not seg:
            return 0.0
        return min([fst.weight[k] + brute(seg[len(p):]) for p, k in fst.lexicon.items() if seg.startswith(p)])

    for seg in ("a", "ab", "aba", "abab", "babab", "aabbaabab"):
        path = fst.shortest_path(seg)
        assert "".join(fst.text[k] for k in path) == seg
        assert sum(fst.weight[k] for k in path) == pytest.approx(brute(seg))


def test_encoded_rows(spark, sp):
    rows = [(1, "größe\tß", "de", "s", 1, "x", "y", 1), (2, None, None, None, None, None, None, None), (2, "", None, None, None, None, None, None)]
    got = encode_documents(spark.createDataFrame(rows, SCHEMA), MODEL, with_ids=True).orderBy(F.col("n_ids").desc()).collect()
    ids = sp.encode(rows[0][1])
    assert got[0].ids == ids and got[0].round_trip and got[0].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert [(r.doc_id, r.n_ids, r.round_trip) for r in got[1:]] == [(2, 0, True)] * 2
    assert encode_documents(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
