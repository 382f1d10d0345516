"""Token files (11), ranked lexical search (12) and hard negatives (13) against the library and brute force."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vantage.llm import hard_negatives as hn
from vantage.llm import lexical_search as ls
from vantage.llm import token_files as tf

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


# --- token files

TEXTS = ["Hello, World! it's 2024", "", None, "á café café ́x\ńy", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "你好    x\u0085y\x1cz\x0bq",
         "Iİ ΣΣ 한글 한", "word " * 40_000, "x" * 30_000 + " " + "ab1" * 20_000, "they'll we've\tDON'T\r\nI'd"]


def expected(rows, path, end=1):
    """Rows in the order of the files: id (null last); equal ids in any order, so their rows must be equal in the test."""
    lib, at, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("shard_bytes", [40_000, 1 << 30])
def test_token_files_equal_the_library(spark, path, shard_bytes):
    rows = [(7 * k % 11 - 3, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id int, text string, shard int, `key` string").repartition(3)
    got = tf.read_token_files(tf.write_token_files(docs, path, shard_bytes=shard_bytes)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, path)


def test_token_files_hot_ids_and_nulls(spark):
    rows = [(5, f"text {k % 40} of the same id") for k in range(900)] + [(None, "no id")] * 30 + [(k, f"own {k}") for k in range(300) if k != 5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    manifest = tf.write_token_files(docs, WORD, shard_bytes=1500)
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 8 and max(r.n_docs for r in shards) < 400  # the hot id fills several shards
    assert [r.base_ids for r in shards] == list(np.cumsum([0] + [r.n_ids for r in shards])[:-1])
    got = tf.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 30
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    lib = Tokenizer.from_file(WORD)
    want = Counter((i, tuple(lib.encode(t, add_special_tokens=False).ids + [1])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_token_files_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (1, "a"), (3, None)], "doc_id bigint, text string")
    (m,) = tf.write_token_files(docs, WORD, folder=str(tmp_path / "out")).collect()
    ids, docs_, off = (np.fromfile(f"{tmp_path}/out/{k}-{m['name']}", d) for k, d in (("ids", "<u2"), ("docs", "<i8"), ("offsets", "<u8")))
    assert docs_.tolist() == [1, 2, 3] and off.tolist() == [0, 2, 5, 6] and ids[off[1:].astype(int) - 1].tolist() == [1, 1, 1]
    assert tf.id_type(70_000, 1) == np.dtype("<u4")


def test_token_files_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = tf.write_token_files(empty, WORD)
    assert manifest.count() == 0 and tf.read_token_files(manifest).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tf.read_token_files(manifest).count() == 0


def test_latin_words_equal_the_library():
    """Every character of the Latin range beside letters, digits, marks, blanks and quotes, and random mixtures."""
    lib, own = Tokenizer.from_file(WORD), tf.Packer(WORD, 1)
    r = random.Random(1)
    chars = [chr(c) for c in range(0x250)]
    texts = [f"a{c}b {c}s '{c} {c}{c}9 x{c}" for c in chars] + ["".join(r.choice(chars if r.random() < 0.3 else list("ab'sStT \n12.,é")) for _ in range(60)) for _ in range(400)]
    got = [np.frombuffer(b, own.dtype).tolist() for b in own.pack(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_by_word_reads_the_configuration():
    config = json.loads(Tokenizer.from_file(WORD).to_str())
    assert tf.by_word(config) and not tf.by_word(json.loads(Tokenizer.from_file(BYTE).to_str()))
    config["normalizer"]["normalizers"].append({"type": "NFKC"})
    assert not tf.by_word(config)


def test_token_files_over_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = tf.read_token_files(tf.write_token_files(docs, WORD, shard_bytes=200_000)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([(r.doc_id, r.text) for r in docs.collect()], WORD)


# --- lexical search

def brute_search(docs, items, top):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words = [(i, cut(t)) for i, t in docs]
    df = Counter(w for _, ws in words for w in set(ws))
    n_docs, n_terms = sum(bool(ws) for _, ws in words), sum(len(ws) for _, ws in words)
    out = []
    for name, text in set(items):
        scored = []
        for i, ws in words:
            c, s = Counter(ws), 0
            for t in set(cut(text)):
                if c[t]:
                    m = 100 - 50 + (50 * len(ws) * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(name, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf,top,block", [(1, 3, 1 << 20), (4, 50, 60), (64, 10, 1 << 20)])
def test_search_equals_brute_force(spark, leaf, top, block):
    r = random.Random(leaf)
    word = lambda: r.choice(["the", "of", "And", "Ärger", "ärger", "x1", "你好", "zeta", "q" * 300]) if r.random() < 0.8 else f"w{r.randrange(40)}"
    docs = [(k % 150, " ".join(word() for _ in range(r.randrange(0, 30)))) for k in range(200)]
    docs += [(None, "the zeta w1"), (900, None), (901, ""), (902, "the zeta w1"), (903, "the zeta w1"), (904, "., \x7f!"), (905, "zeta-the_of " * 5000)]
    items = [(1, "the Of zeta zeta"), (2, "ÄRGER x1, 你好"), (2, "zeta W1"), (3, None), (4, ""), (5, "nowhere"), (6, "w1 w2 w3 nowhere"), (1, "the Of zeta zeta"), (None, "and")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, rank string")
    got = ls.lexical_search(d, q, top=top, leaf_docs=leaf, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, top)


def test_tree_bounds_and_skips():
    r = np.random.default_rng(3)
    n, width = 3000, 60
    held = [np.flatnonzero(r.random(width) < 0.6 / (1 + np.arange(width) / 4)) for _ in range(n)]
    held = [h if len(h) else np.array([0]) for h in held]
    ptr, cols = np.concatenate([[0], np.cumsum([len(h) for h in held])]), np.concatenate(held)
    counts, m, ids = r.integers(1, 6, len(cols)), r.integers(50, 400, n), r.permutation(n)
    tree = ls.Tree(ptr, cols, counts, m, ids, width, 16)
    q, w = np.array([1, 7, 30, 55]), np.array([100, 900, 4000, 6000])
    wide = np.zeros(width, np.int64)
    wide[q] = w
    score = np.array([(wide[cols[a:b]] * ls.part(counts[a:b], m[k])).sum() for k, (a, b) in enumerate(zip(ptr, ptr[1:]))])
    order = np.lexsort((ids, -score))[:20]
    (s, d), scored = tree.search(q, w, wide, 20, (np.zeros(0, np.int64),) * 2)
    assert s.tolist() == score[order].tolist() and d.tolist() == ids[order].tolist()
    leaves = sum(not k for k in tree.kids)
    assert 0 < scored < leaves / 2 and sum(h - lo for lo, h, k in zip(tree.lo, tree.hi, tree.kids) if not k) == n
    for node in range(len(tree.lo)):  # each node's bound holds for every document below it
        at = np.isin(ids, tree.ids[tree.lo[node]:tree.hi[node]])
        assert (ls.part(tree.tf[node, q].astype(np.int64), tree.m_min[node]) @ w) >= score[at].max()


def test_tree_size_follows_the_terms():
    assert ls.tree_docs(100) == ls.TREE_DOCS and ls.tree_docs(10**6) * 10**6 // ls.LEAF_DOCS <= 2 * ls.TREE_CELLS + 10**6


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert ls.lexical_search(docs, items).count() == 0
    got = ls.lexical_search(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


# --- hard negatives

def brute_negatives(rows, every, n_pos, n_neg):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and ok(v)]
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, u)), j is None, j or 0, m, j) for b, (j, m, u) in enumerate(rows) if b != a and len(u) == len(v)), key=lambda s: s[:3])
        for p in [s for s in scored if s[3] == lab][:n_pos]:
            fit = [s for s in scored if s[3] != lab and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:n_neg]
            out += [(i, p[4], k + 1, s[4], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,block,tile", [(1, 1 << 20, 2048), (9, 2000, 13), (64, 1 << 20, 50)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, block, tile):
    monkeypatch.setattr(hn, "TILE_ROWS", tile)
    r = np.random.default_rng(dim)
    rows = [(int(k), int(r.integers(0, 4)), [float(x) for x in r.normal(0.2, 1, dim).astype(np.float32)]) for k in r.permutation(220)]
    rows += [(500 + k, k % 2, rows[k][2]) for k in range(12)]  # ties
    rows += [(600, None, rows[0][2]), (601, 1, None), (602, 1, [float("nan")] * dim), (603, 1, [None] * dim), (604, 1, [float("inf")] * dim), (None, 2, rows[1][2]),
             (610, 1, [0.0] * dim), (620, 1, []), (621, 2, []), (630, 3, rows[2][2] + [1.0]), (640, 3, rows[2][2] + [0.5]), (641, 2, rows[2][2] + [0.4])]
    df = spark.createDataFrame([(i, lab, v, 0) for i, lab, v in rows], "vec_id bigint, label int, embedding array<float>, rank int").repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, n_positives=3, n_negatives=4, block_bytes=block).collect()
    as_float = [(i, lab, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    assert sorted(map(tuple, got), key=str) == brute_negatives(as_float, 10, 3, 4)


def test_repeated_anchor_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 2, [0.5, 0.3]), (2, 2, [0.6, 0.2])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = hn.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives(rows, 100, 5, 10) and len(got) == 4


def test_summaries_bound_every_score():
    r = np.random.default_rng(5)
    for dim in (1, 3, 16, 64, 100):
        x = r.integers(-300, 500, (40, dim)).astype(float) * (1 + (np.arange(dim) < dim / 2))
        mean, dev = hn.summaries(x)
        v = hn.Vectors(np.arange(40), np.arange(40), np.zeros(40), x.astype(np.int64), mean, dev)
        width = []
        for m, d in v.levels:
            mid, by = m @ m.T, d @ d.T
            assert (np.abs(x @ x.T - mid) <= by + 1e-6 * (1 + by)).all()
            width.append(by.mean())
        assert width == sorted(width, reverse=True)  # finer levels bound no worse
    grouped = np.repeat(r.normal(0, 60, (200, 16)), 4, axis=1).round()  # numbers that are alike within segments
    v = hn.Vectors(np.arange(200), np.arange(200), np.zeros(200), grouped.astype(np.int64), *hn.summaries(grouped))
    i, j, _, left = hn.within(v, v, np.ones((200, 200), bool), np.full(200, 150_000.0), np.full(200, np.inf))
    assert left[-1] == len(i) < 8000 and left[0] >= left[1] >= left[2]


def test_large_numbers_stay_exact(spark):
    rows = [(0, 1, [3e5, 1.0]), (1, 1, [2e5, 3.0]), (2, 2, [1.5e5 + 1 / 256, 0.0]), (3, 2, [1e5, 7.0]), (4, 2, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = hn.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives(rows[:4], 100, 5, 10)


def test_negatives_of_nothing(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    assert hn.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    one = hn.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], schema), F.col("vec_id") % 100 == 0)
    assert one.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and one.count() == 0
