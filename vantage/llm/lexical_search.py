"""Ranked lexical search by branch and bound over document FP-trees.

The stated queries (items) name the terms that matter; every document is read
once, whole, and restricted to them: its length and the counts of the items'
terms.  Corpus statistics (documents, terms, document frequencies) come from
all of these rows.

Each task then builds document FP-trees from the rows of its partition.  A
document's terms, most frequent in the corpus first, are its path; documents
sorted by path share their prefixes, a node is a run of that order, and runs of
few documents are leaves.  Every node keeps, over its subtree, the maximum
count of each term, the minimum length measure m and the least document id.  A
term's part of the score, ``w * ((10^9 tf) div (1000 tf + 20 m))``, never falls
with tf and never rises with m, so the same formula on these maxima and minima
bounds every document below the node.  Per item, a depth-first walk enters the
child of the highest bound first, scores leaves exactly and leaves out subtrees
that cannot reach the item's best k so far; ties go to the smaller id.  The
walk's best k carries on from tree to tree, and tasks return k rows an item.

Items are taken in blocks of bounded text size, so what each task is sent is
bounded however many items there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, materialise

TOP = 50
#: Documents of one tree at most, documents of a leaf at most, and the numbers a tree's summaries may hold (fewer documents a tree where the items have many terms).
TREE_DOCS, LEAF_DOCS, TREE_CELLS = 8192, 32, 8 << 20
#: Bytes of item text in one pass over the documents.
BLOCK_BYTES = 4 << 20
_TOPS = (1 << 63) - 1
#: Bytes outside terms become blanks, A-Z become a-z; all bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# ---- restricted documents ----------------------------------------------------------------------------

def restricted(src: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``src(id, text binary)`` -> ``(id, n, terms, tf)``: all terms counted in ``n``, those of the vocabulary listed."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for got in parts:
            n, at, tf, ends = [], [], [], [0]
            for text in got.column("text").to_pylist():
                words = terms(text)
                own = Counter(map(known, words))
                own.pop(None, None)
                n.append(len(words))
                at += own.keys()
                tf += own.values()
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [got.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                names=["id", "n", "terms", "tf"])

    return src.mapInArrow(count, "id bigint, n bigint, terms array<int>, tf array<int>")


# ---- the tree ------------------------------------------------------------------------------------------

class Tree:
    """FP-tree over documents given as rows ``ptr`` of ``(cols, tf)`` with measures ``m`` and ids ``ids``; ``cols`` are frequency ranks, ascending in each row."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, width: int, leaf_docs: int = LEAF_DOCS) -> None:
        paths = cols.astype(">u4").tobytes()
        keys = [paths[4 * a:4 * b] for a, b in zip(ptr[:-1], ptr[1:])]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        size = np.diff(ptr)[order]
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(ptr[:-1][order] - self.ptr[:-1], size) + np.arange(self.ptr[-1])
        self.cols, tf, self.m, self.ids = cols[pick], tf[pick].astype(np.int64), m[order], ids[order]
        self.part = part(tf, np.repeat(self.m, size))
        self.lo, self.hi, self.kids = [], [], []
        self.root = self.grow(0, len(order), leaf_docs)
        self.summarise(tf, width)

    def shared(self, a: int, b: int) -> int:
        """Length of the common path of documents ``a`` and ``b``, and so of all between them."""
        x, y = self.cols[self.ptr[a]:self.ptr[a + 1]], self.cols[self.ptr[b]:self.ptr[b + 1]]
        k = min(len(x), len(y))
        same = x[:k] == y[:k]
        return k if same.all() else int(np.argmin(same))

    def grow(self, lo: int, hi: int, leaf_docs: int) -> int:
        """Node of the run ``lo:hi``; its children part where paths do, neighbours that are small share a leaf."""
        todo, root = [(lo, hi, -1)], len(self.lo)
        while todo:
            lo, hi, above = todo.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            if above >= 0:
                self.kids[above].append(node)
            if hi - lo <= leaf_docs:
                continue
            depth = self.shared(lo, hi - 1)
            ends = self.ptr[lo + 1:hi + 1] - self.ptr[lo:hi] <= depth
            step = np.where(ends, -1, self.cols[np.minimum(self.ptr[lo:hi] + depth, len(self.cols) - 1)])
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(step))), hi]
            if len(cuts) == 2:  # equal paths only: halves
                cuts = [lo, (lo + hi) // 2, hi]
            at = cuts[0]
            for a, b in zip(cuts[1:], cuts[2:] + [0]):  # b: where a run that also took the next child would end
                if a == hi or b - at > leaf_docs:
                    todo.append((at, a, node))
                    at = a
        return root

    def summarise(self, tf: np.ndarray, width: int) -> None:
        """Per node: largest count of each term, least m and least id below it."""
        n = len(self.lo)
        self.tf, self.m_min, self.id_min = np.zeros((n, width), np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node in range(n - 1, -1, -1):  # children come after their parent
            lo, hi, kids = self.lo[node], self.hi[node], self.kids[node]
            if kids:
                self.tf[node], self.m_min[node], self.id_min[node] = self.tf[kids].max(0), self.m_min[kids].min(), self.id_min[kids].min()
            else:
                a, b = self.ptr[lo], self.ptr[hi]
                np.maximum.at(self.tf[node], self.cols[a:b], tf[a:b].astype(np.int32))
                self.m_min[node], self.id_min[node] = self.m[lo:hi].min(), self.ids[lo:hi].min()

    def search(self, q: np.ndarray, w: np.ndarray, wide: np.ndarray, top: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """Best ``top`` (scores, ids) of ``best`` and this tree for an item with terms ``q`` of weights ``w``; ``wide`` holds them by rank.  Also the leaves scored."""
        bound = part(self.tf[:, q].astype(np.int64), self.m_min[:, None]) @ w
        stack, scored = [self.root], 0
        while stack:
            node = stack.pop()
            floor = best[0][-1] if len(best[0]) == top else 0
            if bound[node] <= 0 or bound[node] < floor or (bound[node] == floor and self.id_min[node] > best[1][-1]):
                continue
            if self.kids[node]:
                kids = np.array(self.kids[node])
                stack += kids[np.argsort(bound[kids], kind="stable")].tolist()
                continue
            scored += 1
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.ptr[lo], self.ptr[hi]
            run = np.concatenate([[0], np.cumsum(wide[self.cols[a:b]] * self.part[a:b])])
            score = run[self.ptr[lo + 1:hi + 1] - a] - run[self.ptr[lo:hi] - a]
            good = (score > 0) & (score >= floor)
            if good.any():
                s, d = np.concatenate([best[0], score[good]]), np.concatenate([best[1], self.ids[lo:hi][good]])
                keep = np.lexsort((d, -s))[:top]
                best = s[keep], d[keep]
        return best, scored


def tree_docs(width: int, leaf_docs: int = LEAF_DOCS) -> int:
    """Documents a tree may hold, so that its summaries stay within ``TREE_CELLS`` numbers."""
    return max(leaf_docs, min(TREE_DOCS, TREE_CELLS // max(width, 1) * leaf_docs // 4))


def forest(rows: DataFrame, rank: np.ndarray, items: list[tuple[int, list[int], list[int]]], n_docs: int, n_terms: int, top: int, leaf_docs: int) -> DataFrame:
    """Each partition's best ``top`` for every item ``(key, term ranks, weights)``: ``(item, id, score)``; null ids as the greatest."""
    width = len(rank)
    limit = tree_docs(width, leaf_docs)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for key, _, _ in items}
        asked = [(key, np.array(q, np.int64), np.array(w, np.int64)) for key, q, w in items]
        wide = np.zeros(width, np.int64)

        def over(docs: list[tuple]) -> None:
            n, ids, size, cols, tf = (np.concatenate(x) for x in zip(*docs))
            ptr = np.concatenate([[0], np.cumsum(size)])
            cols = rank[cols]
            inner = np.lexsort((cols, np.repeat(np.arange(len(size)), size)))
            m = 50 + (50 * n * n_docs) // n_terms
            tree = Tree(ptr, cols[inner], tf[inner], m, ids, width, leaf_docs)
            for key, q, w in asked:
                wide[q] = w
                best[key], _ = tree.search(q, w, wide, top, best[key])
                wide[q] = 0

        held, count = [], 0
        for got in parts:
            got = got.filter(pa.compute.greater(pa.compute.list_value_length(got.column("terms")), 0))
            for at in range(0, got.num_rows, limit):
                piece = got.slice(at, limit)
                if count + piece.num_rows > limit and held:
                    over(held)
                    held, count = [], 0
                size = pa.compute.list_value_length(piece.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((piece.column("n").to_numpy(zero_copy_only=False), piece.column("id").fill_null(_TOPS).to_numpy(zero_copy_only=False), size,
                             piece.column("terms").flatten().to_numpy(zero_copy_only=False), piece.column("tf").flatten().to_numpy(zero_copy_only=False)))
                count += piece.num_rows
        if held:
            over(held)
        for key, (score, ids) in best.items():
            if len(score):
                yield pa.RecordBatch.from_pydict({"item": pa.array(np.full(len(score), key)), "id": pa.array(ids), "score": pa.array(score)})

    return rows.mapInArrow(search, "item bigint, id bigint, score bigint")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each item, ranked: first within salted parts, then over what is left of them."""
    order = [F.col("score").desc(), F.col("id")]
    parts = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


# ---- the operator --------------------------------------------------------------------------------------

def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   top: int = TOP, leaf_docs: int = LEAF_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each item: ``item_col, rank, id_col, score``.

    Null texts have no terms; an item without known terms gets no rows.  Items
    with equal id and text count once; equal ids with different texts are
    ranked on their own.  Repeated documents are ranked each; a null id comes
    after all others of the same score.  Empty tables give no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    asked = materialise(items.select(col(item_col).alias("name"), col(item_text_col).cast("string").alias("text")).distinct(), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    kind = asked.schema["name"].dataType.simpleString()
    out: list[DataFrame] = []
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == block).collect()  # about block_bytes of text
        named = [(r["name"], list(dict.fromkeys(terms((r["text"] or "").encode())))) for r in own]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in named for t in ts}))}
        if not vocabulary:
            continue
        rows = materialise(restricted(src, vocabulary), "search-vectors")
        total = rows.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        by_df = sorted(vocabulary.values(), key=lambda t: (-df.get(t, 0), t))
        rank = np.zeros(len(by_df), np.int64)
        rank[by_df] = np.arange(len(by_df))
        sought = []
        for i, (_, ts) in enumerate(named):
            held = [vocabulary[t] for t in ts if vocabulary[t] in df]
            if held:
                sought.append((i, [int(rank[t]) for t in held], [weight(total["docs"], df[t]) for t in held]))
        if not sought:
            continue
        found = best_of(forest(rows, rank, sought, total["docs"], total["terms"], top, leaf_docs), top)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(named)], f"item bigint, name {kind}")
        out.append(materialise(found.join(names, "item").select("name", "rank", F.expr(f"nullif(id, {_TOPS})").alias("id"), "score"), "search-found"))
    got = out[0] if out else spark.createDataFrame([], f"name {kind}, rank int, id bigint, score bigint")
    for more in out[1:]:
        got = got.union(more)
    return got.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
