"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function
of the words and word stems of a learned vocabulary in it; a document's score is the
noisy-or of its sentences (and of a small learned leak, which is the score of
a text without evidence).  Only document labels are used: the gradient of the
document likelihood flows to the sentences that explain it, so that the same
sentence scores locate the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, fresh, materialise, never_sent

#: The model is fitted on this many different labelled texts of each class at most, chosen by a hash of the text.
MAX_TRAIN_PER_CLASS = 3000
#: Lengths of the word stems that count as features beside the words: inflected and joined words share them.
STEMS = (4, 5)
#: Vocabulary: features by the z score of their document counts in the two classes.
VOCABULARY, MIN_Z, MIN_DOCS = 2048, 4.0, 4
FOLDS = 5

#: One rule for words, in Python's and in Java's terms: letters and numbers that are no decimal digits.
WORD = re.compile(r"[^\W\d_]+")
_SPARK_WORD = r"[\p{L}\p{Nl}\p{No}]+"
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by the number of folds (a null id counts as held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(text: str) -> set[str]:
    """The words of a text and their stems: ``^`` and the first letters."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{"^" + w[:n] for w in words} for n in STEMS])


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    for m in SENTENCE.finditer(text):
        yield m.start(), m.end(), m.group()


@dataclass(frozen=True)
class NoisyOr:
    """Word weights, sentence bias and leak."""

    weights: dict[str, float]
    bias: float
    leak: float

    def sentence(self, text: str) -> float:
        """Score of one sentence; 0 without a word of the vocabulary."""
        w = self.weights
        seen = [w[x] for x in features(text) if x in w]
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, sum(seen) + self.bias)))) if seen else 0.0

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score and the offending sentences ``(start, end, score >= 0.5)``."""
        if self.weights.keys().isdisjoint(features(text)):
            return self.leak, []
        clean, bad = 1 - self.leak, []
        for s, e, part in sentences(text):
            p = float(self.sentence(part))
            clean *= 1 - p
            if p >= 0.5:
                bad.append((s, e, p))
        return 1 - clean, bad


def train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """Bounded sample ``(text, y)``: the ``per_class`` different held-in labelled texts of least hash in each class."""
    y = labels.where(col(label_col).isin(0, 1)).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).cast("int").alias("y"))
    src = docs.where(~held_out(col(id_col)) & col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    keyed = src.select("id", "h").join(never_sent(y), "id").groupBy("h", "y").agg(F.min("id").alias("id"))  # copies of a text count once
    pick = [keyed.where(F.col("y") == k).orderBy("h").limit(per_class).select("id", "h", "y") for k in (0, 1)]
    chosen = materialise(pick[0].union(pick[1]).select("id", "h", "y"), "toxicity-chosen")
    rows = src.join(F.broadcast(chosen), ["id", "h"])  # 2 * per_class rows at most
    return materialise(rows.groupBy("id", "h").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y"), "toxicity-train")


def _stem(n: int):
    return lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))


def vocabulary(train: DataFrame, size: int = VOCABULARY, min_z: float = MIN_Z) -> list[str]:
    """The features whose document counts differ most between the classes."""
    tot = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = tot.get(0, 0), tot.get(1, 0)
    if not n0 or not n1:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_SPARK_WORD), F.lit(0)))
    stems = [F.transform(words, _stem(n)) for n in STEMS]
    words = train.select("y", F.explode(F.array_distinct(F.concat(words, *stems))).alias("w"))
    c = words.groupBy("w").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1")).where(F.col("c0") + F.col("c1") >= MIN_DOCS)
    p = (F.col("c0") + F.col("c1") + 1.0) / (n0 + n1 + 2.0)
    z = (F.col("c1") / float(n1) - F.col("c0") / float(n0)) / F.sqrt(p * (1 - p) * (1.0 / n0 + 1.0 / n1))
    top = c.withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "w").limit(size)
    return sorted(r["w"] for r in top.select("w").collect())


def bags(train: DataFrame, words: list[str]) -> DataFrame:
    """Per training document its sentences with vocabulary words, as word numbers (distinct sentences once)."""
    at = {w: k for k, w in enumerate(words)}

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t in pdf["text"]:
                found = {tuple(sorted(at[w] for w in features(s) if w in at)) for _, _, s in sentences(t)}
                out.append([list(x) for x in sorted(found) if x])
            yield pd.DataFrame({"y": pdf["y"], "bag": out})

    return train.mapInPandas(each, "y int, bag array<array<int>>")


def fit(y: np.ndarray, found: list[list[list[int]]], words: list[str], rounds: int = 300, step: float = 0.1, l2: float = 1e-4) -> NoisyOr:
    """Adam on the noisy-or log likelihood (mean over documents) with an L2 penalty."""
    n, m = len(y), len(words)
    if not n or not m:
        return NoisyOr({}, 0.0, float((y.sum() + 1) / (n + 2)) if n else 0.5)
    doc = np.array([d for d, b in enumerate(found) for _ in b], np.int64)
    sent = [s for b in found for s in b]
    at = np.array([k for k, s in enumerate(sent) for _ in s], np.int64)
    word = np.array([w for s in sent for w in s], np.int64)
    theta = np.concatenate([np.zeros(m), [-1.0, -3.0]])  # weights, bias, leak as a logit
    mom, var = np.zeros(m + 2), np.zeros(m + 2)
    for t in range(1, rounds + 1):
        z = np.bincount(at, theta[word], len(sent)) + theta[m]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-6)
        leak = 1 / (1 + np.exp(-theta[m + 1]))
        log_clean = np.bincount(doc, np.log1p(-p), n) + np.log1p(-leak)
        clean = np.exp(log_clean)
        # slope of the loss in log_clean: -1 for a clean document, clean / (1 - clean) for a toxic one; log_clean falls by p a unit of z
        slope = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) / n
        down = slope[doc] * -p
        grad = np.concatenate([np.bincount(word, down[at], m) + l2 * theta[:m], [down.sum(), (slope * -leak).sum()]])
        mom, var = 0.9 * mom + 0.1 * grad, 0.999 * var + 0.001 * grad * grad
        theta = theta - step * (mom / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-8)
    leak = 1 / (1 + np.exp(-theta[m + 1]))
    return NoisyOr(dict(zip(words, theta[:m].tolist())), float(theta[m]), float(leak))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = MAX_TRAIN_PER_CLASS) -> NoisyOr:
    """Fit on a bounded sample; the driver sees word numbers of those documents only."""
    bound_batches(docs.sparkSession)
    rows = train_rows(docs, labels, id_col, text_col, label_col, per_class)
    words = vocabulary(rows)
    got = bags(rows, words).toPandas()
    found = sorted((int(y), [list(map(int, s)) for s in b]) for y, b in zip(got["y"], got["bag"]))
    return fit(np.array([y for y, _ in found], np.int64), [b for _, b in found], words)


def scored(text: Column, model: NoisyOr) -> Column:
    """Struct ``score double, n_offending bigint, offending string`` (``start:end`` in code points, comma-joined)."""

    @F.pandas_udf("score double, n_offending bigint, offending string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                p, bad = model.score(t)
                rows.append((min(1.0, max(0.0, p)), len(bad), ",".join(f"{s}:{e}" for s, e, _ in bad)))
            yield pd.DataFrame(rows, columns=["score", "n_offending", "offending"])

    return each(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted, n_offending, offending``.

    A null text is empty, and an empty text scores the leak; a null id counts
    as held out; repeated rows stay repeated; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    got = docs.select(col(id_col).alias("id"), scored(col(text_col), model).alias("s"))
    return got.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "s.score",
                      (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_offending", "s.offending")


def drop_toxic(docs: DataFrame, model: NoisyOr, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; all columns stay."""
    bound_batches(docs.sparkSession)
    (tmp,) = fresh(docs, "toxicity")
    got = docs.withColumn(tmp, scored(col(text_col), model)["score"])
    return got.where(F.col(tmp) < 0.5).select(*[col(c) for c in docs.columns])
