"""Text -> vector, re-aimed.

The reference embeds row text with pretrained language models (weights
and tokenisers are not part of this engine).  Here the same step is an
MLlib pipeline over whole texts -- regex tokeniser, hashed term counts,
IDF, L2 normalisation -- fitted and applied by Spark; ``encode_texts`` takes a
user's tokeniser and model instead, in batches of token windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from vantage.operators.chunked import write_once
from vantage.session import ship_package

#: Tokens of one window, windows encoded at once.
WINDOW, BATCH = 512, 32


def encode_texts(df: DataFrame, text_col: str, key: str, tokenize: Callable[[], Callable[[str], Sequence[int]]],
                 encoder: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], pooling: str = "mean", window: int = WINDOW, batch: int = BATCH, pad: int = 0) -> DataFrame:
    """I1 with a plugged-in encoder: ``df`` with ``embedding ARRAY<DOUBLE>`` and ``n_tokens``.

    ``tokenize()`` is called once a worker and gives text -> token ids;
    ``encoder()`` likewise and gives (ids ``(n, window)``, lengths ``(n,)``) ->
    token vectors ``(n, window, width)``.  A text is encoded whole, in windows
    of ``window`` tokens, the last one filled with ``pad``.  ``pooling`` is
    "mean" (over all tokens of the text, none of the filling) or "first" (the
    first token's vector).  ``key`` tells rows apart; a null or empty text has
    no tokens and a null embedding.
    """
    if pooling not in ("mean", "first"):
        raise ValueError(pooling)
    ship_package(df.sparkSession)

    @F.pandas_udf("array<array<int>>")
    def windows(texts: pd.Series) -> pd.Series:
        cut = tokenize()
        out = []
        for t in texts:
            ids = list(cut(t)) if t else []
            out.append([ids[a:a + window] + [pad] * max(0, a + window - len(ids)) + [min(window, len(ids) - a)] for a in range(0, len(ids), window)])
        return pd.Series(out)

    def make():
        encode = encoder()

        def run(ids: np.ndarray) -> np.ndarray:
            tokens, length = ids[:, :window].astype(np.int64), ids[:, window].astype(np.int64)
            v = np.asarray(encode(tokens, length), float)
            kept = np.arange(window)[None, :] < length[:, None]
            return (v * kept[:, :, None]).sum(1) if pooling == "mean" else v[:, 0]

        return run

    vector = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[window + 1]])
    cut = df.select(F.col(key).alias("_key"), F.posexplode(windows(F.col(text_col))).alias("_at", "_ids"))
    part = cut.select("_key", "_at", F.element_at("_ids", -1).cast("bigint").alias("_n"), vector(F.col("_ids").cast("array<double>")).alias("_v"))
    part = write_once(part, "encoded-windows")
    n = F.sum("_n")
    if pooling == "first":
        one = part.groupBy("_key").agg(F.min_by("_v", "_at").alias("embedding"), n.alias("n_tokens"))
    else:
        sums = part.select("_key", F.posexplode("_v").alias("_d", "_x")).groupBy("_key", "_d").agg(F.sum("_x").alias("_x"))
        vec = sums.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("_v"))
        one = vec.join(part.groupBy("_key").agg(n.alias("n_tokens")), "_key").select("_key", F.transform("_v", lambda x: x / F.col("n_tokens")).alias("embedding"), "n_tokens")
    return df.join(one, df[key] == one["_key"], "left").drop("_key").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def embed_texts(df: DataFrame, text_col: str, dim: int = 256, key: str = "doc_id") -> DataFrame:
    """Adds ``embedding ARRAY<DOUBLE>`` (L2-normalised TF-IDF of the whole
    text), ``norm`` and ``nnz`` (non-zero terms)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True, minTokenLength=1),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    emb = vector_to_array("_vec")
    out = out.withColumn("embedding", emb)
    sq = F.aggregate(F.transform("embedding", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return (out.withColumn("norm", F.sqrt(sq))
               .withColumn("nnz", F.size(F.filter("embedding", lambda x: x != 0.0)))
               .drop("_tok", "_tf", "_tfidf", "_vec"))
