"""Registered queries of this package, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import (chat, hard_negatives, lexical_search, licenses, mixing, secrets, sentencepiece_fst, simhash, token_counts, token_files, toxicity, vector_dedup,
                         winnowing)
from vantage.llm.common import table

MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse_conversations(table(spark, sf_dir, "conversations"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_embedding_near_dedup, op3_chat_formatting, op4_sentencepiece, op5_toxicity, op6_license_scan,
                            op7_secret_scan, op8_simhash, op9_source_mixture, op10_winnowing, op11_token_files, op12_lexical_search, op13_hard_negatives)}


def _case(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in sorted(weights.items())) + " ELSE 1 END" if weights else "1"


def _fill(nodes: str, parent: str, key: str) -> str:
    """SQL of one level of water-filling: ``share`` for each row of ``nodes(parent, key, cap, w, budget)``."""
    run = f"OVER (PARTITION BY {parent} ORDER BY ratio, {key} ROWS UNBOUNDED PRECEDING)"
    return f"""
SELECT *, CASE WHEN is_full THEN cap ELSE greatest(0, least(cap, floor(w::DOUBLE * ((budget - c_full)::DOUBLE / w_open::DOUBLE))::BIGINT)) END AS share
FROM (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {parent}), 0)::BIGINT AS c_full,
             (sum(w) FILTER (NOT is_full) OVER (PARTITION BY {parent}))::BIGINT AS w_open
      FROM (SELECT *, c_sum::DOUBLE + ratio * w_rest::DOUBLE <= budget::DOUBLE AS is_full
            FROM (SELECT *, sum(cap) {run} AS c_sum, sum(w) OVER (PARTITION BY {parent}) - sum(w) {run} AS w_rest
                  FROM (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM {nodes}))))"""


def mixture_sql(epochs: int = mixing.EPOCHS, fraction: float = mixing.FRACTION, seed: int = mixing.SEED) -> str:
    return f"""
WITH k AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_matches(source, '[02468]$') THEN 'a' WHEN regexp_matches(source, '[13579]$') THEN 'b' ELSE 'none' END AS domain,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_tokens
  FROM documents),
lf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {epochs})::BIGINT AS cap, {_case('source', mixing.SOURCE_WEIGHTS)} AS w
       FROM k GROUP BY domain, lang, source),
lg AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, {_case('lang', mixing.LANGUAGE_WEIGHTS)} AS w FROM lf GROUP BY domain, lang),
dm AS (SELECT 1 AS one, domain, sum(cap)::BIGINT AS cap, {_case('domain', mixing.DOMAIN_WEIGHTS)} AS w FROM lg GROUP BY domain),
d1 AS (SELECT dm.*, (SELECT floor(sum(tokens)::DOUBLE * {fraction})::BIGINT FROM lg) AS budget FROM dm),
d2 AS ({_fill('d1', 'one', 'domain')}),
l1 AS (SELECT lg.*, d2.share AS budget FROM lg JOIN d2 USING (domain)),
l2 AS ({_fill('l1', 'domain', 'lang')}),
s1 AS (SELECT lf.*, l2.share AS budget FROM lf JOIN l2 USING (domain, lang)),
s2 AS ({_fill('s1', 'domain, lang', 'source')}),
e AS (SELECT domain, lang, source, tokens, epoch, share - (epoch - 1) * tokens AS want FROM s2, unnest(range(1, {epochs} + 1)) AS u(epoch)),
p AS (SELECT k.*, e.epoch, e.want, e.tokens,
             coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id), doc_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e USING (domain, lang, source) WHERE e.want > 0),
c AS (SELECT doc_id, count(*) AS copies FROM p WHERE want >= tokens OR before < want GROUP BY doc_id)
SELECT k.doc_id, k.domain, k.lang, k.source, k.n_tokens, coalesce(c.copies, 0)::BIGINT AS copies FROM k LEFT JOIN c USING (doc_id)"""


def vector_sql(threshold: float = vector_dedup.THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def search_sql(top: int = lexical_search.TOP) -> str:
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {words("coalesce(text, '')")} AS ts FROM documents),
q AS (SELECT DISTINCT item_id, text, unnest({words('text')}) AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, rid, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, rid, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, rid, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY t),
p AS (SELECT doc_id, rid, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS part FROM tf JOIN w USING (t), g),
s AS (SELECT item_id, text, doc_id, rid, sum(part)::BIGINT AS score FROM q JOIN p USING (t) GROUP BY item_id, text, doc_id, rid)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {top}"""


def negatives_sql() -> str:
    return """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid AS brid, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.x) = len(b.x)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, brid) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.arid, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.brid) AS rank
      FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


ORACLE: dict[str, str] = {"op2_embedding_near_dedup": vector_sql(), "op9_source_mixture": mixture_sql(), "op12_lexical_search": search_sql(),
                          "op13_hard_negatives": negatives_sql()}
