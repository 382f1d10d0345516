"""Corpus pipeline: five operators of vantage.llm in a row over the documents table.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame;
all but the last return the columns of documents.  ``run`` applies them, each
stage's rows written as Parquet under the shared checkpoint folder and read
again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vantage.llm import mixing, secrets, sentencepiece_fst, simhash, toxicity
from vantage.llm.common import materialise, table
from vantage.llm.queries import MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: the model is learned from the labels of this stage's own documents; rows scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: three-word shingles, two bits; the smallest doc_id of each group stays."""
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark; all rows stay, n_chars follows the text."""
    return secrets.with_length(secrets.redact_secrets(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row once for every epoch that picks it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of each remaining document, with the round trip checked."""
    return sentencepiece_fst.encode_documents(docs, public_tokenizers.path(MODEL), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", simhash_dedup), ("secrets", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Hashes, models and tokenizer results are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
