"""A corpus pipeline: language ID, SimHash near-dedup, secret scans, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistra.llm import language_id, mixing, secrets, sentencepieces, simhash
from vistra.llm.common import cut
from vistra.llm.queries import piece_vocabulary, word_vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; texts that are null, have no letter or fit no learned language go."""
    return language_id.keep_identified(docs, language_id.fit(docs, piece_vocabulary()))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash or by sharing at least 0.8 of their five-word shingles, the one with the smallest doc_id stays."""
    return simhash.keep_one(docs, near=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows."""
    return secrets.redact(docs, word_vocabulary(), secrets.corpus_words(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix of sources takes them: not at all, once, or up to three times."""
    return mixing.apply_mixture(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes and round_trip of every document."""
    return sentencepieces.encode(docs, piece_vocabulary())


STAGES = [
    ("language", language_stage),
    ("simhash", dedup_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: No SQL form: the first and last stage score texts with models.  tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
