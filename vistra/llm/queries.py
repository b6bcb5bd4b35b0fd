"""The subpackage's queries, each over whole tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, maxent, media_chunks, mixing, secrets, sentencepieces, simhash, token_records, url_filters, vector_dedup


def piece_vocabulary() -> str:
    """Place of the public piece vocabulary, a parameter of the operators that use one."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, piece_vocabulary()))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.fit_and_score(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), piece_vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 3))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, word_vocabulary(), secrets.corpus_words(docs))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.read(token_records.write(_table(spark, sf_dir, "documents"), word_vocabulary()))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_lm_score": op3_lm_score,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_simhash": op5_simhash,
        "op6_mixture": op6_mixture,
        "op7_vector_dedup": op7_vector_dedup,
        "op8_media": op8_media,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_records": op10_token_records,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filters.ORACLE, "op6_mixture": mixing.ORACLE}
