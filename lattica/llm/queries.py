"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_quotes, decontaminate, language_id, licenses, line_dedup, near_dup, sentencepiece_bpe, url_filter, wacz
from .common import table


#: The vocabulary file of op2; None: the public one on this machine.
SENTENCEPIECE_MODEL: str | None = None


def sentencepiece_model() -> str:
    if SENTENCEPIECE_MODEL:
        return SENTENCEPIECE_MODEL
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), sentencepiece_model())


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.report(table(spark, sf_dir, "conversations"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_wacz": op6_wacz,
    "op7_line_dedup": op7_line_dedup,
    "op8_hnsw": op8_hnsw,
    "op9_quote_links": op9_quote_links,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES: dict[str, str] = {
    "op6_wacz": wacz.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
