"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, importance, langid, media, minhash, packing, secrets, shards, substring, tokencounts, urlrules, warc
from .common import table

#: The tokenizer files' names in the public vocabulary folder.
VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A label's doc_id is the number in the URLs of that document's pages.
    return urlrules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), by_number=True)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_kd_shards": op2_kd_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_media_avi": op7_media_avi,
    "op8_warc": op8_warc,
    "op9_url_rules": op9_url_rules,
    "op10_pack": op10_pack,
    "op11_importance": op11_importance,
    "op12_token_counts": op12_token_counts,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontam.ORACLE_SQL,
    "op4_minhash_dedup": minhash.ORACLE_SQL,
    "op5_substring_dedup": substring.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
}
