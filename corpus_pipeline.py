"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Language identification sets ``lang`` and drops documents in no language;
near-duplicate groups keep their smallest id; contaminated documents go; secrets
are masked in place; what is left is packed.  A null or empty text is in no
language; rows that repeat an id are judged each by their text, and a row
without an id has no near-duplicates; more columns, whatever their names, are
passed on.  An empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seamark.llm import common, decontam, langid, minhash, packing, queries, secrets


#: Words of a shingle, as near-duplicate stages take them (the contract of op4 alone has four).
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs, shingle=SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(queries.VOCABULARY))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret masking", mask_secrets),
    ("packing", pack),
]

#: The language model, the secret network and the tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet to the shared folder and reread."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_path(spark, "pipeline-")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
