"""A corpus pipeline: raw documents to token ids in five stages, each over all that the stage before kept.

1. language: a recurrent network, learned on labelled rows, labels each text; texts without letters and texts whose
   most probable language has less than ``LEAST_PROBABLE`` go.
2. near_duplicates: of the documents linked by 5-word shingles at a similarity of 0.8 the one with the smallest id stays.
3. repeats: bytes covered by a 100-byte string that occurs earlier are cut out of the texts (whole characters).
4. mixture: every document gets its ``mixture_position`` in an order that mixes the sources with weights size ** ``POWER``.
5. tokens: byte-level BPE ids and their decoding's digest, with the position.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import bpe, language_id, mixing, ngram_join, suffix_dedup
from quaero.llm.common import materialise

LEAST_PROBABLE = 0.3
POWER = 0.9
BLOCK_DOCS = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.learn(docs), LEAST_PROBABLE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.rewrite(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.whole_mixture(docs, POWER, BLOCK_DOCS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), carry="mixture_position")
    return coded.select("doc_id", "mixture_position", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]

#: The first stage holds a trained network, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
