"""A corpus from raw documents to token ids, in five stages. Each stage gets all that the one before it kept.

Defined cases of all stages but the last: columns stay as they are, whatever their names; very long texts are read
whole; an empty table gives an empty result; null ids take part.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark.llm import bpe, dedup, mixing, quality, simhash
from hetspark.llm.common import settled

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the counts or the line model reject. Labelled documents among docs fit the model.
    Null and empty texts have no words and go. Repeated rows are judged alike. Without labels of both kinds every line
    is content."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one of the largest doc_id. A null text counts as empty; null ids lose against any other;
    of rows equal in id and text one stays."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id. Null and empty texts have fingerprint
    zero; null ids lose against any other; of rows equal in id the one of the least text hash stays."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for. A null source is one of its own; documents without words are
    taken like others; repeated rows are documents of their own."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the text that they decode to; a row for each copy.
    Null and empty texts have no ids."""
    ids = bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, bytes_col="decoded")
    return ids.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), *bpe.digest_columns())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix), ("byte-level BPE", encode)]

#: The line model and the links between fingerprints can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
