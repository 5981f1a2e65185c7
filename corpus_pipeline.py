"""A corpus cleaning pipeline: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simplark.llm import decontaminate, exact_dedup, language_id, sentencepiece, simhash
from simplark.llm.common import new_folder, table
from simplark.llm.queries import tokenizer


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the labelled rows of its input."""
    return language_id.keep_identified(docs, language_id.train(docs, language_id.learnable()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, n_ids, decoded and round_trip."""
    return sentencepiece.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: Language ID, SimHash and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
