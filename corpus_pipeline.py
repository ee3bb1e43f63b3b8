"""From raw documents to packed training sequences: five stages over one documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import decontaminate, packing, pii, similar, simhash, toxicity
from postlens.llm.queries import PII_KEY
from postlens.llm.shared import Scratch


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones, does not reject."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash fingerprints of five-word shingles, chains of six bits or fewer."""
    return simhash.keep_one(docs, distance=6, words=5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What an exact similarity of 0.8 of five-word shingles would keep; no stage, but what `alike` is judged by."""
    return similar.keep_distinct(docs, similarity=0.8, words=5)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    return decontaminate.keep_unseen(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; the character count follows the text."""
    out = pii.replace_entities(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens that keep the sources' proportions."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", civil),
    ("simhash", alike),
    ("decontamination", unseen),
    ("pii", private),
    ("packing", packed),
]

#: Learned scores, XXH64 fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each reading the table that the one before it has written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
