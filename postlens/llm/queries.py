"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import bestfit, decontaminate, embeddings, lm, packing, phrases, pii, repeats, resample, simhash, tokenfiles, toxicity, urlrules
from postlens.llm.sql import ORACLE  # noqa: F401

#: Stands in for the secret that a deployment passes.
PII_KEY = "postlens surrogates"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.token_table(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op4_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf, "embeddings"))


@query
def op5_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)


@query
def op9_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return lm.language_model(table(spark, sf, "documents"))


@query
def op10_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query
def op13_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    pieces = bestfit.pack_best_fit(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
