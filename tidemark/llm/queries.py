"""Registered queries of the text operators, and check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_pairs, centroids, curves, decontaminate, language, logbilinear, packing, quality, resampling, secret_scan, shards, simhash, toxicity

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and, as it is part of the installed packages, on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontamination", decontaminate.SQL)
def op1(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op3_vector_packing")
def op3(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"), vocabulary(packing.VOCABULARY))


@query("op4_quality_resampling")
def op4(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_mixture")
def op5(spark, sf_dir):
    return language.digest(table(spark, sf_dir, "documents"))


@query("op6_toxicity_neighbours")
def op6(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_hilbert_neighbours")
def op7(spark, sf_dir):
    return curves.digest(table(spark, sf_dir, "embeddings"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query("op9_log_bilinear")
def op9(spark, sf_dir):
    return logbilinear.digest(table(spark, sf_dir, "documents"))


@query("op10_sharding", shards.SQL)
def op10(spark, sf_dir):
    return shards.digest(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling", resampling.SQL)
def op11(spark, sf_dir):
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_centroid_clusters", centroids.SQL)
def op13(spark, sf_dir):
    return centroids.digest(table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe")
def op12(spark, sf_dir):
    return byte_pairs.digest(table(spark, sf_dir, "documents"), vocabulary(byte_pairs.VOCABULARY))
