"""The corpus pipeline: quality, near duplicates, contamination, secrets, and packing, one after another.

Each stage takes all that its predecessor kept, and is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, quality, secret_scan, simhash
from tidemark.llm.common import plain
from tidemark.llm.queries import table, vocabulary
from tidemark.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes."""
    out, name, least = quality.resample(docs, table(spark, sf_dir, "labels"))
    return out.where(quality.kept(name, least)).select(*plain(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.survivors(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark windows."""
    out, name = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~decontaminate.contaminated(name)).select(*plain(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced, and their lengths anew."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, placed in sequences."""
    return packing.pack(docs, vocabulary(packing.VOCABULARY))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
#: Fingerprints, models and tokens have no SQL; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
