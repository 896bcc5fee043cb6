"""Stages that turn documents into a training mix.

``run`` hands each stage the rows that its predecessor kept, written to the shared folder and read
again, so that a lost executor costs one stage at most.  All stages but the last return the columns
of ``documents``.  SQL cannot express the stages (hashed models, fingerprints, hashed draws).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import LOWER, UPPER, stored, unused
from meterloom.llm.decontam import questions_of, without_items
from meterloom.llm.exact_dedup import exact_duplicates
from meterloom.llm.mixing import mixed
from meterloom.llm.near_text import one_per_class
from meterloom.llm.quality import kept_documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest identifier, if any has one."""
    sha, owned, owner = unused(docs, "sha", "owned", "owner")
    owners = exact_duplicates(docs, keep="largest").groupBy(F.col("text_sha256").alias(owned)).agg(F.max("keep_id").alias(owner))
    digest = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    met = docs.withColumn(sha, digest).join(owners, (F.col(sha) == F.col(owned)) & F.col("doc_id").eqNullSafe(F.col(owner)))
    return met.dropDuplicates([sha]).select(docs.columns)


def one_of_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each class of texts that share 0.8 of their 5-word shingles."""
    return one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, questions_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixed(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_equal_texts),
    ("simhash_near_dedup", one_of_near_texts),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
