"""The corpus pipeline: low quality out, near duplicates out, benchmark passages out, personal data masked, sources mixed to weights.

All stages but the last return the columns of the documents they are given. Stages map over their rows; text is shuffled only for rows whose id may have to
go (near duplicates) and for rows with candidates of personal data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontamination, jaccard, mixing, pii, quality
from foliant.llm._spark import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learned from the labelled rows of documents) doesn't reject."""
    model = quality.quality_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.remove_low_quality(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates."""
    return jaccard.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked (n_chars follows)."""
    return pii.mask_documents(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]
#: Learned models and seeded hashes decide, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
