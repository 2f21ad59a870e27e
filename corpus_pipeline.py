"""A corpus pipeline: quality, near duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyaccord.lineage import stored
from skyaccord.llm import decontam, packing, quality_fm, secrets, similar


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 5-word Jaccard similarity 0.8 or more stays, the one with the least doc_id.

    Candidates are op1's (SimHash fingerprints within three bits, by deletion variants) and, for what lies beyond three bits,
    those that share a MinHash key; shingles decide.
    """
    return similar.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay whole."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; every document stays."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins and offsets."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret redaction", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The stages fit models and pack by search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder as Parquet and read again; the folder goes with the application."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
