"""A corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last return the
columns of ``documents``. The last returns a row for each document of the token store it has written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import op2_language_id, op3_token_store, op4_mixing, op5_near_duplicates, op10_decontamination, staging
from pointloom.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is not recognised go."""
    ship(spark)
    return op2_language_id.keep_known(docs, op2_language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    ship(spark)
    return op5_near_duplicates.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return op10_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their target shares."""
    return op4_mixing.sample(docs, op4_mixing.fit(docs))


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written as shards and read back."""
    ship(spark)
    at = staging.folder(spark, "pipeline-tokens")
    op3_token_store.write(docs, at)
    return op3_token_store.digest(op3_token_store.read(spark, at))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_store", token_store),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the signatures, the trained model or the file format; the stages are tested against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
