"""A corpus pipeline over the documents table: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, folder of the tables) and works on all rows its predecessor kept. All stages but the last return
the columns of documents; the last returns packed rows. `run` writes each stage as Parquet to the shared folder and reads it
again, so a stage that is lost is not computed from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from gleanery.llm.staging import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document comes as often as it is drawn."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its bucket, batch and slot."""
    packed = packing.pack(docs)
    return packed.select("row.doc_id", "row.source", "row.text", "n_tokens", "bucket", "bound", "batch", "slot", "padding")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The trained classifier and the drawn splitting tree have no SQL; the tests check run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
