"""Tables read from parquet, and the corpus views made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """documents as chunks: chunk_id, text, source_url, and the first line as the section heading."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("source_url")
    )
    # Spread by the chunk id, so that aggregates by chunk need no exchange of their own.
    return spread(docs, "chunk_id").withColumn("section_heading", F.substring_index("text", "\n", 1))


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages with the columns a fetch would have given them."""
    pages = spread(table(spark, folder, "pages").select("url", "html"), "url")
    return pages.select(
        "url",
        "html",
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(200).alias("status"),
        F.lit(0.0).alias("fetched_at"),
    )
