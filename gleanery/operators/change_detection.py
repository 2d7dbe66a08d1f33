"""Which pages are new, changed, unchanged or gone, and the roll-up of an ingestion run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROCESSED, CACHED, FAILED = "processed", "cached", "failed"


def with_change(incoming: DataFrame, state: DataFrame, key: str = "url", digest: str = "content_hash") -> DataFrame:
    """`incoming` with is_new and has_changed. Of the state only key and digest are read."""
    known = state.select(key, F.col(digest).alias("_known"), F.lit(True).alias("_seen"))
    joined = incoming.join(known, key, "left")
    return joined.select(
        *[incoming[c] for c in incoming.columns],
        F.col("_seen").isNull().alias("is_new"),
        (~F.col(digest).eqNullSafe(F.col("_known"))).alias("has_changed"),
    )


def orphans(known: list[DataFrame], current: DataFrame, key: str = "url") -> DataFrame:
    """Keys known to any of the stores that are not in the current list."""
    every = known[0].select(key)
    for other in known[1:]:
        every = every.union(other.select(key))
    return every.where(F.col(key).isNotNull()).distinct().join(current.select(key), key, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `incoming` take the place of rows with the same key; one row per key of it."""
    incoming = incoming.dropDuplicates([key])
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def distinct_values(df: DataFrame, column: str = "source_url") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def rollup(details: DataFrame) -> DataFrame:
    """One row of counters from per-url details (status, chunks, tokens)."""

    def of(status: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, value)), F.lit(0))

    return details.agg(
        of(PROCESSED, F.lit(1)).alias("urls_processed"),
        of(CACHED, F.lit(1)).alias("urls_skipped_cached"),
        of(FAILED, F.lit(1)).alias("urls_failed"),
        of(PROCESSED, F.col("chunks")).alias("total_chunks"),
        of(PROCESSED, F.col("tokens")).alias("total_tokens"),
    )


def scalar_metadata(value: Column, kind: str) -> Column:
    """Metadata values a store keeps: scalars as they are, lists joined by ', ', anything else as text.

    `kind` is the Spark type of the value; null stands for a missing key.
    """
    if kind.startswith("array"):
        return F.array_join(F.transform(value, lambda x: x.cast("string")), ", ")
    if kind in ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean"):
        return value
    return F.to_json(value) if kind.startswith(("struct", "map")) else value.cast("string")


def clean_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: scalar_metadata(F.col(c), df.schema[c].dataType.simpleString()) for c in columns})
