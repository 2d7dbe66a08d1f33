"""Exact nearest-neighbour search over an embedding column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.vectors import as_matrix, checked_metric, distance_matrix, distance_to
from gleanery.operators import tiles


def with_distance(df: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    return df.withColumn("distance", distance_to(query, metric)(F.col(vector)))


def search(
    df: DataFrame,
    query: Sequence[float],
    top_k: int | None = None,
    where: Column | None = None,
    contains: str | None = None,
    metric: str = "cosine",
    id_col: str = "chunk_id",
    vector: str = "embedding",
    default_top_k: int = 10,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The `top_k` rows nearest to `query`, as id, `keep` columns and distance, nearest first, ties by id.

    `where` is any predicate on the stored columns and `contains` a text predicate; both sit below
    the distance so that they reach the scan. Only id and vector are read: texts are joined to the
    few winners afterwards. Each task keeps its own `top_k` (TakeOrderedAndProject).
    """
    hits = df
    if where is not None:
        hits = hits.where(where)
    if contains is not None:
        hits = hits.where(F.contains(F.col("text"), F.lit(contains)))
    hits = with_distance(hits.select(id_col, *keep, vector), query, metric, vector).select(id_col, *keep, "distance")
    # Rows without a vector sort last and are dropped after the limit: a filter on the vector itself
    # would be pushed down and compute an embedding column twice.
    best = hits.orderBy(F.asc_nulls_last("distance"), id_col).limit(top_k or default_top_k)
    return best.where(F.col("distance").isNotNull())


def get_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows whose id is asked for; unknown ids are simply absent."""
    return df.join(ids.select(id_col), id_col, "left_semi").withColumn("distance", F.lit(0.0))


def search_many(
    df: DataFrame,
    queries: DataFrame,
    top_k: int,
    metric: str = "cosine",
    id_col: str = "chunk_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Nearest rows for a table of query vectors, as query_id, id, distance, rank.

    Blocks of queries meet slices of the corpus on executors (`tiles`): one plan at every size, exact, and no vector comes to the
    driver. Rows and queries without a vector are left out.
    """
    metric = checked_metric(metric)
    group = F.lit(0).alias("group")
    corpus = df.select(group, F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    asked = queries.select(group, F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))

    def distances(held: np.ndarray, questions: np.ndarray) -> np.ndarray:
        return distance_matrix(held, questions, metric).T

    found = tiles.nearest(corpus, asked, top_k, "vector", "query_vector", as_matrix, as_matrix, distances)
    return found.select("query_id", "id", "distance", "rank")
