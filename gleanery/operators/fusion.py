"""Weighted fusion of the vector, keyword and heading-tree hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import FusionSettings

VECTOR, BM25, TREE = "vector", "bm25", "page_index"


def rank_scores(ranked: DataFrame, settings: FusionSettings = FusionSettings()) -> DataFrame:
    """`score` = 1 - step x rank, rank from 0: it turns negative beyond twenty ranks.

    `ranked` has chunk_id and rank (1-based) for at most top_k rows; other columns stay.
    """
    return ranked.withColumn("score", 1.0 - (F.col("rank") - 1) * F.lit(settings.rank_step))


def effective_weights(has_bm25: Column, has_tree: Column, settings: FusionSettings) -> tuple[Column, Column, Column]:
    """A retriever without hits loses its weight and the rest is scaled to one.

    The vector weight always stays, even without vector hits.
    """
    bm25 = F.when(has_bm25, F.lit(settings.bm25_weight)).otherwise(0.0)
    tree = F.when(has_tree, F.lit(settings.tree_weight)).otherwise(0.0)
    total = F.lit(settings.vector_weight) + bm25 + tree
    return F.lit(settings.vector_weight) / total, bm25 / total, tree / total


def fuse(
    vector: DataFrame,
    bm25: DataFrame | None = None,
    tree: DataFrame | None = None,
    settings: FusionSettings = FusionSettings(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """chunk_id, `keep`, score (the vector score), reranker_score, source, from (chunk_id, score) inputs.

    Each input holds at most top_k rows, so the one exchange and the weight window below see at
    most three times top_k rows however large the corpus is.
    """
    branches = [(VECTOR, vector), (BM25, bm25), (TREE, tree)]
    rows = None
    for kind, branch in branches:
        if branch is None:
            continue
        tagged = branch.select("chunk_id", *keep, F.col("score").cast("double"), F.lit(kind).alias("kind"))
        rows = tagged if rows is None else rows.unionByName(tagged)

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(kind)

    merged = rows.groupBy("chunk_id").agg(of(VECTOR), of(BM25), of(TREE), *[F.max(c).alias(c) for c in keep])
    whole = Window.partitionBy(F.lit(1))

    def seen(kind: str) -> Column:
        return F.max(F.col(kind).isNotNull()).over(whole)

    w_vector, w_bm25, w_tree = effective_weights(seen(BM25), seen(TREE), settings)
    vector_score = F.coalesce(F.col(VECTOR), F.lit(0.0))
    combined = (
        w_vector * vector_score
        + w_bm25 * F.coalesce(F.col(BM25), F.lit(0.0))
        + w_tree * F.coalesce(F.col(TREE), F.lit(0.0))
    )
    label = F.concat_ws("+", *[F.when(F.col(k).isNotNull(), F.lit(k)) for k in (VECTOR, BM25, TREE)])
    return merged.select(
        "chunk_id", *keep, vector_score.alias("score"), combined.alias("reranker_score"), label.alias("source")
    )


def with_texts(fused: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """Join the stored columns to the few candidates, drop unknown ids, and keep the best `top_k`.

    The broadcast side is bounded by three times top_k rows.
    """
    found = chunks.join(F.broadcast(fused), "chunk_id")
    return found.orderBy(F.desc("reranker_score"), "chunk_id").limit(top_k)
