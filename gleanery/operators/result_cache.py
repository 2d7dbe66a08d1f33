"""The two-tier result cache as relational operators on a table of cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import CacheSettings
from gleanery.functions.hashing import query_key
from gleanery.functions.tokens import WHITESPACE
from gleanery.operators.vector_search import search_many

CACHE_SCHEMA = (
    "query_hash string, query string, query_embedding array<float>, answer string, sources_json string, "
    "content_fingerprint string, top_k int, url_filter string, created_at double, hit_count bigint, last_hit_at double"
)


def is_valid(fingerprint: Column, now: Column, settings: CacheSettings = CacheSettings(), prefix: str = "") -> Column:
    """Not older than the time to live (exactly that old still counts) and of unchanged content."""
    fresh = (now - F.col(prefix + "created_at")) <= settings.ttl_seconds
    return fresh & (F.col(prefix + "content_fingerprint") == fingerprint)


def with_key(requests: DataFrame, question: str = "query") -> DataFrame:
    return requests.withColumn("query_hash", query_key(F.col(question), F.col("top_k"), F.col("url_filter")))


def exact_matches(
    cache: DataFrame, requests: DataFrame, fingerprint: Column, now: Column, settings: CacheSettings = CacheSettings()
) -> DataFrame:
    """Requests (with query_hash) joined to their valid entry; entry columns are prefixed `hit_`."""
    valid = cache.where(is_valid(fingerprint, now, settings))
    renamed = valid.select(*[F.col(c).alias(c if c == "query_hash" else f"hit_{c}") for c in valid.columns])
    return requests.join(renamed, "query_hash")


def best_similar(
    cache: DataFrame, requests: DataFrame, request_id: str = "request_id", request_vector: str = "request_vector"
) -> DataFrame:
    """request_id, query_hash, similarity: the one most similar entry of each request.

    The arg-max runs over all entries; whether the winner may be used is decided afterwards, so a
    stale or unsuitable best entry hides a usable second one.
    """
    best = search_many(
        cache, requests, 1, "cosine", "query_hash", "query_embedding", request_id, request_vector
    )
    return best.select("query_id", F.col("id").alias("query_hash"), (1.0 - F.col("distance")).alias("similarity"))


def usable_similar(
    best: DataFrame,
    cache: DataFrame,
    requests: DataFrame,
    fingerprint: Column,
    now: Column,
    settings: CacheSettings = CacheSettings(),
    request_id: str = "request_id",
) -> DataFrame:
    """The winners that are similar enough, valid, of the same url filter and of enough results."""
    wanted = requests.select(
        F.col(request_id).alias("query_id"), F.col("top_k").alias("_top_k"), F.col("url_filter").alias("_url_filter")
    )
    near = best.where(F.col("similarity") >= settings.similarity_threshold)
    return (
        near.join(cache.where(is_valid(fingerprint, now, settings)), "query_hash")
        .join(wanted, "query_id")
        .where((F.col("top_k") >= F.col("_top_k")) & (F.col("url_filter") == F.col("_url_filter")))
        .drop("_top_k", "_url_filter")
    )


def hit_kind(asked: Column, cached: Column) -> Column:
    """"exact" when the trimmed lower-case texts agree, whichever tier found the entry."""
    normal = lambda c: F.btrim(F.lower(c), F.lit(WHITESPACE))
    return F.when(normal(asked) == normal(cached), "exact").otherwise("semantic")


def stored(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries inserted or written over; a rewritten entry keeps its first question text and url
    filter and loses its hit counters."""
    old = cache.select("query_hash", F.col("query").alias("_query"), F.col("url_filter").alias("_url_filter"))
    fresh = entries.join(old, "query_hash", "left").withColumns(
        {
            "query": F.coalesce("_query", "query"),
            "url_filter": F.coalesce("_url_filter", "url_filter"),
            "hit_count": F.lit(0).cast("bigint"),
            "last_hit_at": F.lit(0.0),
        }
    )
    untouched = cache.join(entries.select("query_hash"), "query_hash", "left_anti")
    return untouched.unionByName(fresh.select(*cache.columns))


def with_hits(cache: DataFrame, keys: list[str], now: float) -> DataFrame:
    hit = F.col("query_hash").isin(keys)
    return cache.withColumns(
        {
            "hit_count": F.col("hit_count") + F.when(hit, 1).otherwise(0),
            "last_hit_at": F.when(hit, F.lit(float(now))).otherwise(F.col("last_hit_at")),
        }
    )


def evicted(cache: DataFrame, max_entries: int = CacheSettings().max_entries, key: str = "query_hash") -> DataFrame:
    """The entries that stay: the most recently hit, then the most recently made ones.

    Entries that were never hit go first, so a new one may go at once. A top-k per task, not a
    global sort.
    """
    return cache.orderBy(F.desc("last_hit_at"), F.desc("created_at"), key).limit(max_entries)


def statistics(cache: DataFrame, settings: CacheSettings = CacheSettings()) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total_entries"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.coalesce(F.max("last_hit_at"), F.lit(0.0)).alias("last_hit_at"),
    ).withColumns(
        {
            "similarity_threshold": F.lit(settings.similarity_threshold),
            "ttl_seconds": F.lit(settings.ttl_seconds),
        }
    )
