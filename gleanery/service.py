"""The call surface: ingest, query, status, health and clear, with validated arguments.

Each call runs Spark jobs and brings at most top_k results or a few counters to the driver.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Settings
from gleanery.operators import answers, change_detection, reasoning, result_cache
from gleanery.operators.embedding import HashingEmbedder
from gleanery.plans.ingestion import IngestionReport, ingest
from gleanery.plans.store import Store
from gleanery.session import cut_lineage
from gleanery.sources.pages import fetch_pages

CLEAR_TARGETS = ("vectors", "cache", "query_cache", "all")


class EmptyStoreError(LookupError):
    """Nothing has been ingested yet."""


class BusyError(RuntimeError):
    """An ingestion is already running."""


@dataclass
class Response:
    answer: str
    sources: list[dict]
    query: str
    retrieval_time_ms: float
    generation_time_ms: float
    total_time_ms: float
    model: str
    cache_hit: bool = False
    cache_hit_type: str = ""
    search_schema: dict = field(default_factory=dict)

    def reply(self) -> dict:
        """The response of the query call: scores to four places, times to one."""
        sources = [
            {
                "chunk_id": s["chunk_id"],
                "text": s["text"],
                "score": round(s["score"], 4),
                "reranker_score": round(s["reranker_score"], 4),
                "source": s["source"],
                "source_url": s["metadata"].get("source_url", ""),
                "section_heading": s["metadata"].get("section_heading", ""),
            }
            for s in self.sources
        ]
        times = {k: round(v, 1) for k, v in vars(self).items() if k.endswith("_time_ms")}
        return {**vars(self), "sources": sources, **times}


def checked_request(question: str, top_k: int) -> None:
    if not 1 <= len(question) <= 2000:
        raise ValueError("question must have 1 to 2000 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")


class Gleanery:
    def __init__(
        self, spark: SparkSession, settings: Settings | None = None, embedder=None, counter=None,
        complete: reasoning.Complete | None = None, clock: Callable[[], float] = time.time,
    ) -> None:
        self.spark = spark
        self.settings = settings or Settings.load()
        self.embedder = embedder or HashingEmbedder(self.settings.embedding)
        self.counter, self.complete, self.clock = counter, complete, clock
        self.store = Store(spark, self.settings)
        self.started_at = clock()
        self.last_ingestion: IngestionReport | None = None
        self._ingesting = threading.Lock()
        # A cache write reads, changes and rewrites: two at once in this process would lose one.
        self._caching = threading.Lock()

    # ------------------------------------------------------------ ingestion

    def ingest(self, pages: DataFrame, force: bool = False, mode: str = "sync") -> IngestionReport:
        """Bring the store up to date with a table of pages. mode "sync" makes the store hold exactly
        these urls; "merge" leaves the others alone."""
        if mode not in ("sync", "merge"):
            raise ValueError("mode must be 'sync' or 'merge'")
        builder = None
        if self.complete is not None:
            builder = lambda docs: reasoning.generated_trees(docs, self.complete, self.settings.tree)
        if not self._ingesting.acquire(blocking=False):
            raise BusyError("an ingestion is already running")
        try:
            self.last_ingestion = ingest(
                self.store, pages, self.embedder, force, mode == "sync", self.counter, builder
            )
        finally:
            self._ingesting.release()
        return self.last_ingestion

    def ingest_urls(self, urls: list[str] | DataFrame, force: bool = False, mode: str = "sync", **fetch) -> IngestionReport:
        """Download the urls, conditionally unless forced, and ingest what came back."""
        asked = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        state = None if force else self.store.url_state.read()
        # A download must not be repeated by a retried or reused stage.
        pages = cut_lineage(fetch_pages(asked, state, self.settings.fetch, **fetch))
        return self.ingest(pages, force, mode)

    def ingest_status(self) -> dict:
        report = self.last_ingestion
        if self._ingesting.locked():
            return {"status": "in_progress"}
        if report is None:
            return {"status": "no_data"}
        counters = {k: v for k, v in vars(report).items() if k not in ("details", "removed_urls")}
        counters["duration_seconds"] = round(report.duration_seconds, 2)
        return {"status": "completed", **counters}

    # ------------------------------------------------------------ questions

    def query(
        self, question: str, top_k: int = 8, url_filter: str | None = None, use_page_index: bool = True,
        use_bm25: bool = True, generate_answer: bool = True, use_cache: bool = True,
    ) -> Response:
        checked_request(question, top_k)
        if not self.store.chunks.read().limit(1).count():
            raise EmptyStoreError("nothing has been ingested")
        started = time.perf_counter()
        fingerprint = self.store.corpus_stats()["fingerprint"]
        vector = self.embedder.embed_query(question)
        if use_cache:
            hit = self._cached(question, vector, fingerprint, top_k, url_filter or "")
            if hit is not None:
                kind = "exact" if hit["query"].strip().lower() == question.strip().lower() else "semantic"
                took = (time.perf_counter() - started) * 1000
                return self._response(
                    question, hit["answer"], hit["sources"], took, 0.0, cache_hit=True, cache_hit_type=kind
                )
        ranks = None
        if use_page_index and self.complete is not None:
            trees = self.store.trees.read() if url_filter is None else self.store.trees.read_key(url_filter)
            ranks = reasoning.chosen_chunks(trees, question, self.complete, top_k, self.settings.tree)
        results = self.store.retrieve(question, vector, top_k, url_filter, use_bm25, use_page_index, ranks)
        placed = answers.ranked(results).orderBy("rank")
        # The few winners become a local table: the answer and the cache row are made from them.
        results = self.spark.createDataFrame(placed.collect(), placed.schema).drop("rank")
        retrieved = time.perf_counter()
        texts = answers.rendered(results).first()
        answer, sources_json = texts["answer"], texts["sources_json"]
        if generate_answer and self.complete is not None:
            answer = reasoning.generated_answer(question, texts["context"], self.complete) or answer
        done = time.perf_counter()
        if use_cache:
            self._remember(question, vector, answer, sources_json, fingerprint, top_k, url_filter or "")
        return self._response(
            question, answer, json.loads(sources_json), (retrieved - started) * 1000, (done - retrieved) * 1000
        )

    def _response(self, question: str, answer: str, sources: list[dict], retrieval: float, generation: float, **cache) -> Response:
        shown = [
            {
                "@search.score": round(s["score"], 4),
                "@search.rerankerScore": round(s["reranker_score"], 4),
                "Content": s["text"],
                "sourcefile": s["metadata"].get("source_url", "").rstrip("/").rpartition("/")[2],
                "doc_url": s["metadata"].get("source_url", ""),
            }
            for s in sources
        ]
        spoken = bool(answer) and not answer.startswith("Retrieved context (no LLM")
        found = [{"text": answer, "score": sources[0]["score"] if sources else 0.0}] if spoken else []
        schema = {"@data.context": question, "@data.count": len(sources), "@search.answers": found, "value": shown}
        return Response(
            answer, sources, question, retrieval, generation, retrieval + generation,
            self.settings.tree.llm_model if self.complete else "none", search_schema=schema, **cache,
        )

    # ------------------------------------------------------------ result cache

    def _request(self, question: str, vector: list[float], top_k: int, url_filter: str) -> DataFrame:
        row = [("q", question, top_k, url_filter, vector)]
        schema = "request_id string, query string, top_k int, url_filter string, request_vector array<float>"
        return result_cache.with_key(self.spark.createDataFrame(row, schema))

    def _cached(self, question: str, vector: list[float], fingerprint: str, top_k: int, url_filter: str) -> dict | None:
        """The usable cache entry, exact before similar; its hit is recorded."""
        if not self.store.cache.exists():
            return None
        cache, request = self.store.cache.read(), self._request(question, vector, top_k, url_filter)
        now, s = self.clock(), self.settings.cache
        fp, at = F.lit(fingerprint), F.lit(float(now))
        wanted = ("query_hash", "query", "answer", "sources_json")
        exact = result_cache.exact_matches(cache, request.select("query_hash"), fp, at, s)
        hit = exact.select("query_hash", *[F.col(f"hit_{c}").alias(c) for c in wanted[1:]]).first()
        if hit is None:
            best = result_cache.best_similar(cache, request)
            hit = result_cache.usable_similar(best, cache, request, fp, at, s).select(*wanted).first()
        if hit is None:
            return None
        with self._caching:
            entry = self.store.cache.read().where(F.col("query_hash") == hit["query_hash"])
            kept = cut_lineage(result_cache.with_hits(entry, [hit["query_hash"]], now))
            self.store.cache.replace(kept, kept)
        return {**hit.asDict(), "sources": self._sources(hit["sources_json"])}

    @staticmethod
    def _sources(text: str) -> list[dict]:
        return [{"metadata": {}, "reranker_score": s["score"], **s} for s in json.loads(text)]

    def _remember(self, question, vector, answer, sources_json, fingerprint, top_k, url_filter) -> None:
        entry = self._request(question, vector, top_k, url_filter).select(
            "query_hash", "query", F.col("request_vector").alias("query_embedding"), F.lit(answer).alias("answer"),
            F.lit(sources_json).alias("sources_json"), F.lit(fingerprint).alias("content_fingerprint"), "top_k",
            "url_filter", F.lit(float(self.clock())).alias("created_at"),
        )
        with self._caching:
            cache = result_cache.stored(self.store.cache.read(), entry)
            self.store.cache.rewrite(cut_lineage(result_cache.evicted(cache, self.settings.cache.max_entries)))

    def invalidate_cache(self) -> None:
        self.store.cache.clear()

    # ------------------------------------------------------------ stored pages

    def cached_content(self, url: str) -> str | None:
        row = self.store.url_state.read_key(url).select("content").first()
        return None if row is None else row["content"]

    def cached_metadata(self, url: str) -> dict | None:
        row = self.store.url_state.read_key(url).select("etag", "last_modified").first()
        return None if row is None else row.asDict()

    def is_cached(self, url: str) -> bool:
        return self.cached_metadata(url) is not None

    def cached_urls(self) -> DataFrame:
        """Known urls, the most recently fetched first."""
        return self.store.url_state.read().orderBy(F.desc("last_fetched"), "url").select("url")

    def indexed_urls(self) -> DataFrame:
        """The urls that have chunks, in order."""
        return change_detection.distinct_values(self.store.chunks.read()).orderBy("source_url")

    def delete_url(self, url: str) -> None:
        """Remove one url from every table."""
        self.delete_urls(self.spark.createDataFrame([(url,)], "url string"))

    def delete_urls(self, urls: DataFrame) -> None:
        """Remove the urls of a table from every table of the store, in one rewrite of each."""
        sources = urls.select(F.col("url").alias("source_url"))
        self.store.chunks.replace(sources)
        rewritten = self.store.postings.replace(sources)
        for kept in (self.store.trees, self.store.documents, self.store.url_state):
            kept.replace(urls)
        if self.store.has_index():
            self.store.refresh_statistics(rewritten)

    # ------------------------------------------------------------ status

    def counts(self) -> DataFrame:
        """One row with the size of every table; only footers and key columns are read."""
        store = self.store
        one = lambda df: df.agg(F.count("*").alias("n")).scalar()
        return self.spark.range(1).select(
            one(store.chunks.read()).alias("vector_store_chunks"),
            F.lit(int(store.corpus_stats()["n"] or 0)).alias("bm25_index_chunks"),
            one(store.trees.read()).alias("page_index_documents"),
            one(self.indexed_urls()).alias("indexed_urls"),
        )

    def health(self) -> dict:
        return {
            "status": "ok",
            "timestamp": datetime.fromtimestamp(self.clock(), timezone.utc).isoformat(),
            "vector_store_chunks": self.store.chunks.read().count(),
            "uptime_seconds": round(self.clock() - self.started_at, 1),
        }

    def status(self) -> dict:
        s = self.settings
        return {
            **self.counts().first().asDict(),
            "embedding_model": s.embedding.model_name,
            "embedding_dimension": self.embedder.dimension,
            "chunk_size": s.chunking.chunk_size,
            "chunk_overlap": s.chunking.chunk_overlap,
            "distance_metric": s.vectors.distance_metric,
            "llm_model": s.tree.llm_model,
            "api_key_set": bool(s.llm_api_key),
            "cache_stats": result_cache.statistics(self.store.cache.read(), s.cache).first().asDict(),
            "uptime_seconds": round(self.clock() - self.started_at, 1),
        }

    def clear(self, targets: list[str] | None = None) -> dict:
        """Empty the vectors (with the indexes built from them), the content cache, or the result cache."""
        targets = targets or ["all"]
        unknown = set(targets) - set(CLEAR_TARGETS)
        if unknown:
            raise ValueError(f"unknown targets: {sorted(unknown)}")
        everything, cleared = "all" in targets, []
        if everything or "vectors" in targets:
            for table in (self.store.chunks, self.store.postings, self.store.trees):
                table.clear()
            if self.store.has_index():
                self.store.refresh_statistics()
            # Forget what was seen, or unchanged pages would never be indexed again.
            if self.store.url_state.exists():
                unknown = {c: F.lit(None).cast("string") for c in ("content_hash", "etag", "last_modified")}
                self.store.url_state.rewrite(self.store.url_state.read().withColumns(unknown))
            cleared.append("vectors")
        if everything or "cache" in targets:
            self.store.url_state.clear()
            cleared.append("content_cache")
        if everything or "query_cache" in targets:
            self.invalidate_cache()
            cleared.append("query_cache")
        return {"cleared": cleared, "message": f"Cleared: {', '.join(cleared)}"}
