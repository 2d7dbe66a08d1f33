"""One ingestion run as one batch: change test, structure, chunks, vectors, index, state."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import change_detection, chunking, heading_tree, structure
from gleanery.functions.tokens import keyword_tokens, token_estimate
from gleanery.plans.store import Store
from gleanery.session import Scratch, cut_lineage, spread
from gleanery.sources.pages import as_pages


@dataclass
class IngestionReport:
    """Counters of a run; per-url rows stay a DataFrame because there may be very many."""

    urls_processed: int = 0
    urls_skipped_cached: int = 0
    urls_failed: int = 0
    urls_removed: int = 0
    total_chunks: int = 0
    total_tokens: int = 0
    duration_seconds: float = 0.0
    details: DataFrame | None = field(default=None, repr=False)
    removed_urls: DataFrame | None = field(default=None, repr=False)


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page per url: that fetched last; of equal times the larger content hash. Unknown times and hashes come first."""
    turn = F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))), F.coalesce("content_hash", F.lit("")))
    return pages.groupBy("url").agg(F.max_by(F.struct(*pages.columns), turn).alias("page")).select("page.*")


def classify(pages: DataFrame, store: Store, force: bool) -> DataFrame:
    """Extracted pages, one per url, with an `outcome`: processed (so far), cached or failed, and an `error`."""
    s = store.settings
    # Extraction comes before the first exchange, which therefore carries extracted text and no
    # html. One exchange by url serves both the removal of repeats and the join with the state.
    extracted = latest_pages(structure.extract_pages(as_pages(spread(pages, "url"))))
    compared = change_detection.with_change(extracted, store.url_state.read())
    unreachable = "cached" if s.report_unreachable_as_cached and not force else "failed"
    status = (
        F.when(F.col("status") == 304, F.lit("failed" if force else "cached"))
        .when(~F.col("fetched"), F.lit(unreachable))
        .when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.lit(not force) & ~F.col("has_changed"), F.lit("cached"))
        .otherwise(F.lit("processed"))
    )
    return compared.withColumn("outcome", status)


def ingest(
    store: Store, pages: DataFrame, embedder, force: bool = False, sync: bool = True, counter=None, tree_builder=None
) -> IngestionReport:
    """Brings the stored tables up to date with `pages` (url, html and optionally fetch columns).

    With `sync`, urls that are not among the pages are removed from every table; without it they are
    left alone. The url state is written last: a run that dies before it is simply done again, and
    every table write replaces whole urls, so repeating a run changes nothing.
    """
    started = time.perf_counter()
    with Scratch(store.spark) as scratch:
        report = _run(store, pages, embedder, force, sync, counter, tree_builder, scratch)
    report.duration_seconds = time.perf_counter() - started
    return report


def _run(store: Store, pages: DataFrame, embedder, force: bool, sync: bool, counter, tree_builder, scratch: Scratch) -> IngestionReport:
    s = store.settings
    classified = classify(pages, store, force)
    # Pages that are not processed lose their structure here and go on with nothing to cut: one pass
    # over the pages, rather than one per outcome.
    wanted = F.col("outcome") == "processed"
    emptied = {c: F.when(wanted, F.col(c)).otherwise(F.array().cast(classified.schema[c].dataType)) for c in ("sections", "tables")}
    fresh = structure.structure_documents(classified.withColumns(emptied))
    fresh = fresh.withColumn("plain_text", F.when(wanted, F.col("plain_text")))
    chunked = chunking.chunk_documents(fresh, s.chunking, counter)
    if s.min_page_tokens > 0:
        long_enough = token_estimate(F.coalesce("main_content", F.lit(""))) >= s.min_page_tokens
        chunked = chunked.withColumn("chunks", F.when(long_enough, F.col("chunks")).otherwise(F.slice("chunks", 1, 0)))
    # Materialised because several writes need it, and because the state it was compared with is
    # about to change.
    staged = scratch.table(chunked, "documents")

    # A page without chunks fails; its document is kept all the same and its old chunks stay.
    outcome = F.when((F.col("outcome") == "processed") & (F.size("chunks") == 0), "failed").otherwise(F.col("outcome"))
    staged = staged.withColumn("outcome", outcome)
    done = staged.where("outcome = 'processed'")
    details = staged.select(
        "url",
        F.col("outcome").alias("status"),
        F.when(F.col("outcome") == "processed", F.size("chunks")).otherwise(0).alias("chunks"),
        F.when(
            F.col("outcome") == "processed",
            F.aggregate("chunks", F.lit(0).cast("bigint"), lambda n, c: n + c["token_count"]),
        ).otherwise(0).alias("tokens"),
        "error",
    )
    # Narrow rows that outlive the run's scratch tables.
    details = cut_lineage(details)
    counts = change_detection.rollup(details).first()

    removed, n_removed = None, 0
    if sync:
        known = [store.url_state.read(), store.chunks.read().select(F.col("source_url").alias("url"))]
        removed = cut_lineage(change_detection.orphans(known, staged.select("url")))
        n_removed = removed.count()

    rewritten: set[int] = set()
    if counts["urls_processed"]:
        touched = done.select(F.col("url").alias("source_url"))
        chunks = chunking.exploded_chunks(done)
        postings = scratch.table(store.index_chunks(chunks), "postings")
        # Chunk length, as the keyword index sees it, next to the chunk: the corpus statistics then
        # never read texts or postings.
        embedded = chunks.withColumn("embedding", embedder.column(F.col("text"))).withColumn(
            "dl", F.size(keyword_tokens(F.col("text")))
        )
        store.chunks.replace(touched, embedded)
        rewritten.update(store.postings.replace(touched, postings))
        trees = heading_tree.tree_nodes(done, s.tree) if tree_builder is None else tree_builder(done)
        store.trees.replace(done.select("url"), trees)
    # Also pages that turned out to have no chunks.
    docs = staged.where("outcome IN ('processed', 'failed') AND plain_text IS NOT NULL")
    store.documents.replace(docs.select("url"), docs)
    if n_removed:
        gone = removed.select(F.col("url").alias("source_url"))
        store.chunks.replace(gone)
        rewritten.update(store.postings.replace(gone))
        store.trees.replace(removed)
    if rewritten:
        store.refresh_statistics(sorted(rewritten))

    seen = staged.where("outcome = 'processed' OR (outcome = 'cached' AND content_hash IS NOT NULL)")
    state = seen.select(
        "url", "content_hash", "etag", "last_modified", F.col("fetched_at").alias("last_fetched"),
        F.col("main_content").alias("content"),
        F.when(
            F.col("outcome") == "processed",
            F.to_json(F.struct("title", F.size("chunks").alias("chunk_count"))),
        ).alias("metadata"),
    )
    touched = seen.select("url") if removed is None else seen.select("url").union(removed.select("url"))
    store.url_state.replace(touched, state)
    return IngestionReport(
        **{k: int(counts[k]) for k in counts.asDict()},
        urls_removed=n_removed,
        details=details,
        removed_urls=removed,
    )

