"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import ChunkSettings, EmbeddingSettings
from gleanery.functions.generate import exploded, inlined
from gleanery.functions.hashing import chunk_id, content_fingerprint, content_hash, query_key
from gleanery.functions.tokens import token_estimate, words
from gleanery.functions.vectors import similarity
from gleanery.operators import answers, bm25, change_detection, chunking, fusion, heading_tree, result_cache
from gleanery.operators import structure, vector_search
from gleanery.operators.embedding import HashingEmbedder
from gleanery.plans.retrieval import bm25_branch, retrieve_from_texts, single_node_ranks, single_node_summary
from gleanery.session import spread, stored
from gleanery.sources.tables import document_corpus, table, web_pages

QUESTION = "What is the EN tion, erenon thnt inea? THNT"
TOP_K = 10
EMBEDDER = HashingEmbedder(EmbeddingSettings(dimension=64))
NOW = 1_704_100_000.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _r(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.with_tokens(document_corpus(spark, folder))


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).withColumn("embedding", EMBEDDER.of_tokens(F.col("tokens")))


# ---------------------------------------------------------------- keyword index


@registered
def token_counts(spark, folder):
    return _tokens(spark, folder).select(
        "chunk_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        token_estimate(F.col("text")).alias("n_estimated"),
    )


@registered
def bm25_term_stats(spark, folder):
    tokens = _tokens(spark, folder)
    frequencies = bm25.document_frequencies(tokens)
    stats = bm25.corpus_statistics(tokens.select(F.size("tokens").alias("dl")), frequencies)
    return bm25.term_statistics(frequencies, stats).select("term", "df", _r("idf").alias("idf"))


@registered
def bm25_corpus_stats(spark, folder):
    tokens = _tokens(spark, folder)
    stats = bm25.corpus_statistics(tokens.select(F.size("tokens").alias("dl")), bm25.document_frequencies(tokens))
    return stats.select("n", _r("avgdl").alias("avgdl"), _r("mean_idf").alias("mean_idf"))


@registered
def bm25_postings(spark, folder):
    rows = bm25.postings(_tokens(spark, folder), ["chunk_id"])
    return rows.groupBy("chunk_id", "dl").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("sum_tf"), F.max("tf").alias("max_tf")
    )


@registered
def bm25_topk(spark, folder):
    hits = bm25.top_hits(bm25.score_texts(_tokens(spark, folder), QUESTION), TOP_K)
    return hits.select("chunk_id", _r("score").alias("score"))


@registered
def bm25_all_scores(spark, folder):
    scored = bm25.score_texts(_tokens(spark, folder), QUESTION)
    return scored.select("chunk_id", _r("score").alias("score"))


@registered
def bm25_filtered(spark, folder):
    scored = bm25.score_texts(_tokens(spark, folder), QUESTION)
    hits = bm25.top_hits(scored, TOP_K, F.col("source_url") == "src7")
    return hits.select("chunk_id", _r("score").alias("score"))


@registered
def bm25_max_norm(spark, folder):
    hits = bm25_branch(bm25.score_texts(_tokens(spark, folder), QUESTION), TOP_K)
    return hits.select("chunk_id", _r("score").alias("score"))


@registered
def bm25_index_topk(spark, folder):
    """The same scores by way of an index: the terms of every text are counted once and stored, then read for the term
    statistics and for the terms of the question."""
    index = stored(bm25.counted(_tokens(spark, folder), ["chunk_id"]), "counts")
    terms = exploded(index, "terms", "term")
    frequencies = terms.groupBy("term").agg(F.count("*").alias("df"))
    stats = bm25.corpus_statistics(index.select("dl"), frequencies)
    asked = list(bm25.query_weights(QUESTION))
    rows = bm25.postings_of(index, ["chunk_id"], asked)
    scored = bm25.score_postings(rows, bm25.term_statistics(frequencies, stats), stats, QUESTION, ["chunk_id"])
    return bm25.top_hits(scored, TOP_K).select("chunk_id", _r("score").alias("score"))


# ---------------------------------------------------------------- vectors


@registered
def hash_embedding(spark, folder):
    vector = exploded(_embedded(spark, folder), "embedding", "value", ("chunk_id",), "idx")
    return vector.where("value <> 0").select("chunk_id", "idx", _r(F.col("value").cast("double")).alias("value"))


def _knn(spark, folder, metric: str, where: Column | None = None) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    hits = vector_search.search(
        vectors, EMBEDDER.embed_query(QUESTION), TOP_K, where, metric=metric, id_col="vec_id"
    )
    return hits.select("vec_id", _r("distance").alias("distance"))


@registered
def knn_cosine(spark, folder):
    return _knn(spark, folder, "cosine")


@registered
def knn_l2(spark, folder):
    return _knn(spark, folder, "l2")


@registered
def knn_ip(spark, folder):
    return _knn(spark, folder, "ip")


@registered
def knn_filtered(spark, folder):
    return _knn(spark, folder, "cosine", F.col("label") == 3)


@registered
def similarity_clamp(spark, folder):
    vectors = table(spark, folder, "embeddings")
    scored = vector_search.with_distance(vectors, EMBEDDER.embed_query(QUESTION), "l2")
    return scored.select("vec_id", "label", _r(similarity(F.col("distance"))).alias("score"))


@registered
def knn_document_contains(spark, folder):
    hits = vector_search.search(_embedded(spark, folder), EMBEDDER.embed_query(QUESTION), TOP_K, contains="thnt")
    return hits.select("chunk_id", _r("distance").alias("distance"))


@registered
def knn_batch(spark, folder):
    """Every benchmark text as a question against every document."""
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), EMBEDDER.column(F.col("text")).alias("query_vector")
    )
    hits = vector_search.search_many(_embedded(spark, folder), asked, 3)
    return hits.select("query_id", F.col("id").alias("chunk_id"), _r("distance").alias("distance"), "rank")


@registered
def get_by_ids(spark, folder):
    ids = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    found = vector_search.get_by_ids(document_corpus(spark, folder), ids)
    return found.select("chunk_id", "source_url", F.length("text").alias("n_chars"), "distance")


# ---------------------------------------------------------------- hybrid retrieval


def _ranked(results: DataFrame) -> DataFrame:
    return results.select(
        "chunk_id", "source_url", _r("score").alias("score"), _r("reranker_score").alias("reranker_score"), "source"
    )


def _hybrid(spark, folder, **options) -> DataFrame:
    return retrieve_from_texts(document_corpus(spark, folder), QUESTION, TOP_K, embedder=EMBEDDER, **options)


@registered
def hybrid_topk(spark, folder):
    return _ranked(_hybrid(spark, folder))


@registered
def hybrid_no_bm25(spark, folder):
    return _ranked(_hybrid(spark, folder, use_bm25=False))


@registered
def hybrid_no_tree(spark, folder):
    return _ranked(_hybrid(spark, folder, use_page_index=False))


@registered
def vector_only(spark, folder):
    return _ranked(_hybrid(spark, folder, use_bm25=False, use_page_index=False))


@registered
def hybrid_url_filter(spark, folder):
    return _ranked(_hybrid(spark, folder, url_filter="src7"))


@registered
def fusion_labels(spark, folder):
    results = retrieve_from_texts(document_corpus(spark, folder), QUESTION, 30, embedder=EMBEDDER)
    return results.groupBy("source").agg(F.count("*").alias("n"), _r(F.max("reranker_score")).alias("best"))


# ---------------------------------------------------------------- heading trees


@registered
def tree_overlap_scores(spark, folder):
    nodes = document_corpus(spark, folder).withColumn("summary", single_node_summary(F.col("text")))
    scored = heading_tree.score_nodes(nodes, QUESTION, "section_heading", "summary")
    return scored.select("chunk_id", _r("score").alias("score"))


@registered
def tree_topk(spark, folder):
    scored = fusion.rank_scores(single_node_ranks(document_corpus(spark, folder), QUESTION, 25))
    return scored.select("chunk_id", "rank", _r("score").alias("score"))


def _line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents as structured pages: every line is a section of its own. Its heading is its first
    word and its level follows from its length, which gives all kinds of level sequences."""
    corpus = document_corpus(spark, folder)
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.substring_index(line, " ", 1).alias("heading"),
            (F.length(line) % 6 + 1).cast("int").alias("level"),
            line.alias("content"),
        ),
    )
    docs = corpus.select(
        F.concat(F.lit("doc/"), "chunk_id").alias("url"),
        F.concat(F.lit("Title "), "chunk_id").alias("title"),
        F.col("section_heading").alias("description"),
        "text",
        structure.nested_sections(lines).alias("sections"),
    )
    # One chunk per line, and the whole text as a chunk that belongs to no heading.
    of_lines = F.transform(
        "sections",
        lambda s: F.struct(
            F.concat(F.col("url"), F.lit("#"), s["pos"].cast("string")).alias("chunk_id"),
            s["heading"].alias("section_heading"),
        ),
    )
    whole = F.struct(
        F.concat(F.col("url"), F.lit("#plain")).alias("chunk_id"), F.lit(None).cast("string").alias("section_heading")
    )
    return docs.withColumn("chunks", F.concat(of_lines, F.array(whole)))


@registered
def section_nesting(spark, folder):
    rows = inlined(_line_documents(spark, folder), "sections", "pos", ("url",))
    return rows.select("url", "pos", "level", "parent_pos")


@registered
def section_paths(spark, folder):
    rows = inlined(_line_documents(spark, folder), "sections", "pos", ("url",))
    return rows.select("url", "pos", "path", F.size("ancestors").alias("depth"))


@registered
def tree_nodes(spark, folder):
    rows = inlined(heading_tree.tree_nodes(_line_documents(spark, folder)), "nodes", "pos", ("url",))
    return rows.select("url", "node_id", "name", "summary", "content_preview", "level", F.size("chunk_ids").alias("n_chunks"))


@registered
def tree_node_chunks(spark, folder):
    rows = inlined(heading_tree.tree_nodes(_line_documents(spark, folder)), "nodes", "pos", ("url",))
    return exploded(rows, "chunk_ids", "chunk_id", ("url", "node_id"), "idx")


@registered
def subtree_chunks(spark, folder):
    """Chunks of the subtree below the second heading of every document."""
    trees = heading_tree.tree_nodes(_line_documents(spark, folder))
    return exploded(trees, heading_tree.subtree_chunk_ids(F.col("nodes"), "0002"), "chunk_id", ("url",), "idx")


@registered
def tree_outline(spark, folder):
    trees = heading_tree.tree_nodes(_line_documents(spark, folder))
    return trees.select("url", heading_tree.table_of_contents().alias("outline"))


@registered
def tree_json_round_trip(spark, folder):
    """Nested JSON and back; all nodes must come back as they were."""
    trees = heading_tree.tree_nodes(_line_documents(spark, folder))
    rows = inlined(heading_tree.flatten_trees(heading_tree.nested_json(trees)), "nodes", "pos", ("url",))
    return rows.select("url", "node_id", "parent_pos", "name", "level", F.size("chunk_ids").alias("n_chunks"))


@registered
def unassigned_chunks(spark, folder):
    """Chunk ids of every line under names the trees do not use, next to those they do."""
    docs = _line_documents(spark, folder)
    known = inlined(docs, "chunks", "chunk_id").select("chunk_id")
    renamed = known.select(F.concat("chunk_id", F.lit("+")).alias("chunk_id"))
    return heading_tree.unassigned_chunks(known.unionByName(renamed), heading_tree.tree_nodes(docs))


# ---------------------------------------------------------------- documents and chunks


@registered
def document_markdown(spark, folder):
    docs = _line_documents(spark, folder).select(
        "url", "title", "description", "sections",
        F.col("text").alias("main_content"),
        content_hash(F.col("text")).alias("content_hash"),
        F.length("text").cast("double").alias("fetched_at"),
        F.array().cast("array<string>").alias("tables_markdown"),
    )
    return docs.select("url", F.md5(structure.document_markdown().cast("binary")).alias("markdown_md5"))


@registered
def table_markdown(spark, folder):
    """documents as ragged tables: a row per line, a cell per blank-separated piece."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    corpus = document_corpus(spark, folder)
    return corpus.select("chunk_id", F.md5(structure.table_markdown(rows).cast("binary")).alias("markdown_md5"))


@registered
def sections_text(spark, folder):
    docs = _line_documents(spark, folder)
    text = structure.sections_text(F.col("sections"))
    return docs.select("url", F.md5(text.cast("binary")).alias("text_md5"))


@registered
def chunk_hard_split(spark, folder):
    corpus = document_corpus(spark, folder)
    rows = inlined(corpus, chunking.word_windows(F.col("text")), "start", ("chunk_id",))
    return rows.select("chunk_id", "start", "text")


@registered
def chunk_overlap(spark, folder):
    pieces = chunking.with_overlap(F.split("text", "\n"))
    corpus = document_corpus(spark, folder)
    return exploded(corpus, pieces, "text", ("chunk_id",), "idx").select("chunk_id", "idx", "text")


@registered
def chunk_ids(spark, folder):
    rows = inlined(_line_documents(spark, folder), "sections", "pos", ("url",))
    return rows.select("url", "pos", chunk_id(F.col("url"), F.col("heading"), F.col("pos")).alias("chunk_id"))


@registered
def chunk_id_repair(spark, folder):
    """Ids made from texts alone: copies collide and all but the first are repaired."""
    rows = document_corpus(spark, folder).select(
        F.col("chunk_id").cast("bigint").alias("doc_id"), "text",
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("chunk_id"),
    )
    return chunking.repair_chunk_ids(rows, "doc_id").select("doc_id", "chunk_id")


@registered
def coverage_fallback(spark, folder):
    """Which documents would have their plain text cut as well as their sections."""
    docs = _line_documents(spark, folder)
    # Sections without their short lines cover less than the whole text.
    longer = F.filter("sections", lambda s: F.length(s["content"]) > 200)
    plain = chunking.uncovered_plain_text(longer, F.col("text"))
    return docs.select("url", plain.isNotNull().alias("uncovered"))


def _structured_lines(spark, folder) -> DataFrame:
    return _line_documents(spark, folder).select(
        "url", "title", "sections", F.col("text").alias("plain_text"),
        F.array().cast("array<string>").alias("tables_markdown"),
        content_hash(F.col("text")).alias("content_hash"),
    )


@registered
def chunk_recursive(spark, folder):
    """Whole documents as plain text through the recursive splitter."""
    docs = _structured_lines(spark, folder).withColumn("sections", F.slice("sections", 1, 0))
    chunks = chunking.exploded_chunks(chunking.chunk_documents(docs))
    return chunks.select("source_url", "seq", "chunk_id", "token_count", "text", "chunk_type")


@registered
def chunk_sections(spark, folder):
    """Every line as a section: prefix, split, ids and metadata. Short pieces are dropped."""
    chunks = chunking.exploded_chunks(
        chunking.chunk_documents(_structured_lines(spark, folder), ChunkSettings(min_chunk_size=20))
    )
    return chunks.where("chunk_type = 'section'").select(
        "source_url", "seq", "section_heading", "section_path", "section_level", "chunk_index", "token_count"
    )


# ---------------------------------------------------------------- pages


def _pages(spark, folder) -> DataFrame:
    return structure.extract_pages(web_pages(spark, folder))


@registered
def html_titles(spark, folder):
    return _pages(spark, folder).select("url", "title", "description")


@registered
def html_main_text(spark, folder):
    text = F.array_join(words(F.col("main_content")), " ")
    return _pages(spark, folder).select("url", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).alias("n_chars"))


@registered
def html_links(spark, folder):
    """The links of every url, each target once. Rows that share a url are one page here: their anchors are merged by their places
    within the rows, of equal places those of the smaller page_id first."""
    pages = structure.extract_pages(spread(table(spark, folder, "pages").select("page_id", "url", "html"), "url"))
    rows = inlined(pages, "anchors", "href", ("url", "page_id"))
    place = F.struct("pos", "page_id")
    first = rows.groupBy("url", "href").agg(F.min(place).alias("place"), F.min_by("text", place).alias("text"))
    # At most the distinct targets of one url.
    idx = F.row_number().over(Window.partitionBy("url").orderBy("place", "href")) - 1
    return first.where("text <> ''").select("url", idx.alias("idx"), "text", "href")


@registered
def html_sections(spark, folder):
    rows = exploded(_pages(spark, folder), "sections", "s", ("url",), "pos")
    text = F.array_join(words(F.col("s.content")), " ")
    return rows.select("url", "pos", "s.heading", "s.level", F.md5(text.cast("binary")).alias("content_md5"))


@registered
def page_chunks(spark, folder):
    """pages all the way to chunks with vectors."""
    docs = structure.structure_documents(_pages(spark, folder))
    chunks = chunking.exploded_chunks(chunking.chunk_documents(docs))
    embedded = chunks.withColumn("embedding", EMBEDDER.column(F.col("text")))
    return embedded.select(
        "source_url", "seq", "chunk_id", "chunk_type", "token_count", F.size("embedding").alias("dimension")
    )


@registered
def page_trees(spark, folder):
    docs = structure.structure_documents(_pages(spark, folder))
    rows = inlined(heading_tree.tree_nodes(chunking.chunk_documents(docs)), "nodes", "pos", ("url",))
    return rows.select("url", "node_id", "name", "level", F.size("chunk_ids").alias("n_chunks"))


@registered
def page_metadata(spark, folder):
    docs = structure.structure_documents(_pages(spark, folder))
    return docs.select("url", "metadata.link_count", "metadata.table_count", "metadata.section_count", "metadata.status")


# ---------------------------------------------------------------- state and ingestion


def _hashed(spark, folder) -> DataFrame:
    return document_corpus(spark, folder).select(
        F.concat(F.lit("doc/"), "chunk_id").alias("url"), "source_url", "text", content_hash(F.col("text")).alias("content_hash")
    )


@registered
def content_fingerprint_of_documents(spark, folder):
    return content_fingerprint(_hashed(spark, folder))


def _earlier_state(spark, folder) -> DataFrame:
    """What an earlier run would have stored: src3 not seen yet, src5 with other texts, and urls
    that are gone by now (named after the benchmark items)."""
    docs = _hashed(spark, folder).where("source_url <> 'src3'").select(
        "url",
        F.when(F.col("source_url") == "src5", content_hash(F.concat("text", F.lit("!")))).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    gone = table(spark, folder, "benchmark").select(
        F.concat(F.lit("gone/"), F.col("item_id").cast("string")).alias("url"), content_hash(F.col("text")).alias("content_hash")
    )
    return docs.unionByName(gone)


@registered
def change_detection_status(spark, folder):
    rows = change_detection.with_change(_hashed(spark, folder).drop("text"), _earlier_state(spark, folder))
    return rows.select("url", "source_url", "is_new", "has_changed")


@registered
def ingest_rollup(spark, folder):
    rows = change_detection.with_change(_hashed(spark, folder), _earlier_state(spark, folder))
    tokens = token_estimate(F.col("text"))
    details = rows.select(
        "url",
        F.when(~F.col("has_changed"), "cached").when(tokens < 50, "failed").otherwise("processed").alias("status"),
        F.size(F.split("text", "\n")).alias("chunks"),
        tokens.alias("tokens"),
    )
    return change_detection.rollup(details)


@registered
def orphan_urls(spark, folder):
    state = _earlier_state(spark, folder)
    indexed = _hashed(spark, folder)
    return change_detection.orphans([state, indexed], indexed.select("url"))


@registered
def upsert_chunks(spark, folder):
    """Benchmark items written over the documents of the same id."""
    existing = document_corpus(spark, folder).select("chunk_id", "text")
    incoming = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return change_detection.upserted(existing, incoming, "chunk_id")


@registered
def delete_by_url(spark, folder):
    left = document_corpus(spark, folder).where(~F.col("source_url").eqNullSafe("src7"))
    return left.groupBy("source_url").agg(F.count("*").alias("n"))


@registered
def distinct_urls(spark, folder):
    return change_detection.distinct_values(document_corpus(spark, folder))


@registered
def clean_metadata(spark, folder):
    rows = document_corpus(spark, folder).select(
        "chunk_id",
        F.split("section_heading", " ").alias("heading_words"),
        F.length("text").alias("n_chars"),
        (F.length("text") > 1000).alias("is_long"),
        F.when(F.col("source_url") != "src3", F.col("source_url")).alias("source_url"),
    )
    return change_detection.clean_metadata(rows, ["heading_words", "n_chars", "is_long", "source_url"])


# ---------------------------------------------------------------- result cache


def _turns(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "conv_id", "turn", F.col("text").alias("query"),
        F.lit(8).alias("top_k"), F.col("role").alias("url_filter"),
    )


def _entries_of_turns(spark, folder) -> DataFrame:
    """One cached answer per distinct question text and role, made at its first turn. Long questions
    are of other content and those of the earliest conversations have expired."""
    turns = result_cache.with_key(_turns(spark, folder))
    first = turns.groupBy("query_hash").agg(
        F.min(F.struct("conv_id", "turn", "query", "url_filter")).alias("f"), F.count("*").alias("hit_count")
    )
    return first.select(
        "query_hash", "f.query",
        (F.lit(NOW - 90_000.0) + F.col("f.conv_id") * 200).cast("double").alias("created_at"),
        F.when(F.length("f.query") > 400, "other").otherwise("current").alias("content_fingerprint"),
        F.lit(8).alias("top_k"), "f.url_filter", "hit_count",
    )


@registered
def cache_keys(spark, folder):
    return _turns(spark, folder).select(
        "request_id", query_key(F.upper("query"), F.col("top_k"), F.col("url_filter")).alias("query_hash")
    )


@registered
def cache_exact(spark, folder):
    hits = result_cache.exact_matches(
        _entries_of_turns(spark, folder), result_cache.with_key(_turns(spark, folder)), F.lit("current"), F.lit(NOW)
    )
    kind = result_cache.hit_kind(F.col("query"), F.col("hit_query"))
    return hits.select("request_id", "query_hash", kind.alias("kind"))


@registered
def cache_validity(spark, folder):
    entries = _entries_of_turns(spark, folder)
    valid = result_cache.is_valid(F.lit("current"), F.lit(NOW))
    return entries.select("query_hash", valid.alias("valid"))


def _benchmark_entries(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_hash"),
        F.col("text").alias("query"),
        EMBEDDER.column(F.col("text")).alias("query_embedding"),
        F.lit("current").alias("content_fingerprint"),
        F.lit(NOW).alias("created_at"),
        F.when(F.length("text") > 150, 10).otherwise(5).alias("top_k"),
        F.lit("").alias("url_filter"),
    )


def _document_requests(spark, folder) -> DataFrame:
    return _embedded(spark, folder).select(
        F.col("chunk_id").alias("request_id"), F.col("embedding").alias("request_vector"),
        F.lit(8).alias("top_k"), F.lit("").alias("url_filter"),
    )


@registered
def cache_semantic_best(spark, folder):
    """The most similar benchmark item of every document."""
    best = result_cache.best_similar(_benchmark_entries(spark, folder), _document_requests(spark, folder))
    return best.select(
        F.col("query_id").alias("request_id"), "query_hash", _r("similarity").alias("similarity")
    )


@registered
def cache_semantic_usable(spark, folder):
    entries, requests = _benchmark_entries(spark, folder), _document_requests(spark, folder)
    best = result_cache.best_similar(entries, requests)
    settings = result_cache.CacheSettings(similarity_threshold=0.5)
    hits = result_cache.usable_similar(best, entries, requests, F.lit("current"), F.lit(NOW), settings)
    return hits.select(F.col("query_id").alias("request_id"), "query_hash", _r("similarity").alias("similarity"))


def _event_entries(spark, folder) -> DataFrame:
    """Events as cache entries: views were never hit, all others at the time of the event."""
    # An interval between zone-less timestamps, so the session's time zone plays no part.
    since = F.expr("CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    at = since.cast("interval second").cast("decimal(20,6)").cast("double")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("query_hash"),
        F.when(F.col("event_type") != "view", at).otherwise(0.0).alias("last_hit_at"),
        (at - F.col("value")).alias("created_at"),
        F.when(F.col("event_type") != "view", F.col("user_id")).otherwise(0).alias("hit_count"),
    )


@registered
def cache_evict(spark, folder):
    kept = result_cache.evicted(_event_entries(spark, folder))
    return kept.select("query_hash", _r("last_hit_at").alias("last_hit_at"), _r("created_at").alias("created_at"))


@registered
def cache_stats(spark, folder):
    stats = result_cache.statistics(_event_entries(spark, folder))
    return stats.withColumn("last_hit_at", _r("last_hit_at"))


@registered
def cache_store(spark, folder):
    """Documents stored into a cache that already holds the benchmark items under some of their ids."""
    columns = ["query_hash", "query", "url_filter", "hit_count", "last_hit_at", "created_at"]
    old = table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_hash"), F.col("text").alias("query"), F.lit("old").alias("url_filter"),
        F.lit(7).cast("bigint").alias("hit_count"), F.lit(NOW).alias("last_hit_at"), F.lit(1.0).alias("created_at"),
    )
    new = document_corpus(spark, folder).select(
        F.col("chunk_id").alias("query_hash"), F.col("section_heading").alias("query"), F.col("source_url").alias("url_filter"),
        F.lit(NOW).alias("created_at"),
    )
    return result_cache.stored(old.select(*columns), new).select(*columns)


# ---------------------------------------------------------------- answers


@registered
def context_only(spark, folder):
    return answers.context_only(_hybrid(spark, folder))


@registered
def prompt_context(spark, folder):
    return answers.prompt_context(_hybrid(spark, folder))


@registered
def search_values(spark, folder):
    return answers.search_values(_hybrid(spark, folder))


@registered
def search_document(spark, folder):
    """The JSON search document, read back into its parts."""
    results = _hybrid(spark, folder)
    document = answers.search_document(results, QUESTION, "An answer.")
    parsed = F.from_json(
        "document",
        "`@data.context` string, `@data.count` int, `@search.answers` array<struct<text:string,score:double>>, "
        "value array<struct<`@search.score`:double,`@search.rerankerScore`:double,Content:string,sourcefile:string,doc_url:string>>",
    )
    rows = document.select(parsed.alias("d")).select("d.*")
    return rows.select(
        F.col("`@data.context`").alias("context"), F.col("`@data.count`").alias("n"),
        F.get("`@search.answers`", F.lit(0))["text"].alias("answer"), F.posexplode("value").alias("idx", "v"),
    ).select("context", "n", "answer", "idx", F.col("v.`@search.score`").alias("score"), F.length("v.Content").alias("n_chars"), F.col("v.doc_url").alias("doc_url"))


@registered
def sources_round_trip(spark, folder):
    stored = answers.sources_json(_hybrid(spark, folder))
    rows = stored.select(F.posexplode(answers.sources_from_json(F.col("sources_json"))).alias("idx", "s"))
    return rows.select(
        "idx", "s.chunk_id", _r("s.score").alias("score"), _r("s.reranker_score").alias("reranker_score"), "s.source",
        F.col("s.metadata")["source_url"].alias("source_url"),
    )
