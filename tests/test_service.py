import io
import json
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery.cli import main
from gleanery.config import CacheSettings, ChunkSettings, EmbeddingSettings, Settings
from gleanery.service import BusyError, EmptyStoreError, Gleanery
from gleanery.sources.keyed_table import BUCKET
from gleanery.sources.pages import download, fetch_pages
from gleanery.sources.trees import read_trees, write_trees
from gleanery.streaming.continuous import ingest_stream

# The fake downloads and generators of this file run on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOME = "http://x.test/home"
LOANS = "http://x.test/loans/"
EMPTY = "http://x.test/empty"


def page(title, *sections):
    body = "".join(f"<h{level}>{heading}</h{level}><p>{text}</p>" for level, heading, text in sections)
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


HOME_HTML = page(
    "Home", (1, "Saving", "saver account interest bonus rate monthly"), (2, "Goal saver", "goal saver bonus conditions apply")
)
LOANS_HTML = page("Loans", (1, "Home loans", "variable loan rate offset account"), (2, "Fees", "monthly loan fee refund"))


def make(spark, root, **changes):
    settings = Settings(
        root=str(root), url_buckets=2, chunking=ChunkSettings(min_chunk_size=2),
        embedding=EmbeddingSettings(dimension=32), **changes,
    )
    now = [1_000_000.0]
    app = Gleanery(spark, settings, clock=lambda: now[0])
    app.now = now
    return app


def pages(spark, **html):
    names = {"home": HOME, "loans": LOANS, "empty": EMPTY}
    return spark.createDataFrame([(names[k], v) for k, v in html.items()], "url string, html string")


def statuses(report):
    return {r["url"]: r["status"] for r in report.details.collect()}


@pytest.fixture
def app(spark, tmp_path):
    return make(spark, tmp_path / "store")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A filled store for tests that leave its pages alone."""
    app = make(spark, tmp_path_factory.mktemp("loaded"))
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    return app


def test_ingest_query_and_cache(spark, app):
    with pytest.raises(EmptyStoreError):
        app.query("bonus rate")
    report = app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML, empty=page("Empty")))
    assert statuses(report) == {HOME: "processed", LOANS: "processed", EMPTY: "failed"}
    assert (report.urls_processed, report.urls_failed, report.total_chunks) == (2, 1, 4)
    assert app.status()["vector_store_chunks"] == app.status()["bm25_index_chunks"] == 4

    reply = app.query("goal saver bonus", top_k=3)
    assert not reply.cache_hit and reply.model == "none"
    assert reply.sources[0]["metadata"]["section_heading"] == "Goal saver"
    assert reply.sources[0]["source"] == "vector+bm25+page_index"
    assert [s["reranker_score"] for s in reply.sources] == sorted((s["reranker_score"] for s in reply.sources), reverse=True)
    assert reply.answer.startswith("Retrieved context (no LLM generation):\n\n--- Result 1 (score: ")
    assert reply.search_schema["@data.count"] == 3 and reply.search_schema["@search.answers"] == []
    assert reply.search_schema["value"][0]["sourcefile"] == "home"

    shown = reply.reply()
    assert shown["sources"][0]["section_heading"] == "Goal saver" and shown["sources"][0]["source_url"] == HOME
    assert shown["total_time_ms"] == round(reply.total_time_ms, 1)

    again = app.query("  GOAL saver bonus ", top_k=3)
    assert again.cache_hit_type == "exact" and again.sources == reply.sources and again.answer == reply.answer
    # A smaller top_k has another key: it is found by similarity, and called exact by its text.
    assert app.query("goal saver bonus", top_k=2).cache_hit_type == "exact"
    assert app.query("bonus goal saver", top_k=2).cache_hit_type == "semantic"
    assert not app.query("goal saver bonus", top_k=4).cache_hit
    stats = app.status()["cache_stats"]
    assert stats["total_entries"] == 2 and stats["total_hits"] == 3
    assert not app.query("goal saver bonus", top_k=3, use_cache=False).cache_hit
    app.now[0] += app.settings.cache.ttl_seconds + 1
    assert not app.query("goal saver bonus", top_k=3).cache_hit


def test_reingestion_is_idempotent_and_detects_changes(spark, app):
    first = pages(spark, home=HOME_HTML, loans=LOANS_HTML)
    app.ingest(first)
    app.query("goal saver")
    before = sorted(app.store.chunks.read().select("chunk_id", "text").collect())
    assert set(statuses(app.ingest(first)).values()) == {"cached"}
    assert sorted(app.store.chunks.read().select("chunk_id", "text").collect()) == before
    changed = app.ingest(pages(spark, home=HOME_HTML.replace("monthly", "yearly"), loans=LOANS_HTML))
    assert statuses(changed) == {HOME: "processed", LOANS: "cached"}
    # Changed content makes the cached answer stale.
    assert not app.query("goal saver").cache_hit
    after = {r["text"] for r in app.store.chunks.read().collect()}
    assert any("yearly" in t for t in after) and len(after) == len(before)
    forced = app.ingest(first, force=True)
    assert forced.urls_processed == 2
    assert sorted(app.store.chunks.read().select("chunk_id", "text").collect()) == before


def test_orphans_are_removed_everywhere_in_sync_mode(spark, app):
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    merged = app.ingest(pages(spark, home=HOME_HTML), mode="merge")
    assert merged.urls_removed == 0
    report = app.ingest(pages(spark, home=HOME_HTML))
    assert report.urls_removed == 1 and [r["url"] for r in report.removed_urls.collect()] == [LOANS]
    for rows in (app.store.chunks.read(), app.store.postings.read()):
        assert {r["source_url"] for r in rows.collect()} == {HOME}
    assert {r["url"] for r in app.store.trees.read().collect()} == {HOME}
    assert {r["url"] for r in app.cached_urls().collect()} == {HOME}
    # The structured document of a removed url stays.
    assert {r["url"] for r in app.store.documents.read().collect()} == {HOME, LOANS}
    assert app.store.corpus_stats()["n"] == 2


def test_page_without_chunks_keeps_its_old_chunks(spark, app):
    app.ingest(pages(spark, home=HOME_HTML))
    report = app.ingest(pages(spark, home=page("Gone empty")))
    assert statuses(report) == {HOME: "failed"}
    assert app.store.chunks.read().count() == 2


def test_url_filter_covers_every_branch(loaded):
    app = loaded
    reply = app.query("monthly account rate", url_filter=LOANS)
    assert {s["metadata"]["source_url"] for s in reply.sources} == {LOANS}
    only = app.query("monthly account rate", use_bm25=False, use_page_index=False)
    assert {s["source"] for s in only.sources} == {"vector"}
    assert only.sources[0]["score"] == pytest.approx(only.sources[0]["reranker_score"])


def test_url_filter_prunes_to_one_bucket(loaded):
    app = loaded
    plan = app.store.chunks.read_key(LOANS)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "EqualTo(source_url," in plan


def test_clear_and_delete(spark, app):
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    app.query("account")
    app.delete_url(LOANS)
    assert {r["source_url"] for r in app.indexed_urls().collect()} == {HOME} and not app.is_cached(LOANS)
    assert app.clear(["query_cache"])["cleared"] == ["query_cache"]
    assert app.status()["cache_stats"]["total_entries"] == 0
    app.clear(["vectors"])
    assert app.health()["vector_store_chunks"] == 0
    with pytest.raises(EmptyStoreError):
        app.query("account")
    # Unchanged pages are indexed again after their vectors were cleared.
    assert app.ingest(pages(spark, home=HOME_HTML)).urls_processed == 1
    assert app.clear()["cleared"] == ["vectors", "content_cache", "query_cache"]
    assert app.cached_urls().count() == 0
    with pytest.raises(ValueError):
        app.clear(["other"])


def test_request_bounds(app):
    for question, k in (("", 8), ("x" * 2001, 8), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            app.query(question, k)
    assert app.ingest_status() == {"status": "no_data"}
    with app._ingesting:
        assert app.ingest_status() == {"status": "in_progress"}
        with pytest.raises(BusyError):
            app.ingest(None)


def test_cache_eviction_keeps_the_most_recently_hit(spark, tmp_path):
    app = make(spark, tmp_path / "s", cache=CacheSettings(max_entries=2, similarity_threshold=0.999))
    app.ingest(pages(spark, home=HOME_HTML))
    for question in ("saver", "bonus"):
        app.query(question)
        app.now[0] += 1
        assert app.query(question).cache_hit
    # Both entries were hit, the new one never was: the new one goes at once.
    app.query("rate")
    assert {r["query"] for r in app.store.cache.read().collect()} == {"saver", "bonus"}


def test_generator_builds_trees_chooses_nodes_and_answers(spark, tmp_path):
    def complete(prompt, system=None, max_tokens=0):
        if prompt.startswith("Write a table"):
            if "Title: Loans" in prompt:
                return "no json"
            ids = [line.split()[1] for line in prompt.splitlines() if line.startswith("  - ") and "tokens" in line]
            tree = {"summary": "made", "nodes": [{"node_id": "0001", "name": "All", "summary": "all", "chunk_ids": ids}]}
            return "```json\n" + json.dumps(tree) + "\n```"
        if prompt.startswith("Below"):
            return json.dumps([{"url": HOME, "node_ids": ["0001", "0009"]}, {"url": "unknown", "node_ids": ["0001"]}])
        return "Because [Source 1]."

    app = make(spark, tmp_path / "s")
    app.complete = complete
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    trees = {r["url"]: r for r in app.store.trees.read().collect()}
    assert trees[HOME]["summary"] == "made" and len(trees[HOME]["nodes"][0]["chunk_ids"]) == 2
    assert trees[LOANS]["summary"] == "Content from Loans" and len(trees[LOANS]["nodes"]) == 2
    reply = app.query("zzz unheard", top_k=5)
    assert reply.answer == "Because [Source 1]."
    assert reply.search_schema["@search.answers"][0]["text"] == reply.answer
    tree_hits = [s for s in reply.sources if "page_index" in s["source"]]
    assert {s["metadata"]["section_heading"] for s in tree_hits} == {"Saving", "Goal saver"}


def test_failing_generator_falls_back(spark, loaded):
    def complete(*_, **__):
        raise RuntimeError("down")

    reply = Gleanery(spark, loaded.settings, complete=complete).query("goal saver bonus", use_cache=False)
    assert reply.answer.startswith("Retrieved context (no LLM")
    assert reply.sources[0]["source"] == "vector+bm25+page_index"


class Reply:
    def __init__(self, text):
        self.text, self.status = text, 200
        self.headers = Headers({"ETag": '"1"'})

    def read(self):
        return self.text.encode()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


class Headers(dict):
    def get_content_charset(self):
        return None


def opener(request, timeout):
    from urllib.error import HTTPError, URLError

    if request.full_url == LOANS:
        raise URLError("down")
    if request.get_header("If-none-match") == '"1"':
        raise HTTPError(request.full_url, 304, "", {}, None)
    return Reply(HOME_HTML)


def test_conditional_download(spark, app):
    waits = []
    failed = download(LOANS, None, None, opener=opener, sleep=waits.append)
    assert failed["status"] is None and failed["html"] is None and waits == [1.0, 2.0]
    first = app.ingest_urls([HOME], opener=opener)
    assert first.urls_processed == 1 and app.cached_metadata(HOME)["etag"] == '"1"'
    assert "saver account" in app.cached_content(HOME)
    assert app.ingest_urls([HOME], opener=opener).urls_skipped_cached == 1
    assert app.ingest_urls([HOME], force=True, opener=opener).urls_processed == 1
    rows = fetch_pages(spark.createDataFrame([(HOME,)], "url string"), opener=opener, tasks=1).collect()
    assert rows[0]["status"] == 200


def test_trees_survive_the_exchange_format(spark, loaded, tmp_path):
    app = loaded
    folder = tmp_path / "trees"
    write_trees(app.store.trees.read(), str(folder))
    values = [r["value"] for r in spark.read.json(str(folder)).collect()]
    nested = tmp_path / "nested"
    nested.mkdir()
    for i, value in enumerate(values):
        (nested / f"{i}.json").write_text(value)
    assert sorted(read_trees(spark, str(nested)).collect()) == sorted(app.store.trees.read().collect())


def test_stream_merges_pages(spark, app, tmp_path):
    source = tmp_path / "in"
    pages(spark, home=HOME_HTML).write.parquet(str(source))
    stream = spark.readStream.schema("url string, html string").parquet(str(source))
    ingest_stream(app, stream, str(tmp_path / "cp"), once=True).awaitTermination()
    pages(spark, loans=LOANS_HTML).write.mode("append").parquet(str(source))
    ingest_stream(app, stream, str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r["source_url"] for r in app.indexed_urls().collect()} == {HOME, LOANS}


def test_keyed_table_drops_the_last_row_of_a_bucket(spark, app):
    table = app.store.url_state
    row = [("a", "1", None, None, 0.0, "text", None)]
    table.rewrite(spark.createDataFrame(row, table.schema))
    assert table.read(with_bucket=True).select(BUCKET).first()[0] in range(2)
    table.replace(spark.createDataFrame([("a",)], "url string"))
    assert table.read().count() == 0


def test_command_line(spark, app, tmp_path):
    table = tmp_path / "pages.parquet"
    pages(spark, home=HOME_HTML, loans=LOANS_HTML).write.parquet(str(table))
    out = io.StringIO()
    assert main(["query", "saver"], app, out) == 0
    assert "empty" in out.getvalue()
    main(["ingest", "--table", str(table)], app, out)
    assert "urls_processed: 2" in out.getvalue()
    out = io.StringIO()
    main(["query", "goal saver", "-k", "2", "--json"], app, out)
    assert json.loads(out.getvalue())["@data.count"] == 2
    answers = iter(["goal saver", "quit"])
    out = io.StringIO()
    main(["query", "-i", "-k", "2"], app, out, ask=lambda _: next(answers))
    assert "cache hit (exact)" in out.getvalue()
    out = io.StringIO()
    main(["clear", "--all"], app, out, ask=lambda _: "n")
    main(["status"], app, out)
    assert json.loads(out.getvalue())["vector_store_chunks"] == 4
    main(["clear", "--all", "--yes"], app, out)
    assert app.store.chunks.read().count() == 0


def test_chunk_rows_keep_typed_metadata(loaded):
    app = loaded
    row = app.store.chunks.read().where(F.col("source_url") == HOME).orderBy("seq").first()
    assert (row["source_url"], row["section_level"], row["chunk_index"], row["chunk_type"]) == (HOME, 1, 0, "section")
    assert len(row["embedding"]) == 32 and row["table_index"] is None
    found = app.store.search_text(app.embedder.embed_query("goal saver"), 5, F.col("section_level") == 2, "conditions")
    assert [r["section_heading"] for r in found.collect()] == ["Goal saver"]


def test_statistics_change_version_by_version(spark, tmp_path):
    """The version before stays for questions that run; an incomplete one is not seen; older ones go."""
    app = make(spark, tmp_path)
    app.ingest(pages(spark, home=HOME_HTML))
    running = spark.read.parquet(str(tmp_path / "statistics" / "v000000001" / "terms"))
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    assert app.store._versions() == [1, 2] and running.count() > 0
    (tmp_path / "statistics" / "v000000003" / "corpus").mkdir(parents=True)
    assert app.store.corpus_stats()["n"] == app.store.chunks.read().count()
    app.ingest(pages(spark, home=HOME_HTML.replace("bonus", "extra"), loans=LOANS_HTML))
    assert app.store._versions() == [2, 3] and not (tmp_path / "statistics" / "v000000001").exists()
    assert app.store.keyword_hits("loan refund", 5).count() > 0


def test_hits_at_once_are_all_counted(spark, tmp_path):
    app = make(spark, tmp_path)
    app.ingest(pages(spark, home=HOME_HTML))
    app.query("bonus interest rate", use_page_index=False)
    with ThreadPoolExecutor(3) as pool:
        replies = list(pool.map(lambda _: app.query("bonus interest rate", use_page_index=False), range(3)))
    assert all(r.cache_hit for r in replies)
    assert app.store.cache.read().first()["hit_count"] == 3


def test_a_deleted_url_is_in_no_table(spark, tmp_path):
    app = make(spark, tmp_path)
    app.ingest(pages(spark, home=HOME_HTML, loans=LOANS_HTML))
    app.delete_url(LOANS)
    store = app.store
    for table, key in ((store.chunks, "source_url"), (store.postings, "source_url"), (store.trees, "url"), (store.documents, "url"), (store.url_state, "url")):
        assert {r[0] for r in table.read().select(key).distinct().collect()} == {HOME}
    assert [r[0] for r in app.indexed_urls().collect()] == [HOME]
