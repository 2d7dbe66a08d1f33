"""The stored tables of one corpus and the plans that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.config import Settings
from gleanery.functions.hashing import content_fingerprint
from gleanery.functions.tokens import keyword_tokens
from gleanery.functions.vectors import similarity
from gleanery.operators import bm25, fusion, heading_tree, vector_search
from gleanery.operators.heading_tree import NODE_TYPE
from gleanery.operators.result_cache import CACHE_SCHEMA
from gleanery.sources.keyed_table import BUCKET, KeyedTable

#: An empty file whose name ends in the number of a complete version of the statistics.
CURRENT = "_current-"
CHUNKS = (
    "source_url string, chunk_id string, seq int, text string, token_count int, title string, section_heading string, "
    "section_path string, section_level int, chunk_index int, chunk_type string, table_index int, content_hash string, "
    "dl int, embedding array<float>"
)
POSTINGS = "source_url string, chunk_id string, term string, tf bigint, dl int"
TREES = f"url string, title string, summary string, nodes array<{NODE_TYPE}>"
DOCUMENTS = (
    "url string, title string, description string, content_markdown string, plain_text string, content_hash string, "
    "metadata struct<fetched_at:double,link_count:int,table_count:int,section_count:int,etag:string,"
    "last_modified:string,status:int>"
)
URL_STATE = (
    "url string, content_hash string, etag string, last_modified string, last_fetched double, content string, "
    "metadata string"
)


class Store:
    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        root, n = settings.root, settings.url_buckets
        self.chunks = KeyedTable(spark, f"{root}/chunks", CHUNKS, "source_url", n, ("source_url", "seq"))
        # Sorted by term within a bucket, so a question reads only the row groups of its terms.
        self.postings = KeyedTable(spark, f"{root}/postings", POSTINGS, "source_url", n, ("term", "chunk_id"))
        # Document frequencies per bucket of urls: only those of rewritten buckets are counted anew.
        self.bucket_terms = KeyedTable(spark, f"{root}/bucket_terms", "term string, df bigint", "term", n, ("term",))
        self.trees = KeyedTable(spark, f"{root}/trees", TREES, "url", n)
        self.documents = KeyedTable(spark, f"{root}/documents", DOCUMENTS, "url", n)
        self.url_state = KeyedTable(spark, f"{root}/url_state", URL_STATE, "url", n)
        self.cache = KeyedTable(spark, f"{root}/result_cache", CACHE_SCHEMA, "query_hash", 1)
        self.statistics_path = f"{root}/statistics"

    # ---- keyword index

    def index_chunks(self, chunks: DataFrame) -> DataFrame:
        """Postings of chunk rows."""
        tokenised = chunks.select("source_url", "chunk_id", keyword_tokens(F.col("text")).alias("tokens"))
        return bm25.postings(tokenised, ["source_url", "chunk_id"]).withColumn("dl", F.col("dl").cast("int"))

    def refresh_statistics(self, buckets: list[int] | None = None) -> None:
        """Vocabulary and corpus statistics and the content fingerprint from the stored tables.

        Terms are counted in the postings of the rewritten `buckets` only (all by default) and summed
        over the counts of all buckets; of the chunks only lengths and hashes are read. The tables are written as a new version
        beside the old one, which a marker then replaces: a question sees one version or the other.
        """
        numbers = list(range(self.settings.url_buckets)) if buckets is None else sorted(buckets)
        counted = self.postings.read(with_bucket=True).where(F.col(BUCKET).isin(numbers))
        counted = counted.groupBy(BUCKET, "term").agg(F.count("*").alias("df"))
        self.bucket_terms.write_buckets(counted, numbers)
        frequencies = self.bucket_terms.read().groupBy("term").agg(F.sum("df").alias("df"))
        chunks = self.chunks.read()
        stats = bm25.corpus_statistics(chunks.select("dl"), frequencies)
        fingerprint = content_fingerprint(chunks).scalar()
        stats = stats.withColumn("fingerprint", fingerprint).coalesce(1)
        versions = self._versions()
        new = f"{self.statistics_path}/v{(versions[-1] if versions else 0) + 1:09d}"
        # A version without a marker is what a run left that died.
        stats.write.mode("overwrite").parquet(f"{new}/corpus")
        term_stats = bm25.term_statistics(frequencies, self.spark.read.parquet(f"{new}/corpus"), self.settings.bm25)
        # Range partitions by term: a point lookup opens one file.
        ordered = term_stats.repartitionByRange(F.col("term")).sortWithinPartitions("term")
        ordered.write.mode("overwrite").parquet(f"{new}/terms")
        self._show_version(new, versions)

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.statistics_path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """The versions of the statistics that are complete, oldest first."""
        folder, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(name.removeprefix(CURRENT)) for name in names if name.startswith(CURRENT))

    def _show_version(self, new: str, older: list[int]) -> None:
        """Questions read `new` from now on. The version before it stays for those that run."""
        folder, files = self._files()
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(folder, name)
        files.create(path(f"{CURRENT}{new.rpartition('/v')[2]}")).close()
        for version in older[:-1]:
            files.delete(path(f"{CURRENT}{version:09d}"), False)
            files.delete(path(f"v{version:09d}"), True)

    def has_index(self) -> bool:
        return bool(self._versions())

    def corpus_stats(self) -> dict:
        if not self.has_index():
            return {"n": 0, "avgdl": None, "mean_idf": None, "fingerprint": "e3b0c44298fc1c14"}
        return self.spark.read.parquet(f"{self.statistics_path}/v{self._versions()[-1]:09d}/corpus").first().asDict()

    # ---- retrieval branches

    def _chunks(self, url: str | None) -> DataFrame:
        if url is None:
            return self.chunks.read(with_bucket=True)
        return self.chunks.read_key(url, with_bucket=True)

    def retrieve(
        self, question: str, question_vector: list[float], top_k: int, url_filter: str | None = None,
        use_bm25: bool = True, use_page_index: bool = True, tree_ranks: DataFrame | None = None,
    ) -> DataFrame:
        """Ranked chunks for one question from the stored tables.

        The fused candidates, at most three times top_k, come to the driver so that their texts are
        read with literal bucket, url and id filters: the scan lists and opens only those files.
        """
        s = self.settings
        key = ("source_url",)
        hits = vector_search.search(
            self._chunks(url_filter), question_vector, top_k, metric=s.vectors.distance_metric,
            default_top_k=s.vectors.search_top_k, keep=key,
        )
        vector = hits.select("chunk_id", *key, similarity(F.col("distance")).alias("score"))
        keywords = tree = None
        if use_bm25 and s.bm25.enabled and self.has_index():
            keywords = bm25.max_normalised(self.keyword_hits(question, top_k, url_filter))
        if use_page_index:
            ranks = self.tree_ranks(question, top_k, url_filter) if tree_ranks is None else tree_ranks
            tree = fusion.rank_scores(ranks, s.fusion).withColumnRenamed("url", "source_url")
        fused = fusion.fuse(vector, keywords, tree, s.fusion, keep=key)
        candidates = fused.withColumn(BUCKET, self.chunks.bucket_of("source_url")).collect()
        local = self.spark.createDataFrame(candidates, T.StructType([*fused.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        found = self.chunks.read(with_bucket=True).where(
            F.col(BUCKET).isin(sorted({r[BUCKET] for r in candidates}))
            & F.col("source_url").isin(sorted({r["source_url"] for r in candidates}))
            & F.col("chunk_id").isin(sorted({r["chunk_id"] for r in candidates}))
        )
        return fusion.with_texts(local.drop(*key, BUCKET), found, top_k).drop(BUCKET, "embedding", "dl")

    def keyword_hits(self, question: str, top_k: int, url_filter: str | None = None) -> DataFrame:
        rows = self.postings.read() if url_filter is None else self.postings.read_key(url_filter)
        # Both tables of one version.
        version = f"{self.statistics_path}/v{self._versions()[-1]:09d}"
        terms, corpus = (self.spark.read.parquet(f"{version}/{name}") for name in ("terms", "corpus"))
        scored = bm25.score_postings(rows, terms, corpus, question, ["source_url", "chunk_id"], self.settings.bm25)
        return bm25.top_hits(scored, top_k, keep=("source_url",))

    def tree_ranks(self, question: str, top_k: int, url_filter: str | None = None) -> DataFrame:
        trees = self.trees.read()
        if url_filter is not None and self.settings.url_filter_covers_tree:
            trees = self.trees.read_key(url_filter)
        return heading_tree.relevant_chunks(trees, question, top_k)

    def search_text(self, question_vector: list[float], top_k: int | None = None, where: Column | None = None, contains: str | None = None) -> DataFrame:
        """Plain nearest-neighbour search with any metadata or text predicate, texts included."""
        s = self.settings.vectors
        chunks = self.chunks.read()
        hits = vector_search.search(
            chunks, question_vector, top_k, where, contains, s.distance_metric, default_top_k=s.search_top_k
        )
        return chunks.drop("embedding", "dl").join(F.broadcast(hits), "chunk_id").orderBy("distance", "chunk_id")
