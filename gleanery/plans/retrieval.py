"""The hybrid question plan over any chunk table with texts: three branches, one fusion, one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import EmbeddingSettings, Settings
from gleanery.functions.vectors import similarity
from gleanery.operators import bm25, fusion, heading_tree, vector_search
from gleanery.operators.embedding import HashingEmbedder


def vector_branch(
    chunks: DataFrame, question_vector: list[float], top_k: int, where: Column | None = None, metric: str = "cosine"
) -> DataFrame:
    hits = vector_search.search(chunks, question_vector, top_k, where, metric=metric)
    return hits.select("chunk_id", similarity(F.col("distance")).alias("score"))


def bm25_branch(scored: DataFrame, top_k: int, where: Column | None = None) -> DataFrame:
    return bm25.max_normalised(bm25.top_hits(scored, top_k, where))


def retrieve_from_texts(
    corpus: DataFrame,
    question: str,
    top_k: int = 10,
    url_filter: str | None = None,
    use_bm25: bool = True,
    use_page_index: bool = True,
    settings: Settings = Settings(),
    embedder=None,
) -> DataFrame:
    """Ranked chunks for one question straight from corpus(chunk_id, text, source_url, section_heading),
    without any stored index. Each chunk is its own tree node, named by its heading and summarised by
    the start of what follows it.

    Texts are cut into tokens once per branch on the JVM and never shuffled; what leaves a task is
    its top_k per branch and the vocabulary counts behind the keyword statistics.
    """
    embedder = embedder or HashingEmbedder(EmbeddingSettings(dimension=64))
    where = None if url_filter is None else F.col("source_url") == url_filter
    tokenised = bm25.with_tokens(corpus)
    vectors = tokenised.withColumn("embedding", embedder.of_tokens(F.col("tokens")))
    vector = vector_branch(vectors, embedder.embed_query(question), top_k, where)
    keywords = tree = None
    if use_bm25 and settings.bm25.enabled:
        keywords = bm25_branch(bm25.score_texts(tokenised, question, settings.bm25), top_k, where)
    if use_page_index:
        nodes = corpus if where is None or not settings.url_filter_covers_tree else corpus.where(where)
        tree = fusion.rank_scores(single_node_ranks(nodes, question, top_k, settings), settings.fusion)
    fused = fusion.fuse(vector, keywords, tree, settings.fusion)
    return fusion.with_texts(fused, corpus, top_k)


def single_node_summary(text: Column, preview_chars: int = 200) -> Column:
    """Start of the text after its first line, or the first line where nothing follows."""
    heading = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(heading) + 2, F.lit(preview_chars))
    return F.when(rest != "", rest).otherwise(heading)


def single_node_ranks(corpus: DataFrame, question: str, top_k: int, settings: Settings = Settings()) -> DataFrame:
    trees = corpus.select(
        F.col("chunk_id").alias("url"),
        F.array(
            F.struct(
                F.lit(0).alias("pos"),
                F.col("section_heading").alias("name"),
                single_node_summary(F.col("text"), settings.tree.preview_chars).alias("summary"),
                F.array("chunk_id").alias("chunk_ids"),
            )
        ).alias("nodes"),
    )
    return heading_tree.relevant_chunks(trees, question, top_k)
