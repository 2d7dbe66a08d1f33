"""Answers and response shapes built from the ranked results of one question (at most top_k rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT_ONLY_HEAD = "Retrieved context (no LLM generation):\n"
SOURCES_TYPE = (
    "array<struct<chunk_id:string,text:string,score:double,reranker_score:double,source:string,"
    "metadata:map<string,string>>>"
)
METADATA = ("source_url", "title", "section_heading", "section_path", "chunk_type", "content_hash")


def decimals(value: Column, places: int) -> Column:
    """Text with a fixed number of decimals, rounded by the exact binary value (half to even)."""
    return F.translate(F.format_number(value, places), ",", "")


def rounded(value: Column, places: int) -> Column:
    return decimals(value, places).cast("double")


def ranked(results: DataFrame) -> DataFrame:
    """Adds rank, 1 for the best. The window spans the top_k results of one question."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("reranker_score"), "chunk_id")
    return results.withColumn("rank", F.row_number().over(order))


def in_rank_order(results: DataFrame, **values: Column) -> DataFrame:
    """One row with an array per value, by rank; bounded by top_k."""
    entry = F.struct("rank", *[value.alias(name) for name, value in values.items()])
    rows = F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"])
    whole = ranked(results).agg(rows.alias("_rows"))
    return whole.select(*[_field(name) for name in values])


def _field(name: str) -> Column:
    return F.transform("_rows", lambda r: r[name]).alias(name)


def _context_block() -> Column:
    return F.concat(
        F.lit("--- Result "), F.col("rank").cast("string"), F.lit(" (score: "), decimals(F.col("reranker_score"), 3),
        F.lit(", source: "), F.col("source"), F.lit(") ---"),
        F.lit("\nURL: "), F.coalesce("source_url", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"),
    )


def _prompt_block() -> Column:
    section = F.when(F.coalesce("section_heading", F.lit("")) != "", F.concat(F.lit(" > "), F.col("section_heading")))
    return F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source_url", F.lit("unknown")),
        F.coalesce(section, F.lit("")), F.lit(" | relevance: "), decimals(F.col("reranker_score"), 2), F.lit("]\n"), F.col("text"),
    )


def _source(results: DataFrame) -> Column:
    present = [c for c in METADATA if c in results.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in present])
    metadata = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return F.struct("chunk_id", "text", "score", "reranker_score", "source", metadata.alias("metadata"))


def rendered(results: DataFrame) -> DataFrame:
    """One row with the context-only `answer`, the prompt `context` and the cached `sources_json`."""
    rows = in_rank_order(results, blocks=_context_block(), prompts=_prompt_block(), sources=_source(results))
    return rows.select(
        F.array_join(F.concat(F.array(F.lit(CONTEXT_ONLY_HEAD)), "blocks"), "\n").alias("answer"),
        F.array_join("prompts", "\n\n---\n\n").alias("context"),
        F.to_json("sources").alias("sources_json"),
    )


def context_only(results: DataFrame) -> DataFrame:
    """One row `answer`: the results as plain text, for use without a text generator."""
    return rendered(results).select("answer")


def prompt_context(results: DataFrame) -> DataFrame:
    """One row `context`: numbered source blocks for a text generator."""
    return rendered(results).select("context")


def sources_json(results: DataFrame) -> DataFrame:
    """One row `sources_json`: the results as they are kept in the cache."""
    return rendered(results).select("sources_json")


def source_file(url: Column) -> Column:
    """Last part of a url after trailing slashes."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]*)/*$", 1)


def search_values(results: DataFrame) -> DataFrame:
    """The result list of the search document as flat rows."""
    return ranked(results).select(
        "rank",
        rounded(F.col("score"), 4).alias("search_score"),
        rounded(F.col("reranker_score"), 4).alias("search_reranker_score"),
        F.col("text").alias("content"),
        source_file(F.col("source_url")).alias("sourcefile"),
        F.coalesce("source_url", F.lit("")).alias("doc_url"),
    )


def search_document(results: DataFrame, question: str, answer: str | Column) -> DataFrame:
    """One row `document`: the JSON search document of a response. A context-only answer is left out
    of the answers; an answer's score is the unrounded vector score of the first source."""
    answer = F.lit(answer) if isinstance(answer, str) else answer
    value = F.struct(
        rounded(F.col("score"), 4).alias("@search.score"),
        rounded(F.col("reranker_score"), 4).alias("@search.rerankerScore"),
        F.col("text").alias("Content"),
        source_file(F.col("source_url")).alias("sourcefile"),
        F.coalesce("source_url", F.lit("")).alias("doc_url"),
    )
    both = in_rank_order(results, value=value, raw=F.col("score"))
    first = F.coalesce(F.get("raw", F.lit(0)), F.lit(0.0))
    shown = (answer != "") & ~F.startswith(answer, F.lit("Retrieved context (no LLM"))
    answers = F.filter(
        F.array(F.struct(answer.alias("text"), first.alias("score"))), lambda a: shown
    )
    document = F.struct(
        F.lit(question).alias("@data.context"),
        F.size("value").alias("@data.count"),
        answers.alias("@search.answers"),
        F.col("value").alias("value"),
    )
    return both.select(F.to_json(document).alias("document"))


def sources_from_json(text: Column) -> Column:
    """The cached results again; a missing reranker_score means the score."""
    empty = F.create_map().cast("map<string,string>")
    return F.transform(
        F.from_json(text, SOURCES_TYPE),
        lambda s: s.withField("reranker_score", F.coalesce(s["reranker_score"], s["score"])).withField(
            "metadata", F.coalesce(s["metadata"], empty)
        ),
    )
