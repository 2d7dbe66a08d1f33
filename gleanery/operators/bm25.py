"""BM25 Okapi as relational plans: straight from texts, or from stored postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import Bm25Settings
from gleanery.functions.batches import slices
from gleanery.functions.generate import exploded
from gleanery.functions.tokens import keyword_tokens, keyword_tokens_of


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """`tokens`; a text that is null counts as one without tokens."""
    return df.withColumn("tokens", keyword_tokens(F.coalesce(F.col(text), F.lit(""))))


# Sums taken in another order differ in the last bits; rounded, equal documents tie in every run.
DECIMALS = 12

# ---------------------------------------------------------------- index tables


def postings(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (document, term): tf, and the document's length dl alongside.

    The tokens of a document sit in one row, so the partial aggregate before the exchange already
    collapses them fully: the exchange carries postings, never tokens, and a term that is in every
    document is spread over the document keys.
    """
    rows = exploded(tokenised, "tokens", "term", (*keys, F.size("tokens").alias("dl")))
    return rows.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def counted(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dl, terms, tfs: of every row its length, its distinct terms and how often it has them. No row is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for start, length in slices(len(lists), lists.nbytes):
                some = lists.slice(start, length)
                coded = some.flatten().dictionary_encode()
                owner = np.repeat(np.arange(length), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                n_terms = max(1, len(coded.dictionary))
                cells, tf = np.unique(owner * n_terms + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(cells, np.arange(length + 1) * n_terms), pa.int32())
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(cells % n_terms)))
                rest = batch.slice(start, length).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=names)

    rows = tokenised.select(*keys, F.size("tokens").alias("dl"), "tokens")
    names = [*rows.columns[:-1], "terms", "tfs"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(count, ", ".join([*fields, "terms array<string>", "tfs array<bigint>"]))


def postings_of(counted_rows: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, dl, term, tf of counted rows, for some terms; rows of the same keys and length are one document, as in `postings`."""
    pairs = F.filter(F.arrays_zip("terms", "tfs"), lambda p: p["terms"].isin(terms))
    rows = exploded(counted_rows, pairs, "p", (*keys, "dl"))
    return rows.groupBy(*keys, "dl", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("tf"))


def document_frequencies(tokenised: DataFrame) -> DataFrame:
    """term, df straight from token arrays: map-side counts, one small row per term and task."""
    terms = exploded(tokenised, F.array_distinct("tokens"), "term")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(tokenised: DataFrame) -> DataFrame:
    """term, df, length: document frequencies, and one row of null term with the number of documents
    and their total length. One pass over the texts gives all the counts behind the scores."""
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    rows = exploded(tokenised, marked, "term", (F.size("tokens").cast("bigint").alias("dl"),))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))


def term_frequencies(posting_rows: DataFrame) -> DataFrame:
    """term, df from stored postings."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def corpus_statistics(lengths: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: n, avgdl, and mean_idf (mean of the raw idf over the vocabulary)."""
    corpus = lengths.agg(F.count("*").alias("n"), F.sum("dl").cast("double").alias("total"))
    n = corpus.select("n").scalar()
    idf = frequencies.agg(F.avg(raw_idf(n.cast("double"), F.col("df"))).alias("mean_idf"))
    return corpus.select(
        "n",
        (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl"),
        idf.scalar().alias("mean_idf"),
    )


def floored_idf(raw: Column, mean_idf: Column, epsilon: float) -> Column:
    """Negative idf values become a fraction of the vocabulary's mean raw idf."""
    return F.when(raw < 0, F.lit(epsilon) * mean_idf).otherwise(raw)


def term_statistics(
    frequencies: DataFrame, statistics: DataFrame, settings: Bm25Settings = Bm25Settings()
) -> DataFrame:
    """term, df, idf for the whole vocabulary."""
    raw = raw_idf(statistics.select("n").scalar().cast("double"), F.col("df"))
    mean_idf = statistics.select("mean_idf").scalar()
    return frequencies.select("term", "df", floored_idf(raw, mean_idf, settings.epsilon).alias("idf"))


# ---------------------------------------------------------------- scoring


def saturation(tf: Column, dl: Column, avgdl: Column, settings: Bm25Settings) -> Column:
    """The tf part of the score."""
    k1, b = settings.k1, settings.b
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def query_weights(question: str) -> dict[str, int]:
    """Distinct query terms with their number of repeats: a repeated term counts repeatedly."""
    weights: dict[str, int] = {}
    for term in keyword_tokens_of(question):
        weights[term] = weights.get(term, 0) + 1
    return weights


def _count_of(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def score_texts(
    tokenised: DataFrame, question: str, settings: Bm25Settings = Bm25Settings()
) -> DataFrame:
    """All columns of `tokenised` plus `score`, without an index and without shuffling postings.

    Statistics of the corpus and of the few query terms are one-row scalar subqueries over the
    token arrays; the score is then an expression on each row.
    """
    weights = query_weights(question)
    if not weights:
        return tokenised.withColumn("score", F.lit(0.0))
    terms = list(weights)
    # Counting rows needs no column; everything else comes from one aggregate of the vocabulary.
    n = tokenised.agg(F.count("*").alias("n")).scalar().cast("double")
    is_term = F.col("term").isNotNull()
    per_term = [
        F.coalesce(F.max(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df{i}") for i, t in enumerate(terms)
    ]
    stats = vocabulary(tokenised).agg(
        F.avg(F.when(is_term, raw_idf(n, F.col("df")))).alias("mean_idf"),
        F.max(F.when(~is_term, F.col("length") / F.col("df"))).alias("avgdl"),
        *per_term,
    )
    rows = tokenised.withColumn("_stats", stats.select(F.struct("*")).scalar())
    rows = rows.withColumn("_hits", F.filter("tokens", lambda t: t.isin(terms)))
    dl = F.size("tokens").cast("double")
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        tf = _count_of("_hits", term).cast("double")
        df = F.col(f"_stats.df{i}")
        idf = floored_idf(raw_idf(n, df), F.col("_stats.mean_idf"), settings.epsilon)
        part = F.lit(float(weights[term])) * idf * saturation(tf, dl, F.col("_stats.avgdl"), settings)
        score = score + F.when(tf > 0, part).otherwise(0.0)
    return rows.withColumn("score", F.round(score, DECIMALS)).drop("_stats", "_hits")


def score_postings(
    posting_rows: DataFrame,
    term_stats: DataFrame,
    statistics: DataFrame,
    question: str,
    keys: list[str],
    settings: Bm25Settings = Bm25Settings(),
) -> DataFrame:
    """keys + `score` from stored postings. Only the postings of the query terms are read.

    The broadcast side has at most one row per distinct word of the question.
    """
    weights = query_weights(question)
    if not weights:
        return posting_rows.where(F.lit(False)).select(*keys, F.lit(0.0).alias("score"))
    terms = list(weights)
    times = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(float(weights[t])))])
    asked = term_stats.where(F.col("term").isin(terms)).select("term", "idf", times[F.col("term")].alias("times"))
    rows = posting_rows.where(F.col("term").isin(terms)).join(F.broadcast(asked), "term")
    avgdl = statistics.select("avgdl").scalar()
    part = F.col("times") * F.col("idf") * saturation(F.col("tf").cast("double"), F.col("dl").cast("double"), avgdl, settings)
    return rows.groupBy(*keys).agg(F.round(F.sum(part), DECIMALS).alias("score"))


def top_hits(
    scored: DataFrame, top_k: int, where: Column | None = None, id_col: str = "chunk_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Positive scores only, best first, ties by id.

    `where` is applied to the hits: statistics stay those of the whole corpus. The positive ones
    among the best k are the best k positive ones; testing the sign after the limit keeps Catalyst
    from pushing a second copy of the whole score down to the scan.
    """
    hits = scored if where is None else scored.where(where)
    best = hits.select(id_col, *keep, "score").orderBy(F.desc("score"), id_col).limit(top_k)
    return best.where(F.col("score") > 0)


def max_normalised(hits: DataFrame) -> DataFrame:
    """Scores divided by the best one. The window spans only the top-k hits."""
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    return hits.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(0.0))
