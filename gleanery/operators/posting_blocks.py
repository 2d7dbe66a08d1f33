"""Stored BM25 postings in blocks that a question can skip, exactly.

Documents are dealt into ranges: first by length class, so that the documents of a range weigh a term about alike, then by hash.
A block holds the postings of one term in one range, with the largest tf and the smallest length in it; as the score's tf part
grows with tf and falls with length, they bound every posting of the block whatever the corpus statistics have become.

A question sums these bounds per range from the narrow block heads. The few ranges with the largest sums are scored first; their
k-th best score is a threshold, and ranges whose sum is below it hold no answer: their postings are never read. What remains is
scored as any postings are (`bm25.score_postings`), so the answers are those of a full scan.

Scale: there are at most `MOST_RANGES` ranges, and range numbers are all the driver sees. The counted terms of a document move once, to
its range; postings are not shuffled. A task lists whole ranges in runs of about `RUN_POSTINGS` postings; a block has about `RANGE_DOCS` of them at
most, and a term of every document has as many blocks as there are ranges. The blocks of a run are sorted by term and range, so a
question reads the pages of its terms. No text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Bm25Settings
from gleanery.operators import bm25
from gleanery.session import Scratch

RANGE_DOCS = 64
MOST_RANGES = 65_536
LENGTH_CLASSES = 64
#: Postings of a run, or those of one range more.
RUN_POSTINGS = 1 << 20
#: Postings of a batch of blocks, or one block.
BATCH_POSTINGS = 1 << 16
#: Ranges scored first.
FIRST = 8
#: Scores are rounded and summed in any order; a bound this close to the threshold is not below it.
SLACK = 1e-9


@dataclass(frozen=True)
class Pruned:
    """Answers, and how many of the ranges with a term of the question were read for them."""

    hits: DataFrame
    ranges: int
    read: int


def _range_of(lengths: DataFrame, keys: list[str]) -> Column:
    """The range of a document by its length `dl` and its keys, for documents like those of `lengths`."""
    shares = [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)]
    edges = lengths.agg(F.percentile_approx("dl", F.array(*[F.lit(s) for s in shares]), 10_000)).first()[0] or []
    edges = sorted(set(edges))
    size_class = F.size(F.filter(F.lit(edges).cast("array<int>"), lambda edge: edge < F.col("dl"))) if edges else F.lit(0)
    counts = {r[0]: r[1] for r in lengths.groupBy(size_class.alias("c")).count().collect()}
    docs = max(RANGE_DOCS, -(-sum(counts.values()) // (MOST_RANGES - LENGTH_CLASSES)))
    ranges = [max(1, -(-counts.get(c, 0) // docs)) for c in range(len(edges) + 1)]
    starts = [sum(ranges[:c]) for c in range(len(ranges))]
    number = lambda values: F.get(F.lit(values).cast("array<int>"), size_class)
    return (number(starts) + F.pmod(F.xxhash64(*keys), number(ranges))).cast("int")


class _Run:
    """The counted rows of some whole ranges, by range, keys and length."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys
        self.rows: list[pa.RecordBatch] = []
        self.entries = 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)
        self.entries += len(rows.column("terms").flatten())

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """Blocks by term and range."""
        if not self.entries:
            return
        rows = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
        self.rows = []
        # Rows of the same keys and length follow each other: they are one document.
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in ("range", "dl", *self.keys):
            codes = rows.column(name).dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        first, document = np.flatnonzero(new), np.cumsum(new) - 1
        numbers, lengths = (rows.column(c).to_numpy()[first] for c in ("range", "dl"))
        coded = rows.column("terms").flatten().dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        cells = rank[coded.indices.to_numpy()] * len(first) + np.repeat(document, rows.column("terms").value_lengths().to_numpy())
        order = np.argsort(cells, kind="stable")
        cells, tf = cells[order], rows.column("tfs").flatten().to_numpy()[order]
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        cells, tf = cells[starts], np.add.reduceat(tf, starts)
        term, document = cells // len(first), cells % len(first)
        begins = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(numbers[document], prepend=-1) != 0))
        ends = np.append(begins[1:], len(cells))
        dl = lengths[document]
        most, least = np.maximum.reduceat(tf, begins), np.minimum.reduceat(dl, begins)
        held = [rows.column(k).take(pa.array(first)) for k in self.keys]
        at = 0
        while at < len(begins):
            last = max(at + 1, int(np.searchsorted(ends, begins[at] + BATCH_POSTINGS, side="right")))
            lo, hi = begins[at], ends[last - 1]
            taken = pa.array(document[lo:hi])
            listed = pa.StructArray.from_arrays([*[k.take(taken) for k in held], pa.array(tf[lo:hi]), pa.array(dl[lo:hi])], names=[*self.keys, "tf", "dl"])
            columns = [
                coded.dictionary.take(pa.array(by_name[term[begins[at:last]]])), pa.array(numbers[document[begins[at:last]]]),
                pa.array(ends[at:last] - begins[at:last]), pa.array(most[at:last]), pa.array(least[at:last]),
                pa.ListArray.from_arrays(pa.array(np.append(begins[at:last], hi) - lo, pa.int32()), listed),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "max_tf", "min_dl", "postings"])
            at = last


def _runs(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = _Run(keys), None
        for batch in batches:
            numbers = batch.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo and numbers[lo] != at:
                    at = numbers[lo]
                    if held.entries >= RUN_POSTINGS:
                        yield from held.blocks()
                        held = _Run(keys)
                held.add(batch.slice(lo, hi - lo))
        yield from held.blocks()

    return run


def blocks_of(counted: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """term, range, n, max_tf, min_dl, postings: of counted rows (`bm25.counted`); lengths: dl and keys of every document.

    The counts move once, to their range; the ranges of a task are listed in runs, each by term and range.
    """
    rows = counted.withColumn("range", _range_of(lengths, keys)).repartition("range").sortWithinPartitions("range", *keys, "dl")
    kinds = {f.name: f.dataType.simpleString() for f in counted.schema.fields}
    fields = ", ".join([*[f"`{k}`: {kinds[k]}" for k in keys], "tf: bigint", "dl: int"])
    schema = f"term string, range int, n bigint, max_tf bigint, min_dl int, postings array<struct<{fields}>>"
    return rows.mapInArrow(_runs(keys), schema)


class PostingBlocks:
    """The tables under `path`: blocks, terms (term, df, idf) and corpus (n, avgdl, mean_idf)."""

    def __init__(self, spark: SparkSession, path: str, settings: Bm25Settings = Bm25Settings()) -> None:
        self.spark, self.path, self.settings = spark, path, settings

    @classmethod
    def build(cls, tokenised: DataFrame, path: str, keys: list[str], settings: Bm25Settings = Bm25Settings()) -> "PostingBlocks":
        """Write the tables from documents with `tokens`: one pass over the tokens, whose counts are staged."""
        index = cls(tokenised.sparkSession, path, settings)
        with Scratch(tokenised.sparkSession) as scratch:
            counted = scratch.table(bm25.counted(tokenised, keys), "counts")
            counted.select(*keys, "dl").write.mode("overwrite").parquet(f"{path}/lengths")
            lengths = index._table("lengths")
            blocks_of(counted, lengths, keys).write.mode("overwrite").parquet(f"{path}/blocks")
        frequencies = index._table("blocks").groupBy("term").agg(F.sum("n").alias("df"))
        stats = bm25.corpus_statistics(lengths, frequencies)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        terms = bm25.term_statistics(frequencies, index._table("corpus"), settings)
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        return index

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def heads(self, question: str) -> DataFrame:
        """range, bound: of every range with a term of the question, what a document in it scores at most."""
        weights = bm25.query_weights(question)
        terms = list(weights)
        times = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(float(weights[t])))])
        # One row per distinct word of the question.
        asked = self._table("terms").where(F.col("term").isin(terms)).select("term", (times[F.col("term")] * F.col("idf")).alias("weight"))
        avgdl = self._table("corpus").select("avgdl").scalar()
        most = bm25.saturation(F.col("max_tf").cast("double"), F.col("min_dl").cast("double"), avgdl, self.settings)
        rows = self._table("blocks").where(F.col("term").isin(terms)).select("term", "range", "max_tf", "min_dl")
        # A term of negative weight only lowers a score.
        part = F.greatest(F.lit(0.0), F.col("weight")) * most
        return rows.join(F.broadcast(asked), "term").groupBy("range").agg(F.sum(part).alias("bound"))

    def scores(self, question: str, ranges: list[int], keys: list[str]) -> DataFrame:
        """keys, score of the documents of these ranges that have a term of the question."""
        rows = self._table("blocks").where(F.col("term").isin(list(bm25.query_weights(question))) & F.col("range").isin(ranges))
        rows = rows.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        return bm25.score_postings(rows, self._table("terms"), self._table("corpus"), question, keys, self.settings)

    def search(self, question: str, top_k: int, where: Column | None = None, keys: tuple[str, ...] = ("chunk_id",)) -> Pruned:
        """The top_k hits, best first, ties by the first key; `where` is a filter on the keys."""
        names = list(keys)
        if not bm25.query_weights(question):
            empty = self._table("lengths").select(*names, F.lit(0.0).alias("score")).where(F.lit(False))
            return Pruned(empty, 0, 0)

        def best(ranges: list[int]) -> DataFrame:
            return bm25.top_hits(self.scores(question, ranges, names), top_k, where, names[0], keep=tuple(names[1:]))

        # At most MOST_RANGES pairs of a number and a bound.
        bounds = sorted(((r["bound"], r["range"]) for r in self.heads(question).collect()), key=lambda b: (-b[0], b[1]))
        first = [number for _, number in bounds[:FIRST]]
        scores = [r["score"] for r in best(first).select("score").collect()]
        least = min(scores) - SLACK if len(scores) == top_k else float("-inf")
        needed = [number for bound, number in bounds if bound >= least]
        return Pruned(best(needed), len(bounds), len(needed))
