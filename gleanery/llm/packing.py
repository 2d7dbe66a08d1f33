"""Packing documents into batches: optimal length buckets, token-budget batches inside each bucket.

Every document of a bucket is padded to the bucket's bound, its longest document. Dynamic programming over the histogram of all
lengths chooses the bounds that minimise the padding; from `EXACT` tokens on it chooses among the ends of the histogram's cells, so
the bounds are the optimum among those, not among all lengths. A batch holds as many documents as fit its token budget when padded.

Scale: the histogram has exact cells up to `EXACT` tokens and cells of up to 2/`EXACT` relative width above, at most a few
thousand whatever the corpus, so it and the program run on the driver. Batches need the rank of a document within its bucket; a bucket
may hold most rows, so it is dealt by hash into groups of about `GROUP_ROWS` rows that are ranked on their own, and the groups'
row counts give the offsets. The rank is exact: only the last batch of a bucket is not full.

Defined results: null and empty texts have 0 tokens and go to the first bucket. A document longer than the budget is a batch of
its own. Repeated rows are packed as often as they occur; rows with equal order hash are ordered by doc_id. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanery.llm.staging import fresh, hash60, n_words, staged

EXACT = 128
BUCKETS = 16
BATCH_TOKENS = 65_536
GROUP_ROWS = 65_536


def length_cell(length: Column) -> Column:
    """Lengths below EXACT as they are; above, rounded up to a multiple of a power of two about length/EXACT."""
    bits = F.greatest(F.length(F.bin(length)) - F.lit(EXACT.bit_length() - 1), F.lit(0))
    step = F.pow(F.lit(2), bits).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def best_bounds(longest: Sequence[int], counts: Sequence[int], tokens: Sequence[int], buckets: int) -> list[int]:
    """Positions of the cells that end a bucket, minimising the padding over at most `buckets` buckets.

    longest, counts, tokens: of each cell in ascending order, its longest document, number of documents, sum of tokens.
    """
    n = len(longest)
    if not n:
        return []
    ends = np.asarray(longest, np.float64)
    docs = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    filled = np.concatenate([[0.0], np.cumsum(np.asarray(tokens, np.float64))])
    best = ends * docs[1:] - filled[1:]
    chosen: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        following, origin = np.empty(n), np.empty(n, np.int64)
        for j in range(n):
            # The last bucket holds the cells i+1..j; i = -1 leaves the earlier buckets empty.
            cost = ends[j] * (docs[j + 1] - docs[: j + 1]) - (filled[j + 1] - filled[: j + 1])
            cost[1:] += best[:j]
            origin[j] = np.argmin(cost) - 1
            following[j] = cost[origin[j] + 1]
        chosen.append(origin)
        best = following
    bounds, at = [n - 1], n - 1
    for origin in reversed(chosen):
        at = int(origin[at])
        if at < 0:
            break
        bounds.append(at)
    return bounds[::-1]


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """Longest document, documents and tokens of each length cell, from the column n_tokens."""
    cells = lengths.groupBy(length_cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")
    )
    return sorted((r["longest"], r["docs"], r["tokens"]) for r in cells.collect())


def pack(
    docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, tokens: Column | None = None
) -> DataFrame:
    """Each row of docs as the struct `row`, with n_tokens, bucket, bound, batch (from 0 within the bucket), slot, padding."""
    count = n_words(F.col("text").cast("string")) if tokens is None else tokens.cast("long")
    taken = fresh(docs.columns, "n_tokens")
    rows = docs.withColumn(taken, count).select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(taken).alias("n_tokens")
    )
    rows = staged(rows, "lengths")
    cells = histogram(rows.select("n_tokens"))
    ends = best_bounds([c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells], buckets)
    bounds = [cells[i][0] for i in ends] or [0]
    sizes, start = [], 0
    for end in ends or [-1]:
        sizes.append(sum(c[1] for c in cells[start : end + 1]))
        start = end + 1

    def by_bucket(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    place = hash60("pack", F.col("doc_id"))
    rows = rows.withColumn("place", place).withColumn("bound", by_bucket(bounds))
    groups = by_bucket([max(1, -(-size // GROUP_ROWS)) for size in sizes])
    rows = rows.withColumn("part", F.pmod("place", groups))
    counts = staged(rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("bucket", "part").orderBy("place", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(inner) - 1).join(offsets, ["bucket", "part"])
    fits = [max(1, batch_tokens // max(1, bound)) for bound in bounds]
    at = F.col("rank") + F.col("offset")
    return ranked.select(
        "row",
        "n_tokens",
        "bucket",
        "bound",
        F.floor(at / by_bucket(fits)).cast("long").alias("batch"),
        (at % by_bucket(fits)).cast("int").alias("slot"),
        (F.col("bound") - F.col("n_tokens")).alias("padding"),
    )
