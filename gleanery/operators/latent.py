"""Latent semantic vectors without a model to download: the leading right singular subspace of the hashed tf-idf matrix.

A row of the matrix A is a text, a column one of `buckets` hash buckets of terms; a text's weights (1 + ln tf) * ln((1 + n) / (1 + df))
have unit length. Randomised range finding: from a fixed random thin matrix V, every round computes Z = A'(A V) and makes it
orthonormal; a last pass gives V'A'A V, whose eigenvectors turn V to the singular directions. A text's vector is its row times V.

Scale: all texts count, in the document frequencies and in every round. The buckets of a text are counted once and staged. A round is one
narrow pass over the counts: a task multiplies `BLOCK_ROWS` texts at a time by V, as a dense block over the buckets they have, and adds the
block's part of A'(A V) into a sum of its own, of which only the buckets it met are shuffled, at most `buckets` rows a task; neither
texts nor weights are shuffled. As these sums are as large for few texts as for many, a task takes `TASK_TOKENS` tokens at least. V has buckets * (dimension + oversample) numbers whatever the corpus (21 MB by default): that is
what the driver makes orthonormal and what tasks are sent. Weights, V and rows are integers (fixed point) so small that every product and sum of
a block is exact in a double, so neither the blocks, the partitions nor the order of tasks change a bit of the sums.

Defined results: a text without tokens, or null, has the zero vector; so has every text of an empty corpus. Repeated rows count repeatedly. Only
the token column is read; other columns pass through the embedder untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.batches import in_slices, slices
from gleanery.functions.generate import exploded
from gleanery.functions.tokens import keyword_tokens, keyword_tokens_of
from gleanery.functions.vectors import as_list_array
from gleanery.session import Scratch

#: Weights that are multiplied at once for vectors; a text has at most `buckets` of them.
SLICE = 1 << 13
#: Texts of a block in a round: 64 rows of at most `buckets` doubles.
BLOCK_ROWS = 64
#: Tokens of a task in a round, at least.
TASK_TOKENS = 1 << 23
#: Fixed point, bits after the point. Weights and the entries of V are columns and rows of length 1, so a sum of their products is below
#: 2^47; a block's sums of weights times rows are below 2^39, and 2^31 texts fit into the sum of all.
WEIGHT, BASIS, ROW = float(1 << 16), float(1 << 30), float(1 << 16)
_SEED = 42


@dataclass(frozen=True)
class LatentSettings:
    dimension: int = 32
    oversample: int = 8
    rounds: int = 4
    buckets: int = 1 << 16
    #: Unit vectors, as most indexes want them.
    normalize: bool = True


def buckets_of(tokens: Column, buckets: int) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def bucket_of(term: str, buckets: int) -> int:
    """The same bucket on the driver."""
    unsigned = xxhash.xxh64(term.encode("utf-8"), seed=_SEED).intdigest()
    return (unsigned - (1 << 64) if unsigned >> 63 else unsigned) % buckets


def weights_of(lists: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the rows, buckets and weights of a batch of bucket lists; each row's weights have length 1 or are all 0."""
    n, m = len(lists), len(idf)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), lengths)
    cells, tf = np.unique(owner * m + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return _weighted(cells // m, cells % m, tf, n, idf)


def _weighted(owner: np.ndarray, bucket: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weight = (1.0 + np.log(tf)) * idf[bucket]
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=n))
    weight = np.divide(weight, norm[owner], out=np.zeros_like(weight), where=norm[owner] > 0)
    return np.cumsum(np.bincount(owner, minlength=n)), bucket, weight


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE weights; a row is never cut."""
    first = 0
    while first < len(ends):
        begun = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + SLICE, side="right")))
        yield first, last
        first = last


def projected(ends: np.ndarray, bucket: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Every row times the basis. A row is summed by itself, so its result is the same in any batch."""
    rows = np.zeros((len(ends), basis.shape[1]))
    for first, last in _slices(ends):
        begun = ends[first - 1] if first else 0
        starts = np.concatenate(([begun], ends[first : last - 1])) - begun
        full = ends[first:last] - begun > starts
        if full.any():
            parts = weight[begun : ends[last - 1], None] * basis[bucket[begun : ends[last - 1]]]
            rows[first:last][full] = np.add.reduceat(parts, starts[full], axis=0)
    return rows


def counted(listed: DataFrame, buckets: int) -> DataFrame:
    """cells, counts: the distinct buckets of every text of `listed` that has some, and how often it has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            for start, length in slices(len(lists), lists.nbytes):
                some = lists.slice(start, length)
                owner = np.repeat(np.arange(length), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                cells, tf = np.unique(owner * buckets + some.flatten().to_numpy(zero_copy_only=False), return_counts=True)
                ends = np.searchsorted(cells, np.arange(length + 1) * buckets).astype(np.int32)
                made = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cells % buckets, tf)]
                yield pa.RecordBatch.from_arrays(made, names=["cells", "counts"])

    return listed.select("buckets").where(F.size("buckets") > 0).mapInArrow(count, "cells array<int>, counts array<int>")


def inverse_frequencies(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """The idf of each bucket from its counts. At most `buckets` rows come to the driver."""
    found = exploded(rows, "cells", "bucket").groupBy("bucket").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(buckets)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    return np.log((1.0 + n) / (1.0 + df))


def _add_block(total: np.ndarray, ends: np.ndarray, bucket: np.ndarray, weight: np.ndarray, basis: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Add the rows' part of A'(A V) to `total`, all of them in fixed point; the buckets they have. `place` is room for a number per bucket."""
    place[bucket] = -1
    met = np.flatnonzero(place)
    place[met] = np.arange(len(met))
    block = np.zeros((len(ends), len(met)))
    block[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), place[bucket]] = np.rint(weight * WEIGHT)
    place[met] = 0
    rows = np.rint(block @ basis[met] * (ROW / WEIGHT / BASIS))
    total[met] += (block.T @ rows).astype(np.int64)
    return met


def _round(listed: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A V) over all counted rows."""
    context = listed.sparkSession.sparkContext
    m, width = basis.shape
    sent = context.broadcast((idf, np.rint(basis * BASIS).astype(np.int32)))
    schema = pa.schema([("bucket", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = sent.value
        basis = basis.astype(np.float64)
        total, met, place = np.zeros((m, width), dtype=np.int64), np.zeros(m, dtype=bool), np.zeros(m, dtype=np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                cells, counts = (batch.column(c).slice(start, BLOCK_ROWS) for c in (0, 1))
                owner = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (cells, counts)]
                met[_add_block(total, *_weighted(owner, *flat, len(cells), idf), basis, place)] = True
        at = np.flatnonzero(met)
        for start in range(0, len(at), 4096):
            some = at[start : start + 4096]
            offsets = np.arange(0, len(some) * width + 1, width, dtype=np.int32)
            sums = pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), sums], schema=schema)

    partials = listed.mapInArrow(partial, "bucket int, sums array<bigint>")
    sums = partials.groupBy("bucket").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    found = sums.toArrow()
    product = np.zeros((m, width))
    at = found["bucket"].to_numpy()
    for i in range(width):
        product[at, i] = found[f"s{i}"].to_numpy() / (WEIGHT * ROW)
    sent.destroy()
    return product


def fit(tokenised: DataFrame, settings: LatentSettings = LatentSettings(), tokens: str = "tokens") -> "LatentEmbedder":
    """The basis of a corpus of token arrays."""
    with Scratch(tokenised.sparkSession) as scratch:
        listed = tokenised.select(buckets_of(F.col(tokens), settings.buckets).alias("buckets"))
        return fit_buckets(scratch.table(listed, "buckets"), settings)


def fit_buckets(listed: DataFrame, settings: LatentSettings = LatentSettings()) -> "LatentEmbedder":
    """The basis of a stored table with the array `buckets` of every text; its counts are staged and read once a round."""
    with Scratch(listed.sparkSession) as scratch:
        n, tokens = listed.agg(F.count("*"), F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()
        return _fitted(scratch.table(counted(listed, settings.buckets), "counts"), n, tokens, settings)


def _fitted(rows: DataFrame, n: int, tokens: int, settings: LatentSettings) -> "LatentEmbedder":
    width = settings.dimension + settings.oversample
    idf = inverse_frequencies(rows, n, settings.buckets)
    dealt = rows.coalesce(max(1, -(-tokens // TASK_TOKENS)))
    basis = np.linalg.qr(np.random.default_rng(_SEED).normal(size=(settings.buckets, width)))[0]
    for _ in range(settings.rounds):
        basis = np.linalg.qr(_round(dealt, idf, basis))[0]
    gram = basis.T @ _round(dealt, idf, basis)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-values, kind="stable")[: settings.dimension]
    directions = basis @ turn[:, best]
    # Singular vectors have no sign of their own: the largest entry is positive.
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(len(best))]
    directions *= np.where(largest < 0, -1.0, 1.0)
    return LatentEmbedder(rows.sparkSession, idf, directions, np.sqrt(np.maximum(values[best], 0.0)), settings)


class LatentEmbedder:
    """An embedding provider: `column`, `of_tokens` and `embed_query`, as the service and the retrieval plans take it."""

    def __init__(self, spark: SparkSession, idf: np.ndarray, directions: np.ndarray, singular: np.ndarray, settings: LatentSettings) -> None:
        self.spark, self.idf, self.directions, self.singular, self.settings = spark, idf, directions, singular, settings
        self._sent = spark.sparkContext.broadcast((idf, directions.astype(np.float32)))

    @property
    def dimension(self) -> int:
        return self.settings.dimension

    def of_tokens(self, tokens: Column) -> Column:
        return self.of_buckets(buckets_of(tokens, self.settings.buckets))

    def of_buckets(self, buckets: Column) -> Column:
        sent, normalize = self._sent, self.settings.normalize

        @F.arrow_udf("array<float>")
        def latent(batch: pa.Array) -> pa.Array:
            some = lambda part: as_list_array(_vectors(part, *sent.value, normalize))
            return in_slices(some, pa.list_(pa.float32()), batch)

        return latent(buckets)

    def column(self, text: Column) -> Column:
        return self.of_tokens(keyword_tokens(F.coalesce(text, F.lit(""))))

    def embed_query(self, question: str) -> list[float]:
        found = [bucket_of(t, self.settings.buckets) for t in keyword_tokens_of(question)]
        rows = _vectors(pa.array([found], pa.list_(pa.int32())), self.idf, self.directions, self.settings.normalize)
        return [float(x) for x in rows[0].astype(np.float32)]

    def save(self, path: str) -> None:
        """bucket, idf, direction rows and one row of singular values (bucket -1): at most buckets + 1 rows."""
        rows = pa.table(
            {
                "bucket": pa.array(range(-1, len(self.idf)), pa.int32()),
                "idf": pa.array(np.concatenate(([0.0], self.idf))),
                "direction": pa.array([self.singular.tolist(), *self.directions.tolist()], pa.list_(pa.float64())),
            }
        )
        self.spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: LatentSettings = LatentSettings()) -> "LatentEmbedder":
        rows = spark.read.parquet(path).orderBy("bucket").toArrow()
        directions = np.array(rows["direction"].to_pylist())
        idf = rows["idf"].to_numpy()
        if len(idf) != settings.buckets + 1 or directions.shape[1] != settings.dimension:
            raise ValueError(f"the stored basis has {len(idf) - 1} buckets and {directions.shape[1]} dimensions")
        return cls(spark, idf[1:], directions[1:], directions[0], settings)


def _vectors(lists: pa.ListArray, idf: np.ndarray, directions: np.ndarray, normalize: bool) -> np.ndarray:
    rows = projected(*weights_of(lists, idf), directions)
    if normalize:
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    return rows
