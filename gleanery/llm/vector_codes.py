"""Vector code compression: product quantisation of integer vectors, with LAESA pivots before every exact evaluation.

Components become integers floor(SCALE * x), vectors are cut into `PARTS` equal parts, and each part position gets a codebook of at
most `ENTRIES` entries by `ROUNDS` rounds of assignment and floored means. For every part position a few entries of the first
codebook are pivots, and the distances of all parts to them are computed once and kept. In each round the distances of the
entries to the pivots give |d(part, pivot) - d(entry, pivot)| <= d(part, entry): entries are evaluated in the order of these
bounds, exactly and in integers, and those whose bound exceeds the best distance so far are never evaluated.

Scale: integers and pivot distances are written once, narrow; a round reads them, and a task sends one row of sums per part and
used entry. The codebooks (ENTRIES x dimension numbers, whatever the number of vectors) are all that tasks get and the driver
sees. Labels find their error sums by a bounded broadcast where hot, else by a join. No vector is shuffled.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of several lengths are
filled with zeros to the longest, rounded up to a multiple of PARTS. Integers beyond +-LARGEST are set to it, so that distances
fit 64 bits; label sums stop at the largest long. Rows with equal or null vec_id are rows of their own: the first codebook takes rows by vec_id (null last),
then by their integers. With fewer rows than ENTRIES the codebook is as long as the rows. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.staging import join_counted, staged

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 6
LARGEST = 1 << 20
#: Rows worked off at once: the bounds of a part are SLICE x ENTRIES single-precision numbers.
SLICE = 1024
#: Entries tried one after another, before the remaining ones are evaluated together.
FIRST = 4


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE))
    return F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def is_whole(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    finite = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros to `width`."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The first entry, then always the one farthest from those chosen (ties: the lower index)."""
    chosen = [0]
    nearest = squared(entries, entries[:1])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1:]]))
    return entries[chosen]


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, in single precision: within one part in 2**23."""
    return np.stack([np.sqrt(squared(rows, p[None, :])) for p in pivots], axis=1).astype(np.float32)


def nearest_entries(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every row (ties: the lower index), the squared distance, and how many distances were evaluated."""
    of_entries = pivot_distances(entries, pivots)
    bounds = np.abs(to_pivots[:, None, 0] - of_entries[None, :, 0])
    for p in range(1, to_pivots.shape[1]):
        np.maximum(bounds, np.abs(to_pivots[:, None, p] - of_entries[None, :, p]), out=bounds)
    # What rounding may have added, so that no bound is above the distance.
    bounds -= (to_pivots.max(axis=1)[:, None] + of_entries.max(axis=1)[None, :]) * np.float32(2.0**-20)
    n, every = len(rows), np.arange(len(rows))
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    first = min(FIRST, len(entries))
    tried = np.argpartition(bounds, first - 1, axis=1)[:, :first] if first < len(entries) else np.tile(np.arange(first), (n, 1))
    tried = np.take_along_axis(tried, np.argsort(np.take_along_axis(bounds, tried, 1), axis=1, kind="stable"), 1)
    evaluated = 0
    for column in tried.T:
        open_rows = np.flatnonzero(bounds[every, column] <= np.sqrt(best))
        evaluated += len(open_rows)
        at = column[open_rows]
        found = squared(rows[open_rows], entries[at])
        nearer = (found < best[open_rows]) | ((found == best[open_rows]) & (at < index[open_rows]))
        best[open_rows[nearer]], index[open_rows[nearer]] = found[nearer], at[nearer]
    np.put_along_axis(bounds, tried, np.inf, 1)
    owner, entry = np.nonzero(bounds <= np.sqrt(best)[:, None])
    if len(owner):
        evaluated += len(owner)
        found = squared(rows[owner], entries[entry])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(found, starts)
        lengths = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(np.where(found == np.repeat(least, lengths), entry, ENTRIES), starts)
        at = owner[starts]
        nearer = (least < best[at]) | ((least == best[at]) & (lowest < index[at]))
        best[at[nearer]], index[at[nearer]] = least[nearer], lowest[nearer]
    return index, best, evaluated


@dataclass
class Codebooks:
    """entries: per part position its entries (rows of integers); pivots: some of the entries it began with."""

    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def assigned(self, whole: np.ndarray, distances: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part position: the parts, their nearest entries and the squared distances."""
        n = len(self.pivots[0])
        for p, (entries, pivots) in enumerate(zip(self.entries, self.pivots, strict=True)):
            rows = whole[:, p * self.width : (p + 1) * self.width]
            index, best, _ = nearest_entries(rows, distances[:, p * n : (p + 1) * n], entries, pivots)
            yield rows, index, best

    def digest(self) -> str:
        numbers = ",".join(str(x) for entries in self.entries for x in entries.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def first_codebooks(kept: DataFrame) -> Codebooks | None:
    """The parts of the rows with the smallest vec_ids; None without rows."""
    longest = kept.agg(F.max(F.size("ints"))).first()[0]
    if longest is None:
        return None
    rows = kept.select("vec_id", "ints").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(ENTRIES).collect()
    width = -(-longest // PARTS)
    whole = np.array([r["ints"] + [0] * (PARTS * width - len(r["ints"])) for r in rows], np.int64)
    entries = [whole[:, p * width : (p + 1) * width] for p in range(PARTS)]
    return Codebooks(entries, [choose_pivots(e) for e in entries])


def with_pivots(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label_key, ints (all of one length), and the distances of all parts to their pivots as bytes."""
    width = books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            whole = _matrix(part.column("ints"), PARTS * width)
            cut = [whole[:, p * width : (p + 1) * width] for p in range(PARTS)]
            distances = np.hstack([pivot_distances(rows, pivots) for rows, pivots in zip(cut, books.pivots, strict=True)])
            columns = [part.column("vec_id"), part.column("label_key"), _binary(whole.astype(np.int32)), _binary(distances)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label_key", "ints", "distances"])

    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label_key string, ints binary, distances binary"
    return staged(kept.select("vec_id", "label_key", "ints").mapInArrow(run, schema), "parts")


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def moved(parts: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused entries stay."""
    width, n = books.width, len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
        for part in _slices(batches):
            whole = _numbers(part.column("ints"), np.int32).astype(np.int64)
            found = books.assigned(whole, _numbers(part.column("distances"), np.float32))
            for p, (rows, index, _) in enumerate(found):
                np.add.at(sums[p], index, rows)
                counts[p] += np.bincount(index, minlength=n)
        at, entry = np.nonzero(counts)
        columns = [pa.array(at.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[at, entry])]
        totals = pa.array(sums[at, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, totals], names=["part", "entry", "n", "sums"])

    partial = parts.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()
    entries = [e.copy() for e in books.entries]
    for row in found:
        entries[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return Codebooks(entries, books.pivots)


def fitted(parts: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    for _ in range(rounds):
        books = moved(parts, books)
    return books


def coded(parts: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label_key, code (two hex digits per part) and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            whole = _numbers(part.column("ints"), np.int32).astype(np.int64)
            found = list(books.assigned(whole, _numbers(part.column("distances"), np.float32)))
            codes = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
            errors = sum(best for _, _, best in found)
            columns = [part.column("vec_id"), part.column("label_key"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label_key", "code", "error"])

    kind = parts.schema["vec_id"].dataType.simpleString()
    return staged(parts.mapInArrow(run, f"vec_id {kind}, label_key string, code string, error long"), "codes")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """`codes` with `vector`: what the entries named by the code stand for."""
    tables = [F.array(*[F.lit(e.tolist()).cast("array<int>") for e in entries]) for entries in books.entries]
    pieces = []
    for p, entries in enumerate(tables):
        at = F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
        pieces.append(F.get(entries, at))
    return codes.withColumn("vector", F.transform(F.concat(*pieces), lambda x: x.cast("double") / SCALE))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a whole vector."""
    vector = F.col("embedding")
    # A null label is a key of its own.
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    kept = vectors.where(is_whole(vector)).select("vec_id", label.alias("label_key"), integers(vector).alias("ints"))
    books = first_codebooks(kept)
    if books is None:
        names = ("code string", "error long", "label_error long", "codebooks_sha256 string")
        return kept.selectExpr("vec_id", *[f"CAST(NULL AS {n.split()[1]}) AS {n.split()[0]}" for n in names])
    parts = with_pivots(kept, books)
    books = fitted(parts, books)
    codes = coded(parts, books)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")
    labels = staged(codes.groupBy("label_key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    found = join_counted(codes, labels, "label_key", "n", codes.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
