"""Fill-in-the-middle: texts cut at two line boundaries and written with the middle last.

Where the lines of a text end is a sorted list of offsets, kept as a learned index: a piecewise-linear function of the line
number, fitted greedily so that no boundary is farther than `ERROR` code points from its prediction, and the residual of every
boundary, one byte each. A cut after k lines is the prediction of k plus its residual, which is exact. The index of a text takes
about a byte per line, so cuts for further epochs or seeds need no second pass over the lines (`boundary_index` is a table of its
own); `filled` looks up both cuts of a text in it.

Scale: one narrow projection, no shuffle. The text goes to Python once, the index comes back; cutting, writing and restoring are
string functions in the JVM. Fitting is linear in the number of lines; a batch holds one byte per byte of its texts beside them.

Defined results: null text counts as empty and is plain with 0 lines. A null doc_id counts as an empty one in the hash; rows that
repeat a doc_id are cut at the same numbers. Texts with one of the markers are plain. Texts of one line are cut at 0 or 1. Empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.generate import bound
from gleanery.llm.words import string_bytes

#: The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Residuals fit a signed byte.
ERROR = 127
INDEX = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("first", T.ArrayType(T.LongType())),
        T.StructField("base", T.ArrayType(T.LongType())),
        T.StructField("slope", T.ArrayType(T.DoubleType())),
        T.StructField("residual", T.ArrayType(T.ByteType())),
    ]
)


@dataclass(frozen=True)
class Shares:
    """seed of the hash; how many of a hundred texts are rearranged, and how many of those suffix first."""

    seed: int = 7
    moved: int = 100
    spm: int = 50


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[float], np.ndarray]:
    """First line number, offset and slope of every segment, and the residuals of all offsets.

    A segment starts at an offset and takes the following ones as long as some slope keeps all of them within the error: every
    offset allows a range of slopes, and the ranges must have one in common.
    """
    first, base, slope = [], [], []
    residuals = np.zeros(len(offsets), np.int64)
    at, n = 0, len(offsets)
    # Rounding down adds up to one to an error.
    allowed = error - 1
    while at < n:
        low, high, end, step, value = -np.inf, np.inf, at + 1, 64, 0.0
        while end < n:
            stop = min(n, end + step)
            away = np.arange(end - at, stop - at)
            rise = offsets[end:stop] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((rise - allowed) / away, low))
            highs = np.minimum.accumulate(np.minimum((rise + allowed) / away, high))
            fits = lows <= highs
            taken = len(fits) if fits.all() else int(fits.argmin())
            if taken:
                low, high = lows[taken - 1], highs[taken - 1]
            end += taken
            if taken < len(fits):
                break
            step *= 2
        if end > at + 1:
            value = (low + high) / 2
        first.append(at)
        base.append(int(offsets[at]))
        slope.append(float(value))
        residuals[at:end] = offsets[at:end] - offsets[at] - np.floor(value * np.arange(end - at)).astype(np.int64)
        at = end
    return first, base, slope, residuals


def line_offsets(values: np.ndarray) -> np.ndarray:
    """Code points before the first line and after each line of one text's bytes."""
    ends = np.flatnonzero(values == 10) + 1
    if len(values) and (not len(ends) or ends[-1] < len(values)):
        ends = np.r_[ends, len(values)]
    if not len(ends):
        return np.zeros(1, np.int64)
    # Bytes that continue a code point are 10xxxxxx.
    begins = (values & 0xC0) != 0x80
    counts = np.add.reduceat(begins, np.r_[0, ends[:-1]], dtype=np.int64)
    return np.r_[0, np.cumsum(counts)]


@F.arrow_udf(INDEX)
def index_of(text: pa.Array) -> pa.Array:
    """The learned index of every text's line boundaries."""
    values, starts = string_bytes(text)
    lines, sizes, firsts, bases, slopes = [], [], [], [], []
    residuals = [np.zeros(0, np.int8)]
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        first, base, slope, residual = fit_segments(line_offsets(values[lo:hi]))
        lines.append(len(residual) - 1)
        sizes.append(len(first))
        firsts += first
        bases += base
        slopes += slope
        residuals.append(residual.astype(np.int8))
    segments = pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32))
    boundaries = pa.array(np.r_[0, np.cumsum([n + 1 for n in lines], dtype=np.int64)].astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(lines, pa.int64()),
            pa.ListArray.from_arrays(segments, pa.array(firsts, pa.int64())),
            pa.ListArray.from_arrays(segments, pa.array(bases, pa.int64())),
            pa.ListArray.from_arrays(segments, pa.array(slopes, pa.float64())),
            pa.ListArray.from_arrays(boundaries, pa.array(np.concatenate(residuals))),
        ],
        names=["n", "first", "base", "slope", "residual"],
    )


def cut_offset(index: Column, lines: Column) -> Column:
    """Code points in the first `lines` lines: the prediction of the segment that holds the number, plus the residual."""

    def of(k: Column) -> Column:
        at = F.size(F.filter(index["first"], lambda f: f <= k)) - 1
        predicted = F.floor(F.get(index["slope"], at) * (k - F.get(index["first"], at)).cast("double"))
        return F.get(index["base"], at) + predicted + F.get(index["residual"], k.cast("int"))

    return bound(lines, of)


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers of 32 bits from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return bound(digest, lambda h: F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]))


def boundary_index(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct `row`, and `index`, the learned index of its text's lines."""
    return docs.select(F.struct(*docs.columns).alias("row"), index_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("index"))


def form_of(text: Column, drawn: Column, shares: Shares) -> Column:
    has_marker = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | has_marker | (F.get(drawn, F.lit(2)) % 100 >= shares.moved)
    return F.when(plain, "plain").when(F.get(drawn, F.lit(3)) % 100 < shares.spm, "spm").otherwise("psm")


def restored(output: Column, form: Column) -> Column:
    """The text from the output: no text that is rearranged has a marker, so the markers part it."""

    def of(parts: Column) -> Column:
        one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
        return F.when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))

    pieces = bound(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), of)
    return F.when(form == "plain", output).otherwise(pieces)


def filled(docs: DataFrame, shares: Shares = Shares()) -> DataFrame:
    """Each row of docs as the struct `row`, with n, form, prefix_chars, middle_chars and output."""
    return filled_from(boundary_index(docs), shares)


def filled_from(indexed: DataFrame, shares: Shares = Shares()) -> DataFrame:
    """`filled` from rows with a boundary index, as `boundary_index` gives them or a table keeps them."""
    drawn, text, n = F.col("drawn"), F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.col("index.n")
    rows = indexed.withColumn("drawn", draws(F.col("row.doc_id"), shares.seed))
    first, second = (F.get(drawn, F.lit(i)) % (n + 1) for i in (0, 1))
    rows = rows.select(
        "row",
        n.alias("n"),
        form_of(text, drawn, shares).alias("form"),
        cut_offset(F.col("index"), F.least(first, second)).alias("low"),
        cut_offset(F.col("index"), F.greatest(first, second)).alias("high"),
    )
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return rows.select(
        "row",
        "n",
        "form",
        F.when(moved, F.col("low")).alias("prefix_chars"),
        F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"),
        output.alias("output"),
    )


def digests(docs: DataFrame, shares: Shares = Shares()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    done = filled(docs.select("doc_id", "text"), shares)
    back = restored(F.col("output"), F.col("form"))
    return done.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )
