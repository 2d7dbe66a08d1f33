"""A stored trigram index for `contains`: which texts have all three-character runs of a needle.

Texts are dealt to parts by their id and stored by part. A task goes through the stored texts in runs of one part, and lists for
each trigram the ids of the run's texts that have it: a block (trigram, part, run). A text is in one run with all its trigrams, so a
needle of at least three characters intersects the blocks of its trigrams within each run and gives the candidates; their
texts alone are read and tested, so the answers are those of a full scan. Shorter needles scan the texts.

Scale: the texts move once, to their part; pairs of a text and a trigram are never shuffled. A run ends at `PART_DOCS` texts or at about
`RUN_PAIRS` pairs, so a block has at most that many ids, however common the trigram is, and a task holds one run. The blocks of a
run are sorted by trigram, so a needle reads the pages of its rarest trigrams (`MOST_TRIGRAMS` of them; the test on the text settles the
rest), and a question opens only the parts with candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.batches import slices

PART_DOCS = 4_096
MOST_PARTS = 4_096
#: Pairs of a text and a trigram in a run, or those of one slice of texts more.
RUN_PAIRS = 1 << 21
#: Ids of a batch of blocks, or one block.
BATCH_IDS = 1 << 16
#: Trigrams of a needle that are intersected: the rarest ones.
MOST_TRIGRAMS = 8
#: A code point has at most 21 bits.
_BITS = 21


def trigram_code(three: str) -> int:
    """A run of three characters as one number."""
    first, second, third = map(ord, three)
    return (first << 2 * _BITS) | (second << _BITS) | third


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct trigrams of each text, and the place of the text; by code, then place. Of a slice of texts at most."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Numbered within the slice, three characters and a place fit into one number that sorts fast.
    alphabet = np.unique(chars)
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    small, owner, size = number[chars], np.repeat(np.arange(len(texts)), lengths), len(alphabet)
    inside = owner[2:] == owner[:-2]
    pairs = ((small[:-2] * size + small[1:-1]) * size + small[2:]) * len(texts) + owner[2:]
    pairs = np.sort(pairs[inside])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    three, place = pairs // len(texts), pairs % len(texts)
    letters = alphabet.astype(np.int64)
    codes = (letters[three // (size * size)] << 2 * _BITS) | (letters[three // size % size] << _BITS) | letters[three % size]
    return codes, place


class _Run:
    """The pairs of some texts of one part."""

    def __init__(self, part: int, number: int) -> None:
        self.part, self.number = part, number
        self.ids: list[pa.Array] = []
        self.codes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.texts = self.pairs = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        codes, places = trigrams(texts)
        self.ids.append(ids)
        self.codes.append(codes)
        self.places.append((places + self.texts).astype(np.int32))
        self.texts += len(ids)
        self.pairs += len(codes)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.pairs:
            return
        codes, places, ids = np.concatenate(self.codes), np.concatenate(self.places), pa.concat_arrays(self.ids)
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(starts[1:], len(codes))
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + BATCH_IDS, side="right")))
            begun, done = starts[first], ends[last - 1]
            offsets = pa.array(np.append(starts[first:last], done) - begun, pa.int32())
            n = (ends[first:last] - starts[first:last]).astype(np.int32)
            listed = pa.ListArray.from_arrays(offsets, ids.take(pa.array(places[begun:done])))
            columns = [
                pa.array(codes[starts[first:last]]), pa.array(np.full(len(n), self.part, np.int32)),
                pa.array(np.full(len(n), self.number, np.int64)), pa.array(n), listed,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["trigram", "part", "run", "n", "ids"])
            first = last


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, part, run, n, ids of the stored texts of a task."""
    # Another task may have texts of the same part.
    number, run = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            ids, texts = batch.column("id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)
            for start, length in slices(hi - lo, texts.nbytes):
                if run is None or run.part != parts[lo] or run.texts + length > PART_DOCS or run.pairs >= RUN_PAIRS:
                    if run is not None:
                        yield from run.blocks()
                    number, run = number + 1, _Run(int(parts[lo]), number)
                run.add(ids.slice(start, length), texts.slice(start, length))
    if run is not None:
        yield from run.blocks()


class TrigramIndex:
    """Under `path`: texts/part=n (id, text, kept columns), blocks (trigram, part, run, n, ids) and frequencies (trigram, n)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, path: str, id_col: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> "TrigramIndex":
        """Write the index of df's rows; ids are unique, rows without text are left out. The texts move once, to their part."""
        index = cls(df.sparkSession, path)
        n_parts = max(1, min(MOST_PARTS, -(-df.count() // PART_DOCS)))
        rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *keep).where(F.col("text").isNotNull())
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int"))
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
        stored = index.texts().select("part", "id", "text")
        kind = stored.schema["id"].dataType.simpleString()
        blocks = stored.mapInArrow(_blocks, f"trigram bigint, part int, run bigint, n int, ids array<{kind}>")
        blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        counts = index._table("blocks").groupBy("trigram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{path}/frequencies")
        return index

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        return self._table("texts")

    def candidates(self, needle: str) -> DataFrame:
        """part, id of the texts with the needle's rarest trigrams; the needle has at least three characters."""
        wanted = sorted({trigram_code(needle[i : i + 3]) for i in range(len(needle) - 2)})
        counts = self._table("frequencies").where(F.col("trigram").isin(wanted)).orderBy("n", "trigram").collect()
        if len(counts) < len(wanted):
            return self._table("blocks").where(F.lit(False)).select("part", F.explode("ids").alias("id"))
        rare = [r["trigram"] for r in counts[:MOST_TRIGRAMS]]
        blocks = self._table("blocks").where(F.col("trigram").isin(rare))
        # At most MOST_TRIGRAMS arrays of a run meet.
        per_run = blocks.groupBy("part", "run").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(rare))
        common = F.aggregate(F.slice("lists", 2, MOST_TRIGRAMS), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return per_run.select("part", F.explode(common).alias("id"))

    def containing(self, needle: str) -> DataFrame:
        """The stored rows whose text contains the needle."""
        rows = self.texts()
        test = F.contains(F.col("text"), F.lit(needle))
        if len(needle) < 3:
            return rows.where(test).drop("part")
        found = self.candidates(needle)
        # At most MOST_PARTS numbers; the scan lists only the folders of these parts.
        parts = sorted(r[0] for r in found.select("part").distinct().collect())
        near = rows.where(F.col("part").isin(parts)).join(found, ["part", "id"], "left_semi")
        return near.where(test).drop("part")
