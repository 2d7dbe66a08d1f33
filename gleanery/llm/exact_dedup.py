"""Exact duplicates by a minimal perfect hash over the distinct digests of the history.

The index is cut into buckets of about `BUCKET_DIGESTS` distinct digests. A bucket is one row: the perfect hash, and for each
slot the full digest, the winner's doc_id and the number of rows. A look-up compares all 32 bytes of the slot's digest with its
own; rows whose digest is not in the history are grouped separately, by digest.

Scale: texts are read once and never shuffled by the query; what moves are 32-byte digests and ids. Copies collapse on the map
side before the index is built. In a look-up a task holds one bucket and streams over its rows; a digest that more than
1/`HOT_GROUPS` of all rows share (so at most `HOT_GROUPS` of them, which bounds the broadcast list) is dealt over `SALTS` tasks,
and its bucket copied to each.

Defined results: a null text counts as empty; equal means identical after lower-casing A-Z. The largest doc_id stays; null ids
stay only where a group has no other id. Rows that share doc_id and text are one document: all of them are marked kept, and
`drop_copies` returns one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.perfect_hash import PerfectHash, as_words
from gleanery.llm.staging import fresh, staged
from gleanery.llm.words import lower_ascii, string_bytes

BUCKET_DIGESTS = 1024
HOT_GROUPS = 10_000
HOT_LEAST = 4096
SALTS = 32

_INDEX = "bucket long, sizes binary, bits binary, digests binary, winners binary, known binary, counts binary"
_LOOKED = "doc_id long, digest binary, keep_id long, group_size long, member boolean"


def text_digests(column: pa.Array) -> pa.Array:
    """SHA-256 of each text after lower-casing A-Z."""
    values, offsets = string_bytes(column)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(hashlib.sha256(lower_ascii(values[lo:hi])).digest())
    return pa.array(out, pa.binary())


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, and the digest's first bits as `slice`, which bucket and partition follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = text_digests(batch.column(1))
            first = [int.from_bytes(d[16:20], "little") >> 1 for d in digests.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), digests, pa.array(first, pa.int64())], names=["doc_id", "digest", "slice"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, digest binary, slice long")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the winner and the number of rows, combined on the map side."""
    return rows.groupBy("digest", "slice").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The buckets of the index over the rows of `groups`."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        digests = rows["digest"].to_pylist()
        keys = as_words(digests)
        hashed = PerfectHash.build(keys)
        at = hashed.slots(keys)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        winners = rows["winner"].to_pylist()
        known = np.array([w is not None for w in winners], np.uint8)
        ids = np.array([w or 0 for w in winners], np.int64)
        sizes, bits = hashed.to_bytes()
        row = {
            "bucket": key[0].as_py(),
            "sizes": sizes,
            "bits": bits,
            "digests": keys[order].tobytes(),
            "winners": ids[order].tobytes(),
            "known": known[order].tobytes(),
            "counts": rows["n"].to_numpy()[order].tobytes(),
        }
        return pa.table({k: pa.array([v], pa.int64() if k == "bucket" else pa.binary()) for k, v in row.items()})

    keyed = distinct.select(F.pmod("slice", F.lit(buckets)).alias("bucket"), "digest", "winner", "n")
    return keyed.groupBy("bucket").applyInArrow(build, _INDEX)


class _Bucket:
    def __init__(self, row: dict) -> None:
        self.hashed = PerfectHash.from_bytes(row["sizes"], row["bits"])
        self.digests = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        self.winners = np.frombuffer(row["winners"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.counts = np.frombuffer(row["counts"], np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the slot's digest has the same bytes."""
        at = self.hashed.slots(keys)
        safe = np.maximum(at, 0)
        return safe, (at >= 0) & (self.digests[safe] == keys).all(axis=1)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, the bucket's index row first."""
    bucket, at = None, None
    for batch in batches:
        numbers = np.stack([batch.column("bucket").to_numpy(), batch.column("salt").to_numpy()])
        is_index = batch.column("is_row").to_numpy(zero_copy_only=False) == 0
        cuts = np.flatnonzero(is_index | np.r_[True, (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)])
        for lo, hi in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
            if is_index[lo]:
                bucket, at = _Bucket(batch.slice(lo, 1).to_pylist()[0]), tuple(numbers[:, lo])
                lo += 1
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if at != tuple(numbers[:, lo]):
                bucket, at = None, tuple(numbers[:, lo])
            n = hi - lo
            keep, size, member = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            known = member
            if bucket is not None:
                slots, member = bucket.find(as_words(part.column("digest").to_pylist()))
                keep, size, known = bucket.winners[slots], bucket.counts[slots], member & bucket.known[slots]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("digest"),
                    pa.array(keep, mask=~known),
                    pa.array(size, mask=~member),
                    pa.array(member),
                ],
                names=["doc_id", "digest", "keep_id", "group_size", "member"],
            )


def look_up(rows: DataFrame, index: DataFrame, distinct: DataFrame, buckets: int, total: int) -> DataFrame:
    """Each row with its group's winner and size, and whether its digest is in the index at all.

    distinct: the groups the index was built from; total: the number of their rows.
    """
    least = max(HOT_LEAST, total // HOT_GROUPS)
    # At most HOT_GROUPS rows, as each has at least 1/HOT_GROUPS of all.
    hot = distinct.where(F.col("n") > least).select("digest", F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(hot), "digest", "left").select(
        F.pmod("slice", F.lit(buckets)).alias("bucket"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long").alias("salt"),
        F.lit(1).alias("is_row"),
        "doc_id",
        "digest",
    )
    hot_buckets = (
        distinct.where(F.col("n") > least).select(F.pmod("slice", F.lit(buckets)).alias("bucket")).distinct()
        .withColumn("salted", F.lit(True))
    )
    copies = index.join(F.broadcast(hot_buckets), "bucket", "left").select(
        "*", F.explode(F.sequence(F.lit(0), F.when(F.col("salted"), F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt")
    )
    copies = copies.withColumn("salt", F.col("salt").cast("long")).withColumn("is_row", F.lit(0)).drop("salted")
    mixed = copies.unionByName(salted, allowMissingColumns=True)
    dealt = mixed.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "is_row")
    return dealt.mapInArrow(_answer, _LOOKED)


def exact_groups(rows: DataFrame, split_at: int | None = None) -> DataFrame:
    """Winner and size of every row of `digest_rows`, loaded as history (doc_id up to `split_at`) and as news after it.

    The news is looked up in the history's index: members add to the history's groups, the others form groups of their own.
    Then every row is looked up in the index of the history so updated. Without `split_at`, all rows are history.
    """
    rows = staged(rows, "digests")
    old = rows if split_at is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") <= split_at))
    history = staged(groups(old), "history")
    if split_at is not None:
        news = staged(groups(rows.where(F.col("doc_id") > split_at)), "news")
        n_old, rows_old = _sizes(history)
        buckets = max(1, -(-n_old // BUCKET_DIGESTS))
        index = staged(build_index(history, buckets), "index")
        asked = news.withColumnRenamed("winner", "doc_id")
        found = look_up(asked, index, history, buckets, rows_old).select("digest", "member")
        found = staged(found, "found")
        members = news.join(found.where("member"), "digest", "left_semi")
        separate = news.join(found.where("not member"), "digest", "left_semi")
        added = history.unionByName(members).groupBy("digest", "slice").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
        history = staged(added.unionByName(separate), "history")
    n_distinct, total = _sizes(history)
    buckets = max(1, -(-n_distinct // BUCKET_DIGESTS))
    index = staged(build_index(history, buckets), "index")
    return look_up(rows, index, history, buckets, total)


def _sizes(distinct: DataFrame) -> tuple[int, int]:
    row = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def id_midpoint(docs: DataFrame) -> int | None:
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    return None if low is None else (low + high) // 2


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows of which an equal text with a larger doc_id exists; the columns of docs."""
    found = staged(exact_groups(digest_rows(docs)), "exact")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    key, row = fresh(["doc_id"], "key"), F.struct(*docs.columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column(key), text_digests(text)], names=["row", key, "digest"]
            )

    whole = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias(key), F.col("text").cast("string").alias("text"))
    schema = whole.select("row", key).withColumn("digest", F.lit(b"")).schema
    marked = whole.mapInArrow(add, schema)
    joined = marked.join(
        kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")),
        F.col(key).eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")),
        "left_semi",
    )
    return joined.dropDuplicates([key, "digest"]).select("row.*")
