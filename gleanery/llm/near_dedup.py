"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

A text's set is its distinct word n-grams. One hash spreads the set over `BINS` bins; a bin's value is its smallest hash, and an
empty bin takes the value of the first filled bin along its own random sequence (optimal densification). Bands of `ROWS` bins
make `BINS / ROWS` bucket keys. In a bucket only stars are compared: its best-connected member (it shares most buckets with
others, which in a family of copies is the original) against the rest, not all pairs. Candidates are confirmed on the full sets.
Up to `STARS` rounds take one centre per bucket whose members do not yet belong to one component, outside its largest component.
What the stars leave outside the largest component of its bucket, usually few members, is a query set: packed into blocks of
about `BLOCK_SHINGLES`, it meets every member of its buckets once per block, in an index over the block's shingles. Of two
members of a bucket in different components at least one is in that query set, so no link between members of a bucket is lost.

Two sets with a similarity of 0.8 share a bucket with probability 1 - (1 - 0.8**6)**32 = 0.99994.

Scale: texts with equal sets are one node from the start, so a third of all rows may be copies. Bucket rows are 16 bytes; buckets
of one are dropped by counts that combine on the map side, hot buckets find their centre by a bounded broadcast. Sets are made
only for nodes in a bucket with others. The members of a centre or block are dealt to tasks by `STAR_ROWS`, which stream over them
and hold one block's sets. Pairs exist only as counts within a block, never as rows. Components are tables (`components`); nothing but counts comes to the driver.

Defined results: null and empty texts have no set and link with nothing. Texts with fewer words than n have one shingle, the
whole sequence. Rows with equal doc_id and different texts are nodes of their own; rows that repeat doc_id and text are all
kept or all dropped. A component of rows without doc_id has none either. `drop_near_copies` returns one row of each component,
with the smallest doc_id (null last), then the smallest digest and the smallest hash of the text; a text without a set is a
component of its own. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.staging import join_counted, staged
from gleanery.llm.words import mix64, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
BINS = 192
ROWS = 6
SEED = 0x5DEECE66D
STAR_ROWS = 512
STARS = 3
BLOCK_SHINGLES = 1 << 18
BATCH_ROWS = 256

_BOUNDS = np.array([(i << 64) // BINS for i in range(BINS + 1)][:-1], np.uint64)
_ATTEMPTS = 48
with np.errstate(over="ignore"):
    _PROBES = (
        mix64(
            np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            + np.arange(1, _ATTEMPTS + 1, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        )
        % np.uint64(BINS)
    ).astype(np.int64)


def text_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text, its shingles under the one permutation: distinct 64-bit hashes in ascending order."""
    hashes, offsets = word_hashes(column)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.unique(mix64(shingle_hashes(hashes[lo:hi], n) ^ np.uint64(SEED)))


def densified(ordered: np.ndarray) -> np.ndarray:
    """The values of the bins of a set that is not empty."""
    at = np.searchsorted(ordered, _BOUNDS)
    ends = np.r_[at[1:], len(ordered)]
    filled = ends > at
    values = ordered[np.minimum(at, len(ordered) - 1)]
    if not filled.all():
        # The first filled bin of each bin's sequence of probes; the few without one go around the circle from the last probe.
        hits = filled[_PROBES]
        source = _PROBES[hits.argmax(axis=0), np.arange(BINS)]
        for i in np.flatnonzero(~filled & ~hits.any(axis=0)):
            around = (_PROBES[-1, i] + np.arange(BINS)) % BINS
            source[i] = around[filled[around].argmax()]
        values = np.where(filled, values, values[source])
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, ROWS)
    keys = mix64(np.arange(len(rows), dtype=np.uint64))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def set_digest(ordered: np.ndarray) -> bytes:
    return hashlib.blake2b(ordered, digest_size=16).digest()


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, and its band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                sets = list(text_sets(part.column(1), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(densified(s)).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "digest", "bands"],
                )

    keyed = _narrow(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, bands binary")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_rows(nodes: DataFrame, bands: int = BINS // ROWS) -> DataFrame:
    """node, key: of every bucket that holds at least two nodes; with the number of nodes as `members`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            node = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys)], names=["node", "key"])

    every = staged(nodes.select("node", "bands").mapInArrow(run, "node long, key long"), "bands")
    # A bucket of one is most buckets, and gone after this count.
    counts = staged(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    total = every.count()
    return staged(join_counted(every, counts.withColumn("members", F.col("n")), "key", "n", total), "bucket_rows")


def set_nodes(rows: DataFrame) -> DataFrame:
    """node, digest, n_shingles, bands, n_rows of every distinct set, and doc_id and text_key of the first row that has it."""
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key"))
    nodes = rows.where("digest is not null").groupBy("digest").agg(
        first.alias("at"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    named = nodes.select("digest", "at.doc_id", "at.text_key", "n_rows", "n_shingles", "bands")
    return staged(named.withColumn("node", F.monotonically_increasing_id()), "nodes")


def node_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, set: for `wanted` (node, digest, doc_id and text_key of one of its n_rows rows), the set's hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row may be repeated, with its doc_id or without one.
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                new = [i for i, node in enumerate(part.column("node").to_pylist()) if not (node in seen or seen.add(node))]
                part = part.take(pa.array(new, pa.int64()))
                sets = [s.tobytes() for s in text_sets(part.column("text"), n)]
                # Another text of the same id and hash has another digest.
                own = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                seen.difference_update(node for node, ok in zip(part.column("node").to_pylist(), own, strict=True) if not ok)
                keep = pa.array([i for i, ok in enumerate(own) if ok], pa.int64())
                kept = [part.column(c).take(keep) for c in ("node", "repeated")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([sets[i.as_py()] for i in keep], pa.binary())], names=["node", "repeated", "set"])

    asked = wanted.select(
        "node", "digest", F.col("doc_id").alias("asked_id"), F.col("text_key").alias("asked_key"), (F.col("n_rows") > 1).alias("repeated")
    )
    rows = _narrow(docs).withColumn("text_key", F.xxhash64("text"))
    # The wanted nodes grow with the corpus: the same join at every size. Rows of one id, or without one, are told apart by their text.
    found = rows.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_key") == F.col("asked_key")))
    made = staged(found.select("node", "digest", "repeated", "text").mapInArrow(run, "node long, repeated boolean, set binary"), "sets")
    once = staged(made.where("repeated").select("node", "set").dropDuplicates(["node"]), "sets_of_repeated")
    return made.where("not repeated").select("node", "set").unionByName(once)


class _Block:
    """Sets of some nodes and an index from each of their shingles to the nodes that have it."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.first = None

    def add(self, node: int, values: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(values)

    def similar(self, values: np.ndarray, percent: int) -> list[int]:
        """The nodes whose set is similar enough to `values`."""
        if self.first is None:
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.lengths = np.array([len(s) for s in self.sets])
            self.owners = np.repeat(np.arange(len(self.sets)), self.lengths)[order]
            self.values, self.first = np.unique(every[order], return_index=True)
            self.counts = np.diff(np.r_[self.first, len(every)])
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        at = at[self.values[at] == values]
        sizes = self.counts[at]
        # The positions of all owners of the shared shingles, one run per shingle.
        runs = np.repeat(self.first[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(at) else at
        same = np.bincount(self.owners[runs], minlength=len(self.sets))
        return [self.nodes[i] for i in np.flatnonzero(100 * same >= percent * (self.lengths + len(values) - same))]


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block()
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "is_member", "node")), strict=True)
            sets, found = batch.column("set"), []
            for i, (number, salt, is_member, node) in enumerate(groups):
                if at != (number, salt):
                    at, block = (number, salt), _Block()
                values = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if is_member:
                    found += [(c, node) for c in block.similar(values, percent) if c != node]
                else:
                    block.add(node, values.copy())
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(centres: DataFrame, members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the centres and members of a block (block, node of both, distinct) whose full sets are similar enough."""
    held = centres.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
    # The copies of a block's centres are at most as many as its members.
    salts = members.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(held, "block")
    salts = salts.select("block", F.ceil(F.col("n") / F.greatest("held", F.lit(STAR_ROWS))).cast("int").alias("salts"))
    salts = staged(salts, "salts")
    asked = members.join(salts, "block").select(
        "block", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("is_member"), "node"
    )
    copies = centres.join(salts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_member"), "node"
    )
    dealt = asked.unionByName(copies).hint("merge").join(sets, "node").repartition("block", "salt")
    dealt = dealt.sortWithinPartitions("block", "salt", "is_member").select("block", "salt", "is_member", "node", "set")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def bucket_links(
    docs: DataFrame, nodes: DataFrame, n: int, percent: int, bands: int = BINS // ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """a, b: confirmed links, enough to connect all members of buckets that links connect; and node, label (the smallest
    node of its component) of every node with a link. None without links."""
    rows = bucket_rows(nodes, bands)
    degree = rows.groupBy("node").agg(F.sum("members").alias("degree"))
    involved = nodes.join(degree, "node").select("node", "n_shingles", "digest", "doc_id", "text_key", "n_rows", "degree")
    involved = staged(involved, "involved")
    sets = node_sets(docs, involved, n)
    ranked = staged(rows.join(involved.select("node", "n_shingles", "degree"), "node"), "ranked")
    total = ranked.count()
    links, labels = None, None
    # Before the first round no member is in the largest component.
    open_rows = ranked.withColumn("label", F.col("node")).withColumn("outside", F.lit(True))
    for star in range(STARS):
        new = staged(confirmed(*_stars(open_rows, total, percent), sets, percent), "confirmed")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        elif star:
            break
        known = ranked.withColumn("label", F.col("node")) if labels is None else _labelled(ranked, labels)
        open_rows = _open_rows(known, total)
        if open_rows.isEmpty():
            return links, labels
    new = staged(confirmed(*_blocks(open_rows, total), sets, percent), "confirmed")
    if not new.isEmpty():
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    return links, labels


def bucket_pairs(docs: DataFrame, nodes: DataFrame, n: int, percent: int, bands: int = BINS // ROWS) -> DataFrame:
    """a, b: every confirmed link between members of a common bucket, once."""
    rows = bucket_rows(nodes, bands)
    involved = nodes.join(rows.select("node").distinct(), "node").select("node", "n_shingles", "digest", "doc_id", "text_key", "n_rows")
    involved = staged(involved, "involved")
    sets = node_sets(docs, involved, n)
    ranked = staged(rows.join(involved.select("node", "n_shingles"), "node"), "ranked")
    # Every member is in a block; those of the same largest bucket share blocks.
    asking = ranked.withColumn("outside", F.lit(True)).withColumn("largest", F.col("key"))
    found = confirmed(*_blocks(asking, ranked.count()), sets, percent)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(rows: DataFrame, total: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of each bucket the best-connected member outside its largest component as a block, and the members it is compared with."""
    best = F.max(F.when(F.col("outside"), F.struct("degree", (-F.col("node")).alias("order"), "n_shingles", "label")))
    per_key = rows.groupBy("key").agg(best.alias("centre"), F.max("members").alias("n")).where("centre is not null")
    joined = join_counted(rows, staged(per_key, "centres"), "key", "n", total).withColumn("block", -F.col("centre.order"))
    joined = joined.where((F.col("block") != F.col("node")) & (F.col("label") != F.col("centre.label")))
    # Sets that differ too much in size can't be similar enough.
    small, large = F.least("n_shingles", "centre.n_shingles"), F.greatest("n_shingles", "centre.n_shingles")
    members = staged(joined.where(100 * small >= percent * large).select("block", "node").distinct(), "members")
    return members.select("block", F.col("block").alias("node")).distinct(), members


def _blocks(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """All members outside the largest component of a bucket, in blocks, and every member of their buckets once per block."""
    asking = rows.where("outside").select("key", "node", "n_shingles", "members", "largest")
    # Nodes beside the same component go to the same blocks: the buckets of a family meet few blocks.
    home = asking.groupBy("node").agg(F.max(F.struct("members", "largest")).alias("home"), F.first("n_shingles").alias("n_shingles"))
    home = staged(home.select("node", F.col("home.largest").alias("home"), "n_shingles"), "homes")
    sizes = home.groupBy("home").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"), F.count(F.lit(1)).alias("n"))
    placed = join_counted(home, staged(sizes, "block_counts"), "home", "n", total)
    centres = placed.select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    centres = staged(centres, "block_centres")
    asked = asking.select("key", "node", "members").join(centres, "node")
    per_key = asked.groupBy("key", "block").agg(F.max("members").alias("n"))
    per_key = staged(per_key.groupBy("key").agg(F.collect_list("block").alias("blocks"), F.max("n").alias("n")), "asked_keys")
    joined = join_counted(rows.select("key", "node"), per_key, "key", "n", total)
    members = joined.select(F.explode("blocks").alias("block"), "node").distinct()
    return centres, staged(members, "members")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return staged(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def _open_rows(known: DataFrame, total: int) -> DataFrame:
    """Rows of the buckets with members of several components, and whether a row is `outside` its bucket's `largest` component."""
    parts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "label")).getField("label").alias("largest")
    spans = parts.groupBy("key").agg(largest, F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
    several = staged(spans.where("parts > 1").select("key", "largest", "n"), "open")
    joined = join_counted(known.drop("outside"), several, "key", "n", total)
    return staged(joined.withColumn("outside", F.col("label") != F.col("largest")), "open_rows")


def near_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_shingles, digest of its set, component_id, and the digest whose row with
    component_id stands for the component (null for empty sets)."""
    rows = staged(set_rows(docs, n), "sets")
    nodes = set_nodes(rows)
    _, labels = bucket_links(docs, nodes, n, percent)
    named = nodes.select("node", "digest", "doc_id", "n_rows")
    if labels is None:
        named = named.withColumn("label", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "digest"))
    smallest = named.groupBy("label").agg(first.alias("first"))
    smallest = smallest.select("label", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("keep_digest"))
    named = staged(named.join(smallest, "label").select("digest", "n_rows", "component_id", "keep_digest"), "named")
    total = rows.count()
    narrow = rows.select("doc_id", "text_key", "n_shingles", "digest")
    empty = narrow.where("digest is null").withColumn("component_id", F.col("doc_id")).withColumn("keep_digest", F.col("digest"))
    found = join_counted(narrow.where("digest is not null"), named, "digest", "n_rows", total)
    return found.select(*empty.columns).unionByName(empty)


def drop_near_copies(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component, that with its smallest doc_id; the columns of docs."""
    found = near_groups(docs, n, percent)
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("digest").eqNullSafe(F.col("keep_digest")))
    # Of a component one text; texts without a set stay, each in one row of a doc_id.
    own = F.when(F.isnull("digest"), F.col("text_key"))
    kept = firsts.groupBy(F.col("doc_id").alias("kept_id"), "digest", own.alias("own")).agg(F.min("text_key").alias("kept_key"))
    kept = kept.select("kept_id", "kept_key").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    same = F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    joined = whole.join(staged(kept, "kept"), same, "left_semi")
    return joined.dropDuplicates(["key", "text_key"]).select("row.*")
