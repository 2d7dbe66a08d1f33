"""Nearest rows of two tables of vectors: blocks of queries meet slices of the corpus, paired on executors.

Both tables carry a group; only rows of one group meet (a plain search has one group, an index one per cell). A group's corpus is
dealt into slices and its queries into blocks by hash, each of about a fixed number of rows, and every pair of a slice and a
block is a tile: a key of the exchange. A task holds one slice at a time, sorted by id, streams the blocks past it in chunks,
and emits the k best rows of every query over the tiles it had, never pairs; a row that is no better than k rows of the same query
from an earlier tile is dropped at once. What a task holds of these answers is bounded. The answers of the tasks are merged in two levels.

A row of the corpus is copied once per block of its group, a query once per slice. Neither side's size changes the plan: the
numbers of slices and blocks are columns of a joined table with one row per group, not numbers on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a slice and of a block on average: a slice of 1,024 doubles per row is held in 64 MB.
SLICE_ROWS = 8_192
BLOCK_ROWS = 8_192
#: Distances computed at once.
CHUNK_CELLS = 1 << 21
#: Queries that are prepared and answered at once, however short the slice is: a kernel may hold much for each of them.
CHUNK_ASKED = 256
#: Answers a task holds over its tiles before it emits them, new ones that are merged at once, and queries whose k-th distance it knows.
HELD_ROWS = 1 << 20
MERGE_ROWS = 1 << 18
KNOWN_QUERIES = 1 << 17
#: Rows of a batch of answers.
BATCH_ROWS = 1 << 16
#: Tiles whose answers meet in the first level of the merge.
FAN_IN = 64

#: (held slice payload, query payload) -> distances, one row per query and one column per row of the slice.
Kernel = Callable[[object, object], np.ndarray]


def _tile_counts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """group, slices, blocks: one row for each group that both sides have."""
    of = corpus.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    by = queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    return of.join(by, "group")


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _dealt(corpus: DataFrame, queries: DataFrame, payload: str, asked: str) -> DataFrame:
    """Rows of both sides by tile, the slice's rows first."""
    # One row per group: a single one for a plain search, at most as many as an index has cells.
    counts = F.broadcast(_tile_counts(corpus, queries))
    of = F.pmod(F.xxhash64("id", payload), F.col("slices")).cast("int").alias("slice")
    by = F.pmod(F.xxhash64("query_id", asked), F.col("blocks")).cast("int").alias("block")
    id_type, query_type = corpus.schema["id"].dataType, queries.schema["query_id"].dataType
    rows = corpus.join(counts, "group").select(
        "group", of, F.explode(_numbers(F.col("blocks"))).alias("block"), F.lit(False).alias("asks"), "id",
        F.lit(None).cast(query_type).alias("query_id"), F.col(payload).alias("held"),
        F.lit(None).cast(queries.schema[asked].dataType).alias("asked"),
    )
    asks = queries.join(counts, "group").select(
        "group", F.explode(_numbers(F.col("slices"))).alias("slice"), by, F.lit(True).alias("asks"), F.lit(None).cast(id_type).alias("id"),
        "query_id", F.lit(None).cast(corpus.schema[payload].dataType).alias("held"), F.col(asked).alias("asked"),
    )
    keys = ("group", "slice", "block")
    return rows.unionByName(asks).repartition(*keys).sortWithinPartitions(*keys, "asks")


def _k_best(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest of every row, ties by column; NaN is never among them."""
    n, m = distances.shape
    if m > k:
        edge = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero(distances <= np.where(np.isnan(edge), np.inf, edge))
    else:
        rows, columns = np.nonzero(~np.isnan(distances))
    order = np.lexsort((columns, distances[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


class _Tile:
    """The slice of one tile, sorted by id."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.held: list[pa.Array] = []
        self.ready = None
        self.rows = 0

    def add(self, ids: pa.Array, held: pa.Array) -> None:
        self.rows += len(ids)
        self.ids.append(ids)
        self.held.append(held)

    def payload(self, prepare: Callable[[pa.Array], object]) -> object:
        if self.ready is None:
            ids, held = pa.concat_arrays(self.ids), pa.concat_arrays(self.held)
            order = pc.sort_indices(ids)
            self.names, self.ready = ids.take(order), prepare(held.take(order))
            self.ids = self.held = []
        return self.ready


class _Best:
    """The k best rows so far of the queries a task met; `edges` has the distance that rows to come must not exceed."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.places: dict[object, int] = {}
        self.edges = np.zeros(0)
        self.batches: list[pa.RecordBatch] = []
        self.rows = self.merged = 0

    def places_of(self, names: pa.Array) -> np.ndarray:
        """The number of each query in `edges`."""
        places = np.array([self.places.setdefault(name, len(self.places)) for name in names.to_pylist()], np.int64)
        if len(self.places) > len(self.edges):
            more = max(len(self.places), 2 * len(self.edges)) - len(self.edges)
            self.edges = np.concatenate([self.edges, np.full(more, np.inf)])
        return places

    def add(self, answers: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Answers with the `place` of their query; yields what is held where it is too much."""
        self.batches.append(answers)
        self.rows += answers.num_rows
        if self.rows - self.merged >= max(MERGE_ROWS, self.merged):
            self._merge()
            if self.rows > HELD_ROWS:
                yield from self.emitted()

    def emitted(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        batches, self.batches, self.rows, self.merged = self.batches, [], 0, 0
        # The edges stay true when the rows are gone: they are k rows of their query.
        if len(self.places) > KNOWN_QUERIES:
            self.places, self.edges = {}, np.zeros(0)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(start, BATCH_ROWS).drop_columns(["place"])

    def _merge(self) -> None:
        if self.rows == self.merged:
            return
        table = pa.Table.from_batches(self.batches)
        order = pc.sort_indices(table, sort_keys=[(name, "ascending") for name in ("place", "distance", "id")])
        place = table.column("place").to_numpy()[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        best = table.take(order.filter(pa.array(rank < self.k)))
        last = rank == self.k - 1
        self.edges[place[last]] = np.minimum(self.edges[place[last]], table.column("distance").to_numpy()[order][last])
        self.batches = best.combine_chunks().to_batches()
        self.rows = self.merged = best.num_rows


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The batch by runs of equal tile and side."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "slice", "block", "asks")]
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield tuple(int(key[lo]) for key in keys[:3]), bool(keys[3][lo]), batch.slice(lo, hi - lo)


def _meet(k: int, prepare_held: Callable, prepare_asked: Callable, kernel: Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, best = None, _Tile(), _Best(k)
        for batch in batches:
            for key, asks, part in _runs(batch):
                if key != at:
                    at, tile = key, _Tile()
                # Rows without a vector are dropped here: a filter above would compute a derived vector twice.
                part = part.filter(part.column("asked" if asks else "held").is_valid())
                if not asks:
                    tile.add(part.column("id"), part.column("held"))
                    continue
                if not part.num_rows or not tile.rows:
                    continue
                held = tile.payload(prepare_held)
                step = max(1, min(CHUNK_ASKED, CHUNK_CELLS // max(1, len(tile.names))))
                for start in range(0, part.num_rows, step):
                    chunk = part.slice(start, step)
                    places = best.places_of(chunk.column("query_id"))
                    distances = kernel(held, prepare_asked(chunk.column("asked")))
                    distances = np.where(distances > best.edges[places][:, None], np.nan, distances)
                    rows, columns = _k_best(distances, k)
                    found = distances[rows, columns]
                    last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
                    np.minimum.at(best.edges, places[rows[last]], found[last])
                    yield from best.add(
                        pa.RecordBatch.from_arrays(
                            [
                                chunk.column("query_id").take(pa.array(rows)),
                                tile.names.take(pa.array(columns)),
                                pa.array(found, pa.float64()),
                                pa.array(np.full(len(rows), key[0], np.int32)),
                                pa.array(np.full(len(rows), key[1] // FAN_IN, np.int32)),
                                pa.array(places[rows]),
                            ],
                            names=["query_id", "id", "distance", "group", "part", "place"],
                        )
                    )
        yield from best.emitted()

    return run


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, payload: str, asked: str, prepare_held: Callable, prepare_asked: Callable, kernel: Kernel
) -> DataFrame:
    """query_id, id, group, distance, rank: the k rows of the corpus nearest to each query over all groups it is in, ties by id.

    corpus: group int, id and `payload`; queries: group int, query_id and `asked`; rows without payload are left out. A query may be in
    several groups. Ids are unique: of rows that share an id each is a candidate of its own.
    """
    id_type = corpus.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    output = f"query_id {query_type}, id {id_type}, distance double, group int, part int"
    found = _dealt(corpus, queries, payload, asked).mapInArrow(_meet(k, prepare_held, prepare_asked, kernel), output)
    # At most FAN_IN tiles with k answers each per query and part (fewer where a task had several), then k of every part.
    inner = Window.partitionBy("query_id", "group", "part").orderBy("distance", "id")
    outer = Window.partitionBy("query_id").orderBy("distance", "id")
    parts = found.withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= k)
    best = parts.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k)
    return best.select("query_id", "id", "group", "distance", "rank")
