"""A stored index for approximate nearest neighbours: an inverted file over product-quantised vectors.

Building: a bounded sample (the `sample_rows` rows with the smallest hash of their id) fits the centroids of the cells by k-means
and, on what is left after subtracting the centroid, the codebooks of `parts` sub-vectors. Every row is then assigned to its
nearest cell and stored as cell (a folder of its own), id, code (one byte per part), vector and the columns to filter by.

Asking: the cells nearest to the question are probed, so the scan lists only their folders and reads only ids and codes; the
`refine * top_k` rows of the smallest estimated distance are read again with literal cell and id filters and ranked by their exact
distance. A table of questions is answered the same way: questions are dealt to their cells, meet the codes there in tiles
(`tiles`), and the candidates meet their vectors by a join on the id.

How many cells are probed is measured, not guessed: when the index is built, `asked` of the sample's rows are answered exactly over
the whole corpus, and the number of cells that hold `target` of these answers is kept with the model. Vectors without clusters
need many cells.

Scale: centroids and codebooks (at most `MOST_CELLS` + `parts` * 256 vectors) are what a task gets and the driver holds; the rest is
one pass over the corpus and one shuffle of it by cell, split by size, so that a crowded cell is several files. Rows without a
vector are not in the index. Vectors of another length than the first are refused when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.batches import in_slices
from gleanery.functions.vectors import as_matrix, checked_metric, distance_matrix, distance_to
from gleanery.operators import tiles, vector_search
from gleanery.session import cut_lineage
from gleanery.sources.keyed_table import folder_exists

CELL = "cell"
MOST_CELLS = 4_096
ENTRIES = 256
#: Distances computed at once when rows are assigned.
CHUNK_CELLS = 1 << 21


@dataclass(frozen=True)
class AnnSettings:
    """cells: 0 means the square root of the number of rows; probes: 0 means as many as were measured to reach `target`.

    sample_rows bounds what the driver fits on.
    """

    cells: int = 0
    parts: int = 16
    sample_rows: int = 16_384
    probes: int = 0
    refine: int = 16
    target: float = 0.95
    asked: int = 128
    nearest: int = 10
    rounds: int = 8
    seed: int = 7


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CHUNK_CELLS // len(centres))
    found = [_squared(rows[i : i + step], centres).argmin(axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres of the rows. A centre that loses all its rows moves to the row farthest from its own."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.sort(rng.choice(len(distinct), k, replace=False))].copy()
    for _ in range(rounds):
        own = _closest(rows, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=rows[:, j], minlength=k) for j in range(rows.shape[1])], axis=1)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
        lost = np.flatnonzero(~used)
        if len(lost):
            away = ((rows - centres[own]) ** 2).sum(axis=1)
            centres[lost] = rows[np.argsort(-away, kind="stable")[: len(lost)]]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres: cells x dimension; entries: parts x 256 x (dimension / parts, rounded up). Vectors are those of `scaled`."""

    metric: str
    dimension: int
    centres: np.ndarray
    entries: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, metric: str, cells: int, settings: AnnSettings) -> "Quantiser":
        rng = np.random.default_rng(settings.seed)
        rows = scaled(sample, metric)
        centres = k_means(rows, cells, settings.rounds, rng)
        rest = _padded(rows - centres[_closest(rows, centres)], settings.parts)
        entries = np.zeros((settings.parts, ENTRIES, rest.shape[2]))
        for p in range(settings.parts):
            found = k_means(rest[:, p], ENTRIES, settings.rounds, rng)
            # Unused entries repeat the first: they are never the only nearest one.
            entries[p] = np.concatenate([found, np.repeat(found[:1], ENTRIES - len(found), axis=0)])
        return cls(metric, sample.shape[1], centres, entries)

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (rows x parts, one byte each) of every vector."""
        rows = scaled(vectors, self.metric)
        cell = _closest(rows, self.centres)
        rest = _padded(rows - self.centres[cell], len(self.entries))
        return cell, np.stack([_closest(rest[:, p], self.entries[p]) for p in range(len(self.entries))], axis=1).astype(np.uint8)

    def cell_order(self, questions: np.ndarray) -> np.ndarray:
        """All cells of every question, the most promising first."""
        rows = scaled(questions, self.metric)
        away = -(rows @ self.centres.T) if self.metric == "ip" else _squared(rows, self.centres)
        return np.argsort(away, axis=1, kind="stable")

    def tables(self, questions: np.ndarray, cell: int) -> np.ndarray:
        """Per question, part and entry the part's share of the estimated distance to rows of the cell."""
        rows = scaled(questions, self.metric)
        if self.metric == "ip":
            asked = _padded(rows, len(self.entries))
            shares = -np.einsum("qpd,ped->qpe", asked, self.entries)
            # The centroid's share is the same for all rows of the cell, but not from cell to cell.
            shares[:, 0] -= (rows @ self.centres[cell])[:, None]
            return shares
        asked = _padded(rows - self.centres[cell], len(self.entries))
        return ((asked[:, :, None, :] - self.entries[None]) ** 2).sum(axis=3)

    def estimates(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Estimated distances, questions x rows."""
        out = np.zeros((len(tables), len(codes)))
        for p in range(tables.shape[1]):
            out += tables[:, p][:, codes[:, p]]
        return out


def scaled(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors of length one for cosine, as their squared distance then orders like the cosine distance."""
    if metric != "cosine":
        return vectors
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _padded(rows: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width, with zeros after the last component."""
    width = -(-rows.shape[1] // parts)
    out = np.zeros((len(rows), parts * width))
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), parts, width)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class AnnIndex:
    """The index stored under `path`: rows/cell=n/*.parquet and model/*.parquet."""

    def __init__(self, spark: SparkSession, path: str, settings: AnnSettings = AnnSettings()) -> None:
        self.spark, self.path, self.settings = spark, path, settings
        about = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").collect()
        centres = np.array([r["vector"] for r in about if r["kind"] == "cell"])
        entries = [r["vector"] for r in about if r["kind"] == "entry"]
        head = next(r for r in about if r["kind"] == "about")
        parts = int(head["number"])
        self.quantiser = Quantiser(head["name"], int(head["part"]), centres, np.array(entries).reshape(parts, ENTRIES, -1))
        measured = spark.read.parquet(f"{path}/probes").first()[0] if folder_exists(spark, f"{path}/probes") else len(centres)
        self.probes = settings.probes or measured

    @classmethod
    def build(
        cls, df: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", metric: str = "cosine",
        settings: AnnSettings = AnnSettings(), keep: tuple[str, ...] = (),
    ) -> "AnnIndex":
        """Fit, assign every row of df, and write the index. `keep` columns can be filtered by. Needs a row with a vector."""
        spark = df.sparkSession
        named = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), *keep)
        narrow = named.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(settings.sample_rows)
        sample = as_matrix(narrow.toArrow().column("vector").drop_null())
        if not len(sample) or np.isnan(sample).any():
            raise ValueError("an index needs vectors of one length, without nulls")
        n_cells = settings.cells or int(round(np.sqrt(df.count())))
        model = Quantiser.fitted(sample, checked_metric(metric), max(1, min(n_cells, MOST_CELLS, len(sample))), settings)
        cls._write_model(spark, path, model)
        cls._write_rows(named, path, model, "overwrite")
        index = cls(spark, path, settings)
        return index if settings.probes else index._with_measured_probes()

    def _with_measured_probes(self) -> "AnnIndex":
        """Keep the number of cells that hold `target` of the exact answers to some of the rows. Reads `asked` vectors to the driver."""
        rows, settings = self.rows().select(CELL, "id", "vector"), self.settings
        asked = rows.orderBy(F.xxhash64("id"), "id").limit(settings.asked).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
        asked = cut_lineage(asked)
        exact = vector_search.search_many(rows, asked, settings.nearest, self.quantiser.metric, "id", "vector")
        answers = exact.select("query_id", "id").join(rows.select("id", CELL), "id").select("query_id", CELL).collect()
        held = asked.toArrow()
        order = self.quantiser.cell_order(as_matrix(held.column("query_vector")))
        place = {name: np.argsort(cells) for name, cells in zip(held.column("query_id").to_pylist(), order, strict=True)}
        needed = np.sort([place[name][cell] for name, cell in answers]) + 1
        probes = int(needed[int(np.ceil(settings.target * len(needed))) - 1])
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        self.probes = probes
        return self

    @staticmethod
    def _write_model(spark: SparkSession, path: str, model: Quantiser) -> None:
        rows = [("about", model.dimension, len(model.entries), model.metric, None)]
        rows += [("cell", 0, i, None, c.tolist()) for i, c in enumerate(model.centres)]
        rows += [("entry", p, i, None, e.tolist()) for p, part in enumerate(model.entries) for i, e in enumerate(part)]
        frame = spark.createDataFrame(rows, "kind string, part int, number int, name string, vector array<double>")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def _write_rows(named: DataFrame, path: str, model: Quantiser, mode: str) -> None:
        fields = named.schema.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column("vector").is_valid())
                if not batch.num_rows:
                    continue
                vectors = as_matrix(batch.column("vector"))
                if vectors.shape[1] != model.dimension or np.isnan(vectors).any():
                    raise ValueError(f"all vectors of an index have {model.dimension} components, none of them null")
                cell, codes = model.assigned(vectors)
                extra = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, CELL, "code"])

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"{CELL} int", "code binary"])
        rows = named.mapInArrow(run, schema)
        # Rebalanced by cell: a crowded cell is split, small ones share a task. Sorted by id, so an id opens few row groups.
        rows = rows.hint("rebalance", CELL).sortWithinPartitions(CELL, "id")
        rows.write.mode(mode).partitionBy(CELL).parquet(f"{path}/rows")

    def append(self, df: DataFrame, id_col: str = "chunk_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> None:
        """Add rows (of new ids) with the model as it is."""
        named = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), *keep)
        self._write_rows(named, self.path, self.quantiser, "append")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    # ---- one question

    def estimated(self, question: Sequence[float], cells: Sequence[int], where: Column | None = None) -> DataFrame:
        """cell, id, estimate of the rows in these cells; the scan lists only their folders and reads ids and codes."""
        model, asked = self.quantiser, np.asarray(question, np.float64)[None, :]
        tables = {int(c): model.tables(asked, int(c)) for c in cells}

        @F.arrow_udf("double")
        def estimate(cell: pa.Array, code: pa.Array) -> pa.Array:
            cell, codes, out = cell.to_numpy(), _codes(code), np.zeros(len(code))
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                out[own] = model.estimates(codes[own], tables[int(c)])[0]
            return pa.array(out)

        rows = self.rows().where(F.col(CELL).isin([int(c) for c in cells]))
        if where is not None:
            rows = rows.where(where)
        return rows.select(CELL, "id", estimate(CELL, "code").alias("estimate"))

    def search(self, question: Sequence[float], top_k: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """id, distance of about the top_k nearest rows, nearest first, ties by id.

        Where the probed cells have fewer than top_k rows (that fit `where`), the next cells follow, twice as many each time.
        """
        settings = self.settings
        order = self.quantiser.cell_order(np.asarray(question, np.float64)[None, :])[0]
        n, done, found = probes or self.probes, 0, []
        while done < len(order) and (not done or len(found) < top_k):
            near = self.estimated(question, order[done : done + n], where).orderBy("estimate", "id").limit(settings.refine * top_k)
            found += near.collect()
            done, n = done + n, 2 * n
        rows = self.rows()
        if not found:
            rows = rows.where(F.lit(False))
        else:
            rows = rows.where(F.col(CELL).isin(sorted({r[CELL] for r in found})) & F.col("id").isin([r["id"] for r in found]))
        exact = distance_to(question, self.quantiser.metric)(F.col("vector"))
        return rows.select("id", exact.alias("distance")).orderBy("distance", "id").limit(top_k)

    # ---- many questions

    def search_many(
        self, queries: DataFrame, top_k: int = 10, probes: int | None = None, query_id: str = "query_id", query_vector: str = "query_vector"
    ) -> DataFrame:
        """query_id, id, distance, rank of about the top_k nearest rows of every question (unique query_id)."""
        settings, model = self.settings, self.quantiser
        n = min(probes or self.probes, len(model.centres))
        named = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("asked"))
        # Questions are read by cells and again for their candidates.
        named = cut_lineage(named)

        def nearest_cells(vectors: pa.Array) -> pa.Array:
            if vectors.null_count == len(vectors):
                return pa.array([[] for _ in range(len(vectors))], pa.list_(pa.int32()))
            order = model.cell_order(np.nan_to_num(as_matrix(vectors)))[:, :n].astype(np.int32)
            return pa.array([row if ok else [] for row, ok in zip(order.tolist(), vectors.is_valid().to_pylist(), strict=True)], pa.list_(pa.int32()))

        @F.arrow_udf("array<int>")
        def cells_of(vectors: pa.Array) -> pa.Array:
            # A question is a row of all cells here.
            return in_slices(nearest_cells, pa.list_(pa.int32()), vectors)

        dealt = named.select("query_id", "asked", F.explode_outer(cells_of("asked")).alias("group")).where("group is not null")
        # The cell goes along, as tables of distances differ by cell.
        dealt = dealt.select("group", "query_id", F.struct("group", "asked").alias("asked"))
        codes = self.rows().select(F.col(CELL).alias("group"), "id", "code")

        def prepare(asked: pa.StructArray) -> tuple[int, np.ndarray]:
            return int(asked.field("group")[0].as_py()), as_matrix(asked.field("asked"))

        def estimates(held: np.ndarray, asked: tuple[int, np.ndarray]) -> np.ndarray:
            return model.estimates(held, model.tables(asked[1], asked[0]))

        near = tiles.nearest(codes, dealt, settings.refine * top_k, "code", "asked", _codes, prepare, estimates)
        # refine * top_k candidates of each question meet their vectors.
        rows = self.rows().select(F.col(CELL).alias("group"), "id", "vector")
        both = near.select("query_id", "id", "group").join(rows, ["group", "id"]).join(named, "query_id")

        @F.arrow_udf("double")
        def exact(vectors: pa.Array, asked: pa.Array) -> pa.Array:
            left, right = as_matrix(vectors), as_matrix(asked)
            if model.metric == "l2":
                out = ((left - right) ** 2).sum(axis=1)
            else:
                if model.metric == "cosine":
                    left, right = scaled(left, "cosine"), scaled(right, "cosine")
                out = 1.0 - (left * right).sum(axis=1)
            return pa.array(np.round(out, 12))

        ranked = both.select("query_id", "id", exact("vector", "asked").alias("distance"))
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of each question's exact answers (query_id, id) that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
