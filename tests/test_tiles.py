"""What a task of the tiles holds and emits."""

import numpy as np
import pyarrow as pa
import pytest

from gleanery.operators import tiles

K, CELLS, ROWS, ASKED = 5, 12, 40, 600


@pytest.fixture(scope="module")
def cells():
    """Batches of 12 cells, each with 40 rows and the same 600 queries, and the brute-force answer of every query; many distances tie."""
    rng = np.random.default_rng(3)
    held, asked = rng.integers(0, 30, (CELLS, ROWS)).astype(float), rng.integers(0, 30, ASKED).astype(float)
    ids = rng.permutation(CELLS * ROWS).reshape(CELLS, ROWS)
    batches = []
    for cell in range(CELLS):
        n = ROWS + ASKED
        number = pa.array(np.zeros(n, np.int32))
        batches.append(pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, cell, np.int32)), number, number, pa.array([False] * ROWS + [True] * ASKED),
                pa.array([*ids[cell].tolist(), *[None] * ASKED], pa.int64()), pa.array([None] * ROWS + [f"q{i}" for i in range(ASKED)]),
                pa.array([*held[cell].tolist(), *[None] * ASKED], pa.float64()), pa.array([None] * ROWS + asked.tolist(), pa.float64()),
            ],
            names=["group", "slice", "block", "asks", "id", "query_id", "held", "asked"],
        ))
    want = {}
    for i, a in enumerate(asked):
        away = np.abs(held - a).ravel()
        best = np.lexsort((ids.ravel(), away))[:K]
        want[f"q{i}"] = [(float(away[b]), int(ids.ravel()[b])) for b in best]
    return batches, want


def met(batches):
    sizes = []

    def away(held, asked):
        sizes.append(len(asked))
        return np.abs(asked[:, None] - held[None, :])

    def values(column):
        return column.to_numpy(zero_copy_only=False)

    found = list(tiles._meet(K, values, values, away)(iter(batches)))
    by = {}
    for row in pa.Table.from_batches(found).to_pylist():
        by.setdefault(row["query_id"], []).append((row["distance"], row["id"]))
    return {name: sorted(rows) for name, rows in by.items()}, sizes, found


def test_a_task_emits_the_best_over_its_tiles(cells):
    batches, want = cells
    got, _, found = met(batches)
    assert got == want
    assert found[0].schema.names == ["query_id", "id", "distance", "group", "part"]


def test_few_queries_are_prepared_at_once(cells):
    _, sizes, _ = met(cells[0])
    assert max(sizes) <= tiles.CHUNK_ASKED < ASKED and sum(sizes) == CELLS * ASKED


def test_what_a_task_holds_is_bounded(cells, monkeypatch):
    batches, want = cells
    held = []
    real = tiles._Best.add

    def add(self, answers):
        yield from real(self, answers)
        held.append(self.rows)

    for name, bound in (("HELD_ROWS", 700), ("MERGE_ROWS", 200), ("KNOWN_QUERIES", 100), ("BATCH_ROWS", 64)):
        monkeypatch.setattr(tiles, name, bound)
    monkeypatch.setattr(tiles._Best, "add", add)
    got, _, found = met(batches)
    assert {name: rows[:K] for name, rows in got.items()} == want
    assert max(held) <= 2 * 700 and max(b.num_rows for b in found) <= 64


def test_queries_of_few_rows_and_none(cells):
    batch = cells[0][0]
    few = pa.concat_batches([batch.slice(0, 3), batch.slice(ROWS, 4)])
    got, _, _ = met([few])
    assert sorted(got) == ["q0", "q1", "q2", "q3"] and all(len(rows) == 3 for rows in got.values())
    assert tiles._Best(K).places_of(pa.array([], pa.string())).tolist() == []
    assert list(tiles._meet(K, None, None, None)(iter([]))) == []
