import pyarrow as pa

from gleanery.functions.batches import SLICE_BYTES, SLICE_ROWS, in_slices
from gleanery.functions import html


def test_a_batch_is_made_slice_by_slice():
    seen = []

    def some(texts, numbers):
        seen.append((len(texts), sum(map(len, texts.to_pylist()))))
        return pa.array([None if t is None else len(t) + n for t, n in zip(texts.to_pylist(), numbers.to_pylist())], pa.int64())

    texts = pa.array(["x" * (i % 50) for i in range(5_000)])
    numbers = pa.array(range(5_000), pa.int64())
    whole = in_slices(some, pa.int64(), texts, numbers)
    assert whole.to_pylist() == [i % 50 + i for i in range(5_000)]
    assert max(n for n, _ in seen) <= SLICE_ROWS < len(texts)
    seen.clear()
    in_slices(some, pa.int64(), pa.array(["y" * (SLICE_BYTES // 4)] * 40), pa.array([0] * 40, pa.int64()))
    assert max(size for _, size in seen) <= SLICE_BYTES
    assert in_slices(some, pa.int64(), texts.slice(0, 0), numbers.slice(0, 0)).to_pylist() == []


def test_pages_are_extracted_slice_by_slice(spark, monkeypatch):
    sizes = []
    real = html.in_slices

    def counted(make, empty, *columns):
        return real(lambda *c: (sizes.append(len(c[0])), make(*c))[1], empty, *columns)

    monkeypatch.setattr(html, "in_slices", counted)
    column = html.extracted  # the function that tasks run is made here, and called without a task
    monkeypatch.setattr(html.F, "arrow_udf", lambda kind: lambda run: type("U", (), {"asNondeterministic": lambda self: run})())
    pages = pa.array([f"<title>t{i}</title><p>text {i}</p>" for i in range(1_000)])
    found = column(pages, pa.array(["https://h.example/"] * 1_000))
    assert [p["title"] for p in found.to_pylist()] == [f"t{i}" for i in range(1_000)]
    assert max(sizes) <= SLICE_ROWS and sum(sizes) == 1_000
