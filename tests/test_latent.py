"""Latent vectors against a dense singular value decomposition, and as an embedding provider."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions.tokens import keyword_tokens_of
from gleanery.operators import bm25, latent
from gleanery.operators.latent import LatentEmbedder, LatentSettings
from gleanery.plans.stored_queries import QUERIES
from gleanery.sources.tables import document_corpus

DATA = "/root/testdata/sf0.001"
SMALL = LatentSettings(dimension=12, oversample=10, rounds=6, buckets=1 << 12)


def dense(token_lists, m):
    """The whole matrix by plain loops, and its idf."""
    n = len(token_lists)
    counts = np.zeros((n, m))
    for i, tokens in enumerate(token_lists):
        for t in tokens or []:
            counts[i, latent.bucket_of(t, m)] += 1
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0)))
    rows = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0), idf


@pytest.fixture(scope="module")
def tokens(spark):
    return bm25.with_tokens(document_corpus(spark, DATA)).select("chunk_id", "tokens").cache()


@pytest.fixture(scope="module")
def fitted(tokens):
    return latent.fit(tokens, SMALL)


def test_buckets_are_the_same_on_both_sides(spark):
    terms = ["a", "word", "straße", "книга", "x" * 31, "y" * 32, "z" * 33, "w" * 200, ""]
    df = spark.createDataFrame([(terms,)], "t array<string>")
    for m in (7, 1 << 16):
        assert df.select(latent.buckets_of(F.col("t"), m)).first()[0] == [latent.bucket_of(t, m) for t in terms]


def test_subspace_matches_a_dense_decomposition(tokens, fitted):
    matrix, idf = dense([r["tokens"] for r in tokens.select("tokens").collect()], SMALL.buckets)
    assert np.allclose(idf, fitted.idf)
    singular = np.linalg.svd(matrix, compute_uv=False)[: SMALL.dimension]
    # Orthonormal directions that hold nearly all a subspace of this dimension can hold, and singular values close to the true ones.
    assert np.allclose(fitted.directions.T @ fitted.directions, np.eye(SMALL.dimension), atol=1e-8)
    held = np.linalg.norm(matrix @ fitted.directions) ** 2
    assert held >= 0.995 * (singular**2).sum()
    assert np.abs(fitted.singular / singular - 1).max() < 0.02 and abs(fitted.singular[0] / singular[0] - 1) < 1e-4


def test_vectors_are_rows_times_the_basis(spark, tokens, fitted):
    rows = tokens.select("chunk_id", "tokens", fitted.of_tokens(F.col("tokens")).alias("v")).collect()
    matrix, _ = dense([r["tokens"] for r in rows], SMALL.buckets)
    want = matrix @ fitted.directions
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norms, out=np.zeros_like(want), where=norms > 1e-12)
    assert np.allclose(np.array([r["v"] for r in rows]), want, atol=1e-5)


def test_partitions_do_not_change_a_bit(tokens, fitted):
    again = latent.fit(tokens.repartition(7).orderBy(F.rand(3)), SMALL)
    assert np.array_equal(again.directions, fitted.directions) and np.array_equal(again.singular, fitted.singular)


def test_rows_of_many_weights_are_cut_between_rows_only(monkeypatch):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 50, size=k).tolist() for k in (0, 3, 70, 0, 1, 40, 0)] + [None]
    batch = pa.array(lists, pa.list_(pa.int32()))
    idf, basis = rng.random(50) + 0.1, rng.normal(size=(50, 4))
    whole = latent.projected(*latent.weights_of(batch, idf), basis)
    monkeypatch.setattr(latent, "SLICE", 5)
    assert np.array_equal(latent.projected(*latent.weights_of(batch, idf), basis), whole)
    assert not whole[[0, 3, 6, 7]].any() and whole[[1, 2, 4, 5]].all()


def test_empty_and_null_texts_and_an_empty_corpus(spark, tokens, fitted, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the of"), (4, "account fees")], "chunk_id int, text string")
    found = {r["chunk_id"]: r["v"] for r in odd.select("chunk_id", fitted.column(F.col("text")).alias("v")).collect()}
    assert all(not any(found[i]) for i in (1, 2, 3)) and len(found[4]) == SMALL.dimension
    nothing = latent.fit(bm25.with_tokens(odd.where("chunk_id < 0")), SMALL)
    assert not nothing.singular.any() and nothing.dimension == SMALL.dimension
    # Stored and read back, and the driver's vector of a question equals that of a text.
    fitted.save(str(tmp_path / "basis"))
    loaded = LatentEmbedder.load(spark, str(tmp_path / "basis"), SMALL)
    assert np.array_equal(loaded.directions, fitted.directions) and np.array_equal(loaded.singular, fitted.singular)
    text = " ".join(tokens.first()["tokens"][:30])
    assert keyword_tokens_of(text)
    asked = spark.createDataFrame([(text,)], "text string").select(loaded.column(F.col("text"))).first()[0]
    assert np.allclose(asked, loaded.embed_query(text), atol=1e-6)
    with pytest.raises(ValueError):
        LatentEmbedder.load(spark, str(tmp_path / "basis"), LatentSettings(dimension=5, buckets=1 << 12))


def test_registered_neighbours_against_brute_force(spark, tokens):
    """The query's distances are those of all pairs of vectors that a plain loop makes from the fitted basis."""
    fitted = latent.fit(tokens)
    rows = tokens.collect()
    matrix, idf = dense([r["tokens"] for r in rows], fitted.settings.buckets)
    assert np.allclose(idf, fitted.idf)
    vectors = matrix @ fitted.directions
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 1e-12)
    at = {r["chunk_id"]: i for i, r in enumerate(rows)}
    found = {}
    for r in QUERIES["latent_neighbours"](spark, DATA).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    assert sorted(map(int, found)) == [int(k) for k in sorted(at, key=int) if int(k) % 50 == 0]
    for asked, hits in found.items():
        distances = 1 - vectors @ vectors[at[asked]]
        hits.sort()
        assert np.allclose([d for _, _, d in hits], np.sort(distances)[:10], atol=1e-5)
        assert np.allclose([distances[at[i]] for _, i, _ in hits], [d for _, _, d in hits], atol=1e-5)
    top = QUERIES["latent_topk"](spark, DATA).collect()
    assert len(top) == 10 and [r["distance"] for r in top] == sorted(r["distance"] for r in top)


def test_blocks_of_any_size_add_the_same_bits():
    """A round's sums are exact, however the texts are cut into blocks, and those of the dense product."""
    rng = np.random.default_rng(8)
    m, lists = 300, [rng.integers(0, 300, size=k).tolist() for k in (1, 40, 900, 7, 3, 250, 250, 12)]
    ends, bucket, weight = latent.weights_of(pa.array(lists, pa.list_(pa.int32())), rng.random(m) + 0.1)
    basis = np.linalg.qr(rng.normal(size=(m, 5)))[0]
    fixed = np.rint(basis * latent.BASIS)
    sums = []
    for rows in (1, 3, 8):
        total, place, met = np.zeros((m, 5), np.int64), np.zeros(m, np.int32), set()
        for first in range(0, len(ends), rows):
            lo, hi = (ends[first - 1] if first else 0), ends[min(first + rows, len(ends)) - 1]
            met |= set(latent._add_block(total, ends[first : first + rows] - lo, bucket[lo:hi], weight[lo:hi], fixed, place).tolist())
        assert met == set(bucket.tolist()) and not place.any()
        sums.append(total)
    assert np.array_equal(sums[0], sums[1]) and np.array_equal(sums[0], sums[2])
    matrix = np.zeros((len(ends), m))
    matrix[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), bucket] = weight
    assert np.allclose(sums[0] / (latent.WEIGHT * latent.ROW), matrix.T @ (matrix @ basis), atol=1e-3)


def test_buckets_are_counted_once_per_text(spark):
    lists = [[5, 5, 1], [], None, [2], [6, 0, 6, 6]] * 300
    df = spark.createDataFrame([(x,) for x in lists], "buckets array<int>")
    rows = [(r["cells"], r["counts"]) for r in latent.counted(df, 7).collect()]
    assert sorted(rows) == sorted([([1, 5], [1, 2]), ([2], [1]), ([0, 6], [1, 3])] * 300)
