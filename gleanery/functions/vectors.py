"""Vector kernels: Arrow batches in, numpy matrix products inside the task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
DECIMALS = 12


def checked_metric(metric: str) -> str:
    """Unknown metric names mean cosine."""
    return metric if metric in METRICS else "cosine"


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """A list column of equal-length vectors as float64 rows; null vectors become NaN rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(np.nanmax(lengths)) if len(lengths) and not np.all(np.isnan(lengths.astype(float))) else 0
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if vectors.null_count == 0 and (lengths == dim).all():
        return flat.reshape(len(vectors), dim)
    matrix = np.full((len(vectors), dim), np.nan)
    matrix[np.nan_to_num(lengths.astype(float)) == dim] = flat.reshape(-1, dim)
    return matrix


def cosine_matrix(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every row with every query; zero where either norm is zero."""
    norms = np.sqrt((rows * rows).sum(axis=1))[:, None] * np.sqrt((queries * queries).sum(axis=1))[None, :]
    dots = rows @ queries.T
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)


def distance_matrix(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """cosine = 1 - cos, l2 = squared Euclidean, ip = 1 - dot, to DECIMALS places.

    Copies of a row may get sums that differ in the last bit, by their place in a matrix product;
    rounding makes them tie, so that their order by id is the same in every run.
    """
    if metric == "l2":
        distances = np.stack([((rows - q) ** 2).sum(axis=1) for q in queries], axis=1)
    elif metric == "ip":
        distances = 1.0 - rows @ queries.T
    else:
        distances = 1.0 - cosine_matrix(rows, queries)
    return np.round(distances, DECIMALS)


def distance_to(query: Sequence[float], metric: str = "cosine") -> Callable[[Column], Column]:
    """Column function: distance of an embedding column to one fixed query vector."""
    metric = checked_metric(metric)
    target = np.asarray(query, dtype=np.float64)[None, :]

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.float64())
        return pa.array(distance_matrix(as_matrix(vectors), target, metric)[:, 0], from_pandas=True)

    return distance


def similarity(distance: Column) -> Column:
    """Distance to score, floored at zero whatever the metric."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def hashed_position(term: str, dim: int) -> tuple[int, float]:
    """Bucket from the first eight hex digits of the md5, sign from the ninth."""
    digest = hashlib.md5(term.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dim, (1.0 if digest[8] < "8" else -1.0)


def hash_token_lists(tokens: pa.ListArray, dim: int, normalize: bool, known: dict | None = None) -> np.ndarray:
    """Feature hashing of token lists; each distinct term is hashed once, and not at all where `known` has its place already."""
    known = {} if known is None else known
    rows = np.zeros((len(tokens), dim))
    flat = tokens.flatten().dictionary_encode()
    if len(flat):
        terms = flat.dictionary.to_pylist()
        known.update((t, hashed_position(t, dim)) for t in terms if t not in known)
        placed = [known[t] for t in terms]
        bucket = np.array([p[0] for p in placed])
        sign = np.array([p[1] for p in placed])
        codes = flat.indices.to_numpy()
        owner = tokens.value_parent_indices().to_numpy() if hasattr(tokens, "value_parent_indices") else (
            np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy())
        )
        rows = np.bincount(
            owner * dim + bucket[codes], weights=sign[codes], minlength=len(tokens) * dim
        ).reshape(len(tokens), dim)
    if normalize:
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)
    return rows


def as_list_array(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.float32).ravel()))
