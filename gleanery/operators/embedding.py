"""Embedding providers: one column function for corpora, one call for a single question."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import EmbeddingSettings
from gleanery.functions.batches import in_slices
from gleanery.functions.tokens import keyword_tokens, keyword_tokens_of
from gleanery.functions.vectors import as_list_array, hash_token_lists


class HashingEmbedder:
    """Offline default. Tokens are cut on the JVM; tasks only hash and sum them."""

    def __init__(self, settings: EmbeddingSettings = EmbeddingSettings()) -> None:
        self.settings = settings

    @property
    def dimension(self) -> int:
        return self.settings.dimension

    def of_tokens(self, tokens: Column) -> Column:
        dim, normalize = self.settings.dimension, self.settings.normalize

        @F.arrow_udf("array<float>")
        def hashed(batch: pa.Array) -> pa.Array:
            known: dict = {}
            some = lambda part: as_list_array(hash_token_lists(part, dim, normalize, known))
            return in_slices(some, pa.list_(pa.float32()), batch)

        return hashed(tokens)

    def column(self, text: Column) -> Column:
        return self.of_tokens(keyword_tokens(text))

    def embed_query(self, question: str) -> list[float]:
        tokens = pa.array([keyword_tokens_of(question)], pa.list_(pa.string()))
        rows = hash_token_lists(tokens, self.settings.dimension, self.settings.normalize)
        return [float(x) for x in rows[0].astype(np.float32)]


class ModelEmbedder:
    """Any model: `encode` maps a list of texts to one vector each and runs on the executors.

    Equal texts within an Arrow batch are encoded once, keyed by the whole text.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[float]]], settings: EmbeddingSettings) -> None:
        self.encode = encode
        self.settings = settings

    @property
    def dimension(self) -> int:
        return self.settings.dimension

    def _encode_all(self, texts: list[str]) -> np.ndarray:
        size = self.settings.batch_size
        parts = [np.asarray(self.encode(texts[i : i + size]), dtype=np.float64) for i in range(0, len(texts), size)]
        rows = np.concatenate(parts)
        if self.settings.normalize:
            norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)
        return rows

    def column(self, text: Column) -> Column:
        encode_all = self._encode_all

        @F.arrow_udf("array<float>")
        def encoded(batch: pa.Array) -> pa.Array:
            if len(batch) == 0:
                return pa.array([], pa.list_(pa.float32()))
            codes = batch.fill_null("").dictionary_encode()
            return as_list_array(encode_all(codes.dictionary.to_pylist())[codes.indices.to_numpy()])

        return encoded(text)

    def embed_query(self, question: str) -> list[float]:
        return [float(x) for x in self._encode_all([question])[0].astype(np.float32)]


def embed_chunks(chunks: DataFrame, embedder, text: str = "text") -> DataFrame:
    """Chunks with an `embedding` column over the whole chunk text, prefix included."""
    return chunks.withColumn("embedding", embedder.column(F.col(text)))
