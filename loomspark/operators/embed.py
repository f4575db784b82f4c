"""Vectors of texts by hashing, for searches without a model: fixed, and without meaning beyond shared words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a gram, bytes of a token's digest.
GRAM, DIGEST = 3, 8


def hashed_vector(text: str | None, dim: int, known: dict[str, int] | None = None) -> np.ndarray:
    """Words and 3-word grams, each adding 1 or, where its digest's highest bit is clear, -1 at its digest modulo ``dim``; scaled to length 1."""
    words = (text or "").lower().split()
    tokens = words + [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
    if not tokens:
        return np.zeros(dim)
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=DIGEST).digest() for t in tokens)
    values = np.frombuffer(digests, ">u8").astype(np.uint64)
    signs = np.where(values >> np.uint64(63) == 1, 1.0, -1.0)
    vector = np.bincount((values % np.uint64(dim)).astype(np.int64), signs, dim)
    length = np.sqrt((vector * vector).sum())
    return vector / length if length else vector


def embed(chunks: DataFrame, dim: int, text: str = "text") -> DataFrame:
    """``chunks`` (id, text) as (id, embedding, embedding_model), in Arrow batches; a null or empty text has a vector of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [hashed_vector(x, dim) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array([f"hashing-{dim}"] * len(vectors))], ["id", "embedding", "embedding_model"])

    return chunks.select("id", text).mapInArrow(run, f"id {chunks.schema['id'].dataType.simpleString()}, embedding array<double>, embedding_model string")
