"""Deterministic text vectors for where no model is at hand, and random projections of vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: str, dim: int) -> list[float]:
    """Bytes of chained SHA-256 digests, spread over [-1, 1], of length 1."""
    out, digest = b"", text.encode()
    while len(out) < dim:
        digest = hashlib.sha256(digest).digest()
        out += digest
    v = np.frombuffer(out[:dim], np.uint8) / 127.5 - 1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def hash_embedding(text: Column, dim: int = 256) -> Column:
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: hash_vector(t, dim))

    return embed(text)


def separate(embedding: Column, dim: int, share: float = 0.1, noise: float = 0.15, seed: int = 42) -> Column:
    """A sparse random projection to `dim`, with noise seeded by the vector itself, of length 1."""

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return vectors
        x = np.stack(vectors.to_numpy()).astype(float)
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((x.shape[1], dim)) * (rng.random((x.shape[1], dim)) < share)
        y = x @ w
        for i, v in enumerate(x):
            own = np.random.default_rng(int.from_bytes(hashlib.sha256(v.round(6).tobytes()).digest()[:8], "little"))
            y[i] += noise * own.standard_normal(dim)
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return pd.Series(list(np.where(n > 0, y / np.where(n > 0, n, 1), y)))

    return project(embedding)
