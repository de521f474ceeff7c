"""Reading vectors, and coarse quantisers fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, usable_vector


def usable(vectors: DataFrame, vec_id: str, vector: str, *more: str) -> tuple[DataFrame, int]:
    """(vec_id, v, more...) of the vectors that take part, and their dimension: the most common one, others being left out."""
    rows = vectors.where(usable_vector(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), *more)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = top[0]["d"] if top else 0
    return rows.where(F.size("v") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """About `most` of n vectors, chosen by their ids' hashes: the bound of what a fit sees."""
    part = rows if n <= most else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    got = part.select("vec_id", "v").limit(2 * most).toArrow().sort_by("vec_id")
    if not got.num_rows:
        return np.empty((0, 0))
    return np.array(got.column(1).to_pylist(), np.float64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids at most; starts from distinct rows, drops centroids that lose all rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]]
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = sums[counts > 0] / counts[counts > 0][:, None]
    return c


def distances2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = distances2(x[at : at + 4096], c).argmin(1)
    return out


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scattered(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
