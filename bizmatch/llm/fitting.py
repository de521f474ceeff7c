"""What the classifiers share: a bounded sample of labelled documents, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, by: int) -> Column:
    """crc32(doc_id as text) mod by; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, seed: int, per_class: bool = False) -> DataFrame:
    """(doc_id, text, y) of the documents of about `most` labelled rows for which `learn` (on doc_id) holds.

    The rows are chosen by a hash of their id, and bounded by a limit of 2 x most besides; per_class gives each
    label value that bound of its own. Labels that are not 0 or 1 are left out.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.coalesce(learn, F.lit(False))).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows at most
    parts = []
    for y in (0, 1):
        n = counts.get(y, 0) if per_class else sum(counts.values())
        share = 1.0 if n <= most else most / n
        parts.append(rows.where((F.col("y") == y) & (draw < int(share * (1 << 20)))).limit(2 * most))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 4 x most rows at most
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on score (pool adjacent violators), to interpolate between."""
    order = np.argsort(score, kind="stable")
    at, inverse = np.unique(score[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # mean, weight, first, last
    for x, w, s in zip(at, weight, np.bincount(inverse, y[order])):
        blocks.append([s / w, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w2, _, last = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + m * w2) / (b[1] + w2)
            b[1] += w2
            b[3] = last
    xs = np.array([v for b in blocks for v in b[2:4]])
    return xs, np.array([b[0] for b in blocks for _ in range(2)])
