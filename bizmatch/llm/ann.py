"""Approximate nearest neighbours by adaptive dimension scans of probed inverted lists.

Two rounds: a query first scans its nearest lists, which gives it k neighbours and so a bound; then, with that
bound, the others that it probes, but for those that are too far away to hold a nearer vector. In a list, rotated
vectors lie in blocks of columns, and after each block a hypothesis test abandons the candidates whose partial
distance is too large for the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PACKED, dealt, materialize, pack, unpack, width
from .vectors import distances2, k_means, matrix, nearest, rotation, sample, scattered, usable

#: Vectors that the coarse quantiser is fitted on, about: so many, or for each list; and the most lists.
FIT_VECTORS, FIT_PER_LIST, MOST_LISTS = 20_000, 10, 16_384
#: Sampled queries whose true neighbours in the sample say how many lists to probe, the share of neighbours that these
#: lists have to hold, and the least part of the lists (a sample's neighbours are not those of all vectors).
MEASURED, WANTED, SPARE = 256, 0.985, 1.1
#: Lists of the first round.
FIRST = 2
#: Rows of a list that are scanned together: twice a list's mean, within these bounds; larger lists are split.
CELL_LEAST, CELL_MOST = 256, 16_384
#: Dimensions of a column block; strictness of the test that abandons a candidate (larger: fewer mistakes).
BLOCK, STRICT = 16, 2.5


def distinct_first(ids: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of order that have an id not met before."""
    _, at = np.unique(ids[order], return_index=True)
    return order[np.sort(at)[:k]]


def scan(x: np.ndarray, ids: np.ndarray, turned: list[np.ndarray], q: np.ndarray, q_turned: np.ndarray, own: int, k: int, repeats: bool, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of q's k nearest rows of x no farther than bound, as far as the tests let them through.

    `turned` holds the rotated rows in blocks of columns. After each block, a row is abandoned when its partial
    distance, scaled up to all dimensions, is larger than the bound by more than chance allows. The bound is the
    given one or the k-th distance of x's own rows, whichever is less; with `repeats` some rows share an id: the
    bound is that of k ids, and each id is returned once, by its nearest row.
    """
    alive = np.flatnonzero(ids != own)
    d, seen = x.shape[1], 0
    part = np.zeros(len(alive))
    most = bound * bound * (1 + 1e-9) + 1e-12
    for b, block in enumerate(turned):
        w = block.shape[1]
        diff = block[alive] - q_turned[seen : seen + w]
        part = part + np.einsum("ij,ij->i", diff, diff)
        seen += w
        if b == 0 and len(alive) > k and not np.isfinite(bound):  # any k ids bound the k-th distance: take the k nearest so far
            first = distinct_first(ids, alive[np.argsort(part, kind="stable")], k) if repeats else alive[np.argpartition(part, k - 1)[:k]]
            if len(first) == k:
                most = float(((x[first] - q) ** 2).sum(1).max()) * (1 + 1e-6) + 1e-12
        limit = most * (1 if seen == d else (1 + STRICT / np.sqrt(seen)) ** 2 * seen / d) + 1e-12
        stay = part <= limit
        alive, part = alive[stay], part[stay]
    exact = np.sqrt(((x[alive] - q) ** 2).sum(1))
    order = np.lexsort((ids[alive], exact))
    order = order[exact[order] <= bound]
    order = distinct_first(ids[alive], order, k) if repeats else order[:k]
    return ids[alive][order], exact[order]


class Lists(NamedTuple):
    """Centroids, each list's rows and radius, its parts and the number of its first part, and the lists to probe."""

    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    probes: int

    def part_of(self, on: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[on] + (scattered(ids) % self.parts[on].astype(np.uint64)).astype(np.int64)

    def targets(self, x: np.ndarray, bound: np.ndarray | None, k: int) -> list[np.ndarray]:
        """The parts that each query scans: of its nearest lists, or with a bound, of the rest that it probes."""
        d2 = distances2(x, self.centres)
        order = d2.argsort(1, kind="stable")
        near = np.maximum(FIRST, (self.sizes[order].cumsum(1) < 2 * k + 2).sum(1) + 1)
        out = []
        for j, o in enumerate(order):
            if bound is None:
                mine = o[: near[j]]
            else:
                mine = o[near[j] : max(near[j], self.probes)]
                # no row of a list is nearer than its centroid less the list's radius
                mine = mine[np.sqrt(d2[j, mine]) - self.radius[mine] <= bound[j] + 1e-6]
            out.append(np.concatenate([np.arange(self.first[v], self.first[v] + self.parts[v]) for v in mine]) if len(mine) else np.empty(0, np.int64))
        return out


def probes_measured(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The lists that hold WANTED of the sampled queries' true neighbours in the sample, and a few more."""
    if len(x) < 2:
        return len(centres)
    asked = np.random.default_rng(13).permutation(len(x))[:MEASURED]
    on, ranks = nearest(x, centres), []
    for at in np.array_split(asked, max(1, len(asked) // 32)):
        d2 = distances2(x[at], x)
        d2[np.arange(len(at)), at] = np.inf
        true = np.argpartition(d2, min(k, len(x) - 1) - 1, 1)[:, : min(k, len(x) - 1)]
        place = distances2(x[at], centres).argsort(1, kind="stable").argsort(1)
        ranks.append(np.take_along_axis(place, on[true], 1).ravel())
    return int(min(len(centres), np.ceil((np.quantile(np.concatenate(ranks), WANTED, method="higher") + 1) * SPARE)))


def search_cells(blobs: list[bytes], kinds: list, dtype: str, turn: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of the queries in packed cells: (cell, id, is query, bound, vector)."""
    cell, ids, is_q, bound, v = unpack(blobs, kinds)
    order = np.lexsort((is_q, cell))
    cell, ids, is_q, bound, v = (c[order] for c in (cell, ids, is_q, bound, v))
    cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else []
    d = len(turn)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mid = lo + int(np.searchsorted(is_q[lo:hi], 1))
        if mid in (lo, hi):
            continue
        x, q = (np.frombuffer(v[a:b].tobytes(), dtype).reshape(-1, d).astype(np.float64) for a, b in ((lo, mid), (mid, hi)))
        rotated, q_turned = x @ turn, q @ turn
        turned = [np.ascontiguousarray(rotated[:, b : b + BLOCK]) for b in range(0, d, BLOCK)]
        got, repeats = [], len(np.unique(ids[lo:mid])) < mid - lo
        for j, own in enumerate(ids[mid:hi]):
            found, score = scan(x, ids[lo:mid], turned, q[j], q_turned[j], own, k, repeats, bound[mid + j])
            got.append((np.full(len(found), own), found, score))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors found, by Euclidean distance, of every vector for which `is_query` holds.

    Returns (query_id, rank, vec_id, score): rank from 1, nearest first, ties to the smaller vec_id; score is the
    exact distance in double precision. A query's own vec_id is no candidate; rows that repeat a vec_id count once,
    by the nearest. Vectors that are null, empty, zero or hold a null, NaN or infinity take no part, nor do those
    of another dimension than most, nor rows without a vec_id. A query gets fewer than k rows only if there are
    fewer candidates. An empty table gives no rows; other columns are not read.

    Every vector is put on the list of its nearest centroid; the centroids are fitted on a bounded sample, whose
    own neighbours also say how many lists a query probes. A list of much more than the mean is split, so that no
    task depends on a list's size.
    """
    spark = vectors.sparkSession
    asked = vectors.where(F.col(vec_id).isNotNull()).withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows, d = usable(asked, vec_id, vector, "__query")
    n = rows.count() if d else 0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(MOST_LISTS, max(1, round(n**0.5))))
    fit = sample(rows, n, max(FIT_VECTORS, FIT_PER_LIST * lists))
    centres = k_means(fit, lists)
    known = spark.sparkContext.broadcast((centres, rotation(d)))

    def assign(batches):
        c, _ = known.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), d)
                on = nearest(x, c)
                away = np.sqrt(((x - c[on]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(on, pa.int64()), pa.array(away)], names=["vec_id", "v", "q", "list", "away"])

    listed = materialize(rows.mapInArrow(assign, "vec_id long, v array<double>, q boolean, list long, away double"), "lists")
    sizes, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    queries = 0
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if("q").alias("q")).collect():  # MOST_LISTS rows at most
        sizes[r["list"]], radius[r["list"]] = r["n"], r["r"]
        queries += r["q"]
    parts = np.maximum(1, -(-sizes // min(CELL_MOST, max(CELL_LEAST, 2 * n // len(centres)))))
    index = Lists(centres, sizes, radius, parts, np.cumsum(parts) - parts, probes_measured(fit, centres, k))
    sent = spark.sparkContext.broadcast(index)
    dtype = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    kinds = [np.int64, np.int64, np.uint8, np.float64, f"V{np.dtype(dtype).itemsize * d}"]
    row_bytes = sum(np.dtype(x).itemsize for x in kinds)

    def placed(lists_probed: float, bounds: DataFrame | None) -> DataFrame:
        """Members in the part of their list that their id falls in, queries in all parts that they scan; searched."""
        copies = n + queries * lists_probed * float(parts.mean())
        n_buckets = width(listed, growth=0, least=int(-(-copies * row_bytes // (16 << 20))))
        unbounded = bounds is None

        def out(cell, ids, x, bound):
            v = np.ascontiguousarray(x.astype(dtype)).view(kinds[-1]).ravel()
            is_q = np.zeros(len(x), np.uint8) if bound is None else np.ones(len(x), np.uint8)
            return pack(cell % n_buckets, [cell, ids, is_q, np.zeros(len(x)) if bound is None else bound, v], n_buckets)

        def members(batches):
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column(0).to_numpy()
                    yield out(sent.value.part_of(batch.column(2).to_numpy(), ids), ids, matrix(batch.column(1), d), None)

        def askers(batches):
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
                for at in np.array_split(np.arange(len(ids)), len(ids) // 64 + 1) if len(ids) else []:
                    bound = batch.column(2).to_numpy()[at]
                    to = sent.value.targets(x[at], None if unbounded else bound, k)
                    rep = np.repeat(np.arange(len(at)), [len(t) for t in to])
                    if len(rep):
                        yield out(np.concatenate(to), ids[at][rep], x[at][rep], bound[rep])

        mine = listed.where("q").select("vec_id", "v")
        if bounds is None:
            mine = mine.withColumn("bound", F.lit(float("inf")))
        else:
            mine = mine.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        both = listed.select("vec_id", "v", "list").mapInArrow(members, PACKED).unionByName(mine.mapInArrow(askers, PACKED))
        search = lambda batches: search_cells([b for batch in batches for b in batch.column(1).to_pylist()], kinds, dtype, known.value[1], k)
        found = dealt(both, n_buckets).mapInArrow(search, "query_id long, vec_id long, score double")
        return materialize(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "found")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = placed(FIRST, None)
    bounds = best(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = placed(index.probes, bounds)
    every = near.unionByName(rest)
    return best(every).select("query_id", "rank", "vec_id", "score")
