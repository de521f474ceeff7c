"""Near-duplicate vectors by product quantisation, without false negatives, and exact cosines.

Unit vectors with a cosine of t or more are at most r = sqrt(2 - 2t) apart. A vector x on the list of centroid
c can have such a neighbour on the list of c' only if x is within r of the plane halfway between c and c':
these lists are x's sufficient probes. There x goes as product-quantiser codes of its residual; with the
stored error e of the codes, the distance of a member to the coded x is at most r + e if they link. Only
where a member passes this table look-up is x sent whole, and cosines are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PACKED, bucket_of, components, dealt, materialize, mix64, pack, u64, unpack, usable_vector, width
from .forest import roots
from .vectors import distances2, k_means, matrix, nearest, sample, scattered, usable

#: Vectors that centroids and codebooks are fitted on, about; the most lists; subspaces and codes of each.
FIT_VECTORS, MOST_LISTS, SUBSPACES, CODES = 20_000, 4096, 8, 256
#: Members of a list, of one label, that are held against each other at once: twice the mean, within these bounds; larger ones are split.
CELL_LEAST, CELL_MOST = 256, 4096
#: Rows of a block of products; what one vector's rows are dealt into before they are added up.
TILE, SALTS = 1024, 64
#: Of packed rows: members that are held against each other too, visitors, members that are held against visitors alone.
MEMBER, VISITOR, APART = 0, 1, 2
#: What rounding may add to a distance.
SLACK = 1e-5


class Quantiser:
    def __init__(self, x: np.ndarray, lists: int):
        d = x.shape[1]
        self.centres = k_means(x, lists)
        self.gaps = np.sqrt(distances2(self.centres, self.centres))
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        rest = x - self.centres[nearest(x, self.centres)]
        self.books = [k_means(rest[:, a:b], CODES, rounds=5) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals, each coded vector's squared length, and its distance to the vector."""
        rest = x - self.centres[on]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1)
        coded = self.centres[on] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), (coded * coded).sum(1), np.sqrt(((x - coded) ** 2).sum(1))

    def probes(self, x: np.ndarray, on: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a list behind its own that can hold a vector within the radius."""
        d2 = distances2(x, self.centres)
        own = d2[np.arange(len(x)), on]
        near = (d2 - own[:, None]) <= 2 * (radius + SLACK) * self.gaps[on] + SLACK
        near &= np.arange(len(self.centres))[None, :] > on[:, None]
        return np.nonzero(near)

    def tables(self, y: np.ndarray) -> list[np.ndarray]:
        """Each row's products with all codes of a subspace."""
        return [y[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def _cells(blobs: list[bytes], kinds: list) -> dict[int, list[np.ndarray]]:
    """Packed rows, whose first column is their cell, by cell."""
    columns = unpack(blobs, kinds)
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1], [True]))) if len(order) else []
    return {int(columns[0][lo]): [c[lo:hi] for c in columns[1:]] for lo, hi in zip(cuts[:-1], cuts[1:])}


def _by_kind(batches) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {MEMBER: [], VISITOR: [], APART: []}
    for batch in batches:
        for blob, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out[kind].append(blob)
    return out


def _sent(kind: int, cell: np.ndarray, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    out = pack(bucket_of(cell, n), [cell, *columns], n)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, kind, np.int32))], names=["bucket", "blob", "kind"])


def equal_rows(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, head) of each row, and (head, rep, m) of each head: rep is the first of the m rows of a label and vector.

    A vector that very many rows hold has SALTS heads, each the first of a part of them, so that no task gets all.
    Labels and vectors are told apart by 128 bits of hash.
    """
    keys = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2")]
    rows = listed.select("row", *keys, F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    part = Window.partitionBy("k1", "k2", "salt")
    rows = materialize(rows.select("row", "k1", "k2", F.min("row").over(part).alias("head"), F.count("*").over(part).alias("c")), "equal")
    whole = Window.partitionBy("k1", "k2")
    heads = rows.where("row = head").select("head", F.min("head").over(whole).alias("rep"), F.sum("c").over(whole).alias("m"))
    return rows.select("row", "head"), materialize(heads, "heads")


def links_of(y: np.ndarray, z: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of y and z (of y and y, each once, without z) whose product is `cosine` or more, block by block."""
    for a in range(0, len(y), TILE):
        for b in range(a if z is None else 0, len(y) if z is None else len(z), TILE):
            near = y[a : a + TILE] @ (y if z is None else z)[b : b + TILE].T >= cosine
            i, j = np.nonzero(np.triu(near, 1) if z is None and a == b else near)
            if len(i):
                yield i + a, j + b


def counted(rows: np.ndarray, weight: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """(row, n, root) of the rows that pairs link: n is the weight of their partners, root a row that they lead to."""
    times = np.zeros(len(rows), np.int64)
    a = b = np.empty(0, np.int64)
    for i, j in pairs:
        times += np.bincount(i, weight[j], len(rows)).astype(np.int64) + np.bincount(j, weight[i], len(rows)).astype(np.int64)
        root = roots(len(rows), np.concatenate((a, i)), np.concatenate((b, j)))
        a = np.flatnonzero(root != np.arange(len(rows)))  # a forest says as much as all pairs so far
        b = root[a]
    has = times > 0
    if not has.any():
        return None
    root = roots(len(rows), a, b)
    return pa.RecordBatch.from_arrays([pa.array(rows[has]), pa.array(times[has]), pa.array(rows[root[has]])], names=["row", "n", "root"])


def vector_duplicates(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Link vectors of the same label whose cosine is `cosine` or more.

    Returns one row for each row of vectors: vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id that links lead to, itself included), kept (vec_id = component_id). Rows with a null label, or
    a vector that is null, empty, zero, holds a null, NaN or infinity, or has another dimension than most, link
    with nothing. Rows that repeat a vector of their label link with each other. An empty table gives no rows; other columns
    are not read.

    Equal vectors of a label are held against others once, and count as often as there are. Links are counted where
    they are found, so that pairs are never sent on: a task returns each row's count and one link for each but the
    first member of a component in its cell. Large lists of one label are split into parts, each two of which meet
    in a cell of their own.
    """
    spark = vectors.sparkSession
    good, d = usable(vectors.where(F.col(label).isNotNull()), vec_id, vector)
    n = good.count() if d else 0
    alone = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    fit = sample(good, n, FIT_VECTORS)
    known = spark.sparkContext.broadcast(Quantiser(fit / np.sqrt((fit * fit).sum(1))[:, None], int(min(MOST_LISTS, max(1, round(n**0.5))))))
    dtype = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    v_kind, c_kind = f"V{np.dtype(dtype).itemsize * d}", f"V{len(known.value.books)}"

    def unit(v: np.ndarray) -> np.ndarray:
        x = np.frombuffer(np.ascontiguousarray(v).tobytes(), dtype).reshape(-1, d).astype(np.float64)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def packed_vectors(column: pa.Array) -> np.ndarray:
        return np.ascontiguousarray(matrix(column, d).astype(dtype)).view(v_kind).ravel()

    def cell_of(labels: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return mix64(labels.view(np.uint64) + lists.astype(np.uint64) * u64(0x9E3779B97F4A7C15))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = packed_vectors(batch.column(1))
                on = nearest(unit(v), known.value.centres)
                cell = cell_of(batch.column(2).to_numpy(), on)
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(on), pa.array(cell.view(np.int64))], names=["row", "label", "v", "list", "cell"])

    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string"))).alias("label"), F.monotonically_increasing_id().alias("row"))
    every = materialize(every, "vectors")
    fine = every.where(F.col("label").isNotNull() & usable_vector(F.col("v")) & (F.size("v") == d)).select("vec_id", F.col("v").cast("array<double>"), "label", "row")
    listed = materialize(fine.mapInArrow(assign, "row long, label long, v binary, list long, cell long"), "lists")
    members, heads = equal_rows(listed)
    listed = materialize(listed.join(heads.where("head = rep").select(F.col("rep").alias("row"), "m"), "row"), "vectors-once")
    counts = listed.groupBy("cell").count()
    cells, n = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    most = min(CELL_MOST, max(CELL_LEAST, 2 * n // max(1, cells)))
    large = counts.where(F.col("count") > most).toArrow().sort_by("cell")  # 16 bytes each, n / most of them at most
    split = spark.sparkContext.broadcast((large.column(0).to_numpy(), -(-large.column(1).to_numpy() // most)))
    n_buckets = width(listed, growth=4.0, target=16 << 20)

    def parts(cell: np.ndarray) -> np.ndarray:
        known, times = split.value
        if not len(known):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(known, cell.view(np.int64)), len(known) - 1)
        return np.where(known[at] == cell.view(np.int64), times[at], 1)

    def meeting(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The cell where part b of a list's members meets part a, or itself."""
        return mix64(cell + mix64(a.astype(np.uint64) * u64(1 << 32) + b.astype(np.uint64) + u64(3)))

    def own_part(cell: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (scattered(rows) % parts(cell).astype(np.uint64)).astype(np.int64)

    def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each index so many times, with the number of the time."""
        rep = np.repeat(np.arange(len(times)), times)
        return rep, np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)

    def look_up(batches):
        """Members whole, to their part; visitors as codes, to all parts of the lists that they probe."""
        q = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, labels, on, cell = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), v_kind)
            x, cell = unit(v), cell.view(np.uint64)
            p = own_part(cell, rows)
            yield _sent(MEMBER, meeting(cell, p, p), [rows, v], n_buckets)
            codes, norm, err = q.encode(x, on)
            codes = np.ascontiguousarray(codes).view(c_kind).ravel()
            for at in np.array_split(np.arange(len(x)), max(1, len(x) // 1024)):
                who, to = q.probes(x[at], on[at], radius)
                who = at[who]
                target = cell_of(labels[who], to)
                rep, where = spread(parts(target))
                w = who[rep]
                yield _sent(VISITOR, meeting(target[rep], where, where), [rows[w], codes[w], on[w].astype(np.int32), norm[w].astype(np.float32), err[w].astype(np.float32)], n_buckets)

    def pass_look_up(batches):
        q = known.value
        blobs = _by_kind(batches)
        members = _cells(blobs[MEMBER], [np.uint64, np.int64, v_kind])
        for cell, (rows, codes, on, norm, err) in _cells(blobs[VISITOR], [np.uint64, np.int64, c_kind, np.int32, np.float32, np.float32]).items():
            if cell not in members:
                continue
            y = unit(members[cell][1])
            tables, base = q.tables(y), y @ q.centres.T
            codes = np.frombuffer(codes.tobytes(), np.uint8).reshape(len(rows), -1)
            for lo in range(0, len(rows), 4096):
                part = slice(lo, lo + 4096)
                dot = base[:, on[part]].copy()
                for m, t in enumerate(tables):
                    dot += t[:, codes[part, m]]
                reach = (radius + err[part].astype(np.float64) + SLACK) ** 2
                hit = (1 - 2 * dot + norm[part][None, :] <= reach[None, :] + SLACK).any(0)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rows[part][hit]), pa.array(np.full(int(hit.sum()), cell, np.uint64).view(np.int64))], names=["row", "to"])

    looked = dealt(listed.mapInArrow(look_up, PACKED + ", kind int"), n_buckets).mapInArrow(pass_look_up, "row long, to long")
    visits = looked.join(listed.select("row", "v", "m"), "row").select("row", "v", "to", "m")

    def whole(batches):
        """Members to their part, and to the cells where it meets the other parts of a split list."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cell, m = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), v_kind)
            p, times = own_part(cell, rows), parts(cell)
            yield _sent(MEMBER, meeting(cell, p, p), [rows, m, v], n_buckets)
            rep, other = spread(np.where(times > 1, times, 0))
            for kind, pick in ((APART, other < p[rep]), (VISITOR, other > p[rep])):
                r, o = rep[pick], other[pick]
                if len(r):
                    yield _sent(kind, meeting(cell[r], np.minimum(o, p[r]), np.maximum(o, p[r])), [rows[r], m[r], v[r]], n_buckets)

    def visiting(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column(1).to_pylist()), v_kind)
                yield _sent(VISITOR, batch.column(2).to_numpy().view(np.uint64), [batch.column(0).to_numpy(), batch.column(3).to_numpy(), v], n_buckets)

    def count(batches):
        blobs = _by_kind(batches)
        kinds = [np.uint64, np.int64, np.int64, v_kind]
        guests = _cells(blobs[VISITOR], kinds)
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, v_kind)
        for own, cells in ((True, _cells(blobs[MEMBER], kinds)), (False, _cells(blobs[APART], kinds))):
            for cell, (rows, m, v) in cells.items():
                y, (g_rows, g_m, g) = unit(v), guests.get(cell, none)
                pairs = links_of(y, None, cosine) if own else iter(())
                if len(g):
                    pairs = chain(pairs, ((a, b + len(rows)) for a, b in links_of(y, unit(g), cosine)))
                found = counted(np.concatenate((rows, g_rows)), np.concatenate((m, g_m)), pairs)
                if found:
                    yield found

    sent = listed.select("row", "v", "cell", "m").mapInArrow(whole, PACKED + ", kind int").unionByName(visits.mapInArrow(visiting, PACKED + ", kind int"))
    found = materialize(dealt(sent, n_buckets).mapInArrow(count, "row long, n long, root long"), "links")
    links = found.groupBy(F.col("row").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(found, "row", "root").withColumnRenamed("node", "rep")
    # what follows is known of each head, and joined to the rows by their heads: SALTS of them share a common vector
    heads = heads.join(links, "rep", "left").join(group, "rep", "left")
    heads = heads.select("head", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = materialize(members.join(every.select("row", "vec_id"), "row"), "named")
    least = named.groupBy("head").agg(F.min("vec_id").alias("vec_id")).join(heads, "head").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    heads = materialize(heads.join(least, "component").select("head", "n_links", "component_id"), "heads")
    linked = named.join(heads, "head").select("vec_id", "n_links", "component_id")
    apart = every.join(members.select("row"), "row", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
