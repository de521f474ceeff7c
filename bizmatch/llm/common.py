"""What the operators share: scratch tables, packed exchanges, components, vectors."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (local tests).
LOCAL_SCRATCH = "/tmp/checkpoints/bizmatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or a local one where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once under the shared folder and read it back: lineage is cut, and nothing is computed twice.

    With `by`, a column of few values, each value has a folder of its own, and who asks for one reads no other.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables and files that df reads, as far as Catalyst knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # rows from the driver have no known size


def width(df: DataFrame, growth: float = 1.0, target: int = 48 << 20, least: int = 1) -> int:
    """Partitions for an exchange of growth x df's bytes, so that each holds about `target` bytes at any input size; `least` or more."""
    least = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(max(least, min(200_000, -(-input_bytes(df) * growth // target))))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hand rows to Python in batches of at most so many rows and bytes: whole texts and blobs are long, and a task holds a batch several times over."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def tidy() -> None:
    """Give a worker's freed memory back to the system: workers are kept between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """run, a function from batches to batches, that tidies up behind its last one."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def u64(s: int) -> np.uint64:
    return np.uint64(s & 0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> u64(30))
    x = x * u64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> u64(27))
    x = x * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """The one of n buckets that a scrambled 64-bit value falls in, by its top 32 bits."""
    return ((x >> u64(32)) * u64(n) >> u64(32)).astype(np.int64)


def dealt(df: DataFrame, n: int, bucket: str = "bucket") -> DataFrame:
    """Deal rows to the partition that their bucket column (0 to n - 1) names."""
    return df.repartitionById(n, F.col(bucket).cast("int"))


#: Bytes of a packed byte string, about.
BLOB = 1 << 20
PACKED = "bucket int, blob binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def pack(bucket: np.ndarray, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Rows of equal-length columns, packed into byte strings of about BLOB bytes for each bucket: count, then each column's bytes."""
    most = max(1, BLOB // max(1, sum(c.dtype.itemsize for c in columns)))
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    buckets, blobs = [], []
    for b in np.flatnonzero(np.diff(ends)):
        for lo in range(ends[b], ends[b + 1], most):
            hi = min(lo + most, ends[b + 1])
            buckets.append(int(b))
            blobs.append(np.int64(hi - lo).tobytes() + b"".join(c[lo:hi].tobytes() for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=PACKED_ARROW)


def unpack(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns, of the given numpy dtypes, of packed byte strings together."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        m, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for out, kind in zip(parts, kinds):
            kind = np.dtype(kind)
            out.append(np.frombuffer(blob, kind, m, at))
            at += m * kind.itemsize
    return [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds)]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges, by alternating large-star and small-star contraction.

    Returns (node, component) for every node of an edge between two different nodes; component is the
    smallest node of its component. Nulls and self edges count for nothing. Each step is one grouped
    minimum with partial aggregation and one equi-join, so that no neighbour list is ever gathered; every
    round's edges are written to the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.distinct(), "cc")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(e)
        e = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


#: Bits of the filter of marked().
FILTER_BITS = 1 << 25


def marked(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with a column __hit, true for all whose key is in ids (one column of that name) and a few others.

    Wide rows are not dealt for it: a bitmap of hashed ids goes to all, of FILTER_BITS bits at most whatever the
    input.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(__p % 64 as int))")
    bits = ids.select(place.alias("__p")).distinct().groupBy(F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    keyed = rows.withColumn("__p", place).withColumn("__w", F.shiftright("__p", 6)).join(F.broadcast(bits), "__w", "left")
    return keyed.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__p", "__w", "__bits")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows without those whose key is in ids (one column of that name); a null key stays. Only rows that the filter marks are dealt."""
    keyed = marked(rows, ids, key)
    sure = ~F.col("__hit") | F.col(key).isNull()
    return keyed.where(sure).select(*rows.columns).unionByName(keyed.where(~sure).select(*rows.columns).join(ids, key, "left_anti"))


def usable_vector(v: Column) -> Column:
    """True for a vector of one or more components that is not zero and holds no null, NaN or infinity."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
