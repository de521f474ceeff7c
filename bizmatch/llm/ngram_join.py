"""Exact Jaccard join of word n-gram sets, by prefixes of token combinations.

Tokens (shingles) are ordered: rare ones first, by value, then frequent ones. A set of n tokens that has to
share o of them with a partner may miss n - o; its prefix is extended until it holds more signatures than
misses can spoil. Each rare token is a signature by itself. Frequent tokens are dealt into groups, and each
pair of tokens of a group is one signature: c of them in a group stand for c - 1 misses. So two sets that link
share a signature, and what shares one is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, bucket_of, components, dealt, marked, materialize, mix64, pack, small_batches, tidied, u64, unpack, width
from .forest import roots
from .shingles import set_marks, set_sketches, shingle_sets, text_blocks

#: A token in more sets than this is frequent, if it is among the MOST_FREQUENT.
RARE = 16
#: The frequent tokens are known to every task: this bounds them (12 bytes each).
MOST_FREQUENT = 1 << 20
#: Bits of a set's sketch.
SKETCH = 512
#: Parts that the sets of one signature are dealt into before they meet.
SALTS = 16
#: Sets of a part of a group, and their tokens together; tokens of a block of products.
CELL_SETS, CELL_TOKENS, TOKENS = 512, 4 << 20, 4096


def spare(n, percent: int):
    """1 + the tokens that a set of n may miss in a partner."""
    return n - (percent * n + 99) // 100 + 1


def bands(percent: int, top: int) -> np.ndarray:
    """Lower ends of size bands: sets that can link lie in one band or two next to each other."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, (100 * ends[-1] + percent - 1) // percent))
    return np.array(ends, np.int64)


def combinations(frequent: np.ndarray, left: int, groups: int, band: int) -> np.ndarray:
    """Signatures of frequent tokens (in order): pairs within groups, of the shortest prefix worth `left` misses."""
    group = (mix64(frequent + u64(0x51ED2701)) % u64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    counts = np.ones(len(group), np.int64)
    counts[order[first]] = 0  # the first of a group is worth nothing
    take = int(np.searchsorted(np.cumsum(counts), left)) + 1
    group = group[:take]
    order = np.argsort(group, kind="stable")
    token, group = frequent[:take][order], group[order]
    out = []
    for gap in range(1, len(token)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        a, b = token[:-gap][same], token[gap:][same]
        out.append(mix64(np.minimum(a, b) * u64(0x9E3779B97F4A7C15) + np.maximum(a, b) * u64(0xC2B2AE3D27D4EB4F) + u64(band * 0x165667B19E3779F9 + 1)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for lo, hi in text_blocks(texts):
            yield batch, lo, hi, *shingle_sets(texts[lo:hi], words)


def _distinct(values: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """True for the tokens of one set of each mark."""
    first = np.zeros(len(ends), bool)
    first[np.unique(marks, return_index=True)[1]] = True
    return np.repeat(first, np.diff(np.concatenate(([0], ends))))


def frequent_tokens(docs: DataFrame, words: int, n: int) -> np.ndarray:
    """Buckets and low bits of the most frequent tokens, sorted, MOST_FREQUENT at most; counted over all documents."""

    def deal(batches):
        held, size = [], 0
        for _, _, _, values, ends in _texts(batches, words):
            own = values[_distinct(values, ends, set_marks(values, ends))]
            held.append(own)
            size += len(own)
            if size > 1 << 20:
                v = np.concatenate(held)
                yield pack(bucket_of(v, n).astype(np.uint16 if n <= 1 << 16 else np.int64), [v.astype(np.uint32)], n)
                held, size = [], 0
        if held:
            v = np.concatenate(held)
            yield pack(bucket_of(v, n).astype(np.uint16 if n <= 1 << 16 else np.int64), [v.astype(np.uint32)], n)

    most = max(1, MOST_FREQUENT // n)

    def count(batches):
        bucket, blobs = -1, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bucket = b
                blobs.append(blob)
        if blobs:
            (low,) = unpack(blobs, [np.uint32])
            low = np.sort(low)
            at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            times = np.diff(np.concatenate((at, [len(low)])))
            low, times = low[at][times > RARE], times[times > RARE]
            low = low[np.argsort(-times, kind="stable")[:most]]
            yield pack(np.full(len(low), bucket), [np.sort(low)], n)

    counted = dealt(docs.select("text").mapInArrow(tidied(deal), PACKED), n).mapInArrow(tidied(count), PACKED)
    found = [(r["bucket"], np.frombuffer(r["blob"], np.uint32, -1, 8)) for r in counted.collect()]  # 4 bytes each for MOST_FREQUENT tokens at most
    return np.sort(np.concatenate([np.uint64(b << 32) | low.astype(np.uint64) for b, low in found])) if found else np.empty(0, np.uint64)


def _block_signatures(values, ends, marks, frequent, n, percent, cuts):
    """(token, mark, size) of the single signatures of a block of sets, and of the combined ones."""
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    firsts = np.zeros(len(ends), bool)
    firsts[np.unique(marks, return_index=True)[1]] = True
    # sets that are too small for any partner but an equal one are left out
    alone = (100 * sizes // percent == sizes) & (100 * (sizes - 1) < percent * (sizes + 1))
    live = firsts & ~alone & (sizes > 0)
    key = bucket_of(values, n).astype(np.uint64) << u64(32) | (values & u64(0xFFFFFFFF))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        often = frequent[at] == key
    else:
        often = np.zeros(len(key), bool)
    left = spare(sizes, percent)
    owner = np.repeat(np.arange(len(ends)), sizes)
    rare_before = np.concatenate(([0], np.cumsum(~often)))
    rank = rare_before[:-1] - rare_before[starts][owner]
    single = ~often & (rank < left[owner]) & live[owner]
    rare = rare_before[ends] - rare_before[starts]
    keys, mine = [], []
    for d in np.flatnonzero(live & (rare < left)):
        own = values[starts[d] : ends[d]][often[starts[d] : ends[d]]]
        band = int(np.searchsorted(cuts, sizes[d], side="right")) - 1
        for b in (band, band + 1):
            found = combinations(own, int(left[d] - rare[d]), max(1, int(spare(cuts[b], percent)) // 2), b)
            keys.append(found)
            mine.append(np.full(len(found), d))
    pairs = (np.concatenate(keys), np.concatenate(mine)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return (values[single], owner[single]), pairs, sizes


SINGLE, COMBINED, DOC = 0, 1, 2
KINDS = {SINGLE: (np.uint64, np.uint64, np.uint32), COMBINED: (np.uint64, np.uint64, np.uint32), DOC: (np.int64, np.uint8, np.uint32, np.uint64, f"V{SKETCH // 8}")}


def _signatures(docs: DataFrame, words: int, percent: int, n: int, frequent) -> DataFrame:
    """Packed signatures, dealt by token, and packed documents, dealt by id."""

    def deal(batches):
        known = frequent.value
        cuts = bands(percent, 1 << 40)
        held = {k: [] for k in KINDS}
        size = 0

        def flush():
            for kind, parts in held.items():
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts)]
                    bucket = bucket_of(columns[0] if kind == SINGLE else mix64(columns[1] if kind == COMBINED else columns[0].astype(np.uint64)), n)
                    out = pack(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), columns, n)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([kind] * out.num_rows, pa.int32())], names=["bucket", "blob", "kind"])
                    parts.clear()

        for batch, lo, hi, values, ends in _texts(batches, words):
            marks = set_marks(values, ends)
            singles, combined, sizes = _block_signatures(values, ends, marks, known, n, percent, cuts)
            for kind, (key, owner) in ((SINGLE, singles), (COMBINED, combined)):
                if len(key):
                    held[kind].append((key, marks[owner], sizes[owner].astype(np.uint32)))
            ids = batch.column(0)[lo:hi]
            held[DOC].append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), sizes.astype(np.uint32), marks, set_sketches(values, ends, SKETCH).view(f"V{SKETCH // 8}").ravel()))
            size += len(singles[0]) + len(combined[0])
            if size > 1 << 19:
                yield from flush()
                size = 0
        yield from flush()

    return dealt(docs.select("doc_id", "text").mapInArrow(tidied(deal), PACKED + ", kind int"), n)


PAIR = 3
PAIRS = (np.uint64, np.uint64)


def _meet(dealt_rows: DataFrame, percent: int) -> DataFrame:
    """Packed candidate pairs from single signatures; combined signatures and documents pass through."""

    def run(batches):
        blobs: dict[int, list[bytes]] = {k: [] for k in KINDS}
        bucket = 0
        for batch in batches:
            for b, blob, kind in zip(*(c.to_pylist() for c in batch.columns)):
                bucket = b
                if kind == SINGLE:
                    blobs[kind].append(blob)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary()), pa.array([kind], pa.int32())], names=["bucket", "blob", "kind"])
        if not blobs[SINGLE]:
            return
        key, mark, size = unpack(blobs.pop(SINGLE), KINDS[SINGLE])
        order = np.lexsort((mark, key))
        key, mark, size = key[order], mark[order], size[order].astype(np.int64)
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        key, mark, size = key[keep], mark[keep], size[keep]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.concatenate((at, [len(key)])))
        found = []
        for length in np.unique(runs[(runs > 1) & (runs <= 4 * RARE)]):
            begin = at[runs == length]
            for gap in range(1, length):
                a = (begin[:, None] + np.arange(length - gap)).ravel()
                ok = 100 * np.minimum(size[a], size[a + gap]) >= percent * np.maximum(size[a], size[a + gap])
                found.append((mark[a][ok], mark[a + gap][ok]))
        rows = [(PAIR, [np.concatenate(c) for c in zip(*found)])] if found else []
        long = np.repeat(runs > 4 * RARE, runs)  # tokens beyond the bound on frequent ones
        if long.any():
            rows.append((COMBINED, [key[long], mark[long], size[long].astype(np.uint32)]))
        for kind, columns in rows:
            if kind == PAIR:
                a, b = (f(*columns) for f in (np.minimum, np.maximum))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
                columns = [a[new], b[new]]
            out = pack(np.zeros(len(columns[0]), np.int64), columns, 1)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * out.num_rows, pa.int32()), out.column(1), pa.array([kind] * out.num_rows, pa.int32())], names=["bucket", "blob", "kind"])

    return dealt_rows.mapInArrow(tidied(run), PACKED + ", kind int")


def _unpacked(met: DataFrame, kind: int, kinds: tuple, schema: str, names: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                columns = unpack([blob], list(kinds))
                arrays = []
                for c in columns:
                    if c.dtype.kind == "V":
                        arrays.append(pa.array([x.tobytes() for x in c], pa.binary()))
                    else:
                        arrays.append(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return met.where(F.col("kind") == kind).select("blob").mapInArrow(tidied(run), schema)


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches don't rule a link out."""
    left = sets.select(F.col("mark").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("mark").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            apart = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
            # intersection <= (na + nb - apart) / 2, union >= (na + nb + apart) / 2
            ok = 100 * (na + nb - apart) >= percent * (na + nb + apart)
            yield batch.select([0, 1]).filter(pa.array(ok))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(tidied(run), "a long, b long")


def _whole_sets(marks: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(mark, tokens) of one document for each mark, from a second read of the documents."""
    needed = materialize(marks.join(sets.select("mark", "doc_id"), "mark"), "needed")
    read = marked(docs.select("doc_id", "text"), needed.select("doc_id")).where("__hit")

    def run(batches):
        for batch, lo, hi, values, ends in _texts(batches, words):
            marks = set_marks(values, ends)
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array([values[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], names=["mark", "tokens"])

    members = read.select("text").mapInArrow(tidied(run), "mark long, tokens binary").join(needed.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])
    return materialize(members, "members")


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs that link, by their whole sets."""

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(members.select(F.col("mark").alias("a"), F.col("tokens").alias("x")), "a").join(members.select(F.col("mark").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidied(check), "a long, b long")


def overlaps(sets: list[np.ndarray], own: int) -> np.ndarray:
    """Sizes of the intersections of the first `own` sets with all of them, by products over blocks of shared tokens."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    token = np.unique(token, return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((own, len(sets)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS):
        lo, hi = np.searchsorted(token, [at, at + TOKENS])
        block = np.zeros((len(sets), TOKENS), np.float32)
        block[owner[lo:hi], token[lo:hi] - at] = 1
        out += block[:own] @ block.T
    return out.astype(np.int64)


def _within_groups(combined: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links among the sets that share combined signatures, one for each but the first of a component in a cell.

    Groups are what such signatures connect. A group's sets meet in a cell of their size band, as its own sets or,
    from the next band, as guests; cells of more than CELL_SETS sets are split into parts, each two of which meet.
    """
    # a set is linked to the first of its part of a signature's sets, and that to the first of all
    part = combined.withColumn("salt", _salt())
    heads = part.groupBy("key", "salt").agg(F.min("mark").alias("head"))
    links = part.join(heads, ["key", "salt"]).select("mark", "head")
    tops = heads.groupBy("key").agg(F.min("head").alias("top"))
    links = links.unionByName(heads.join(tops, "key").select(F.col("head").alias("mark"), F.col("top").alias("head")))
    group = components(links, "mark", "head").withColumnRenamed("node", "mark").withColumnRenamed("component", "g")
    cuts = [int(x) for x in bands(percent, 1 << 40)]
    sized = combined.select("mark", "n").distinct().join(group, "mark")
    sized = materialize(sized.withColumn("band", F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col("n")))), "groups")
    own = sized.select("mark", "n", "g", "band", F.lit(0).alias("guest"))
    guest = sized.select("mark", "n", "g", (F.col("band") - 1).alias("band"), F.lit(1).alias("guest")).where("band > 0")
    seats = own.unionByName(guest).withColumn("cell", F.xxhash64("g", "band"))
    counts = seats.groupBy("cell").agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.min("guest").alias("owned")).where("c > 1 and owned = 0")
    parts = counts.select("cell", F.greatest(F.ceil(F.col("c") / CELL_SETS), F.ceil(F.col("t") / CELL_TOKENS)).cast("long").alias("parts"))
    placed = seats.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("mark"), F.col("parts")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("mark", "guest", F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    tokens = counts.join(parts, "cell").agg(F.sum(F.col("t") * F.col("parts"))).first()[0] or 0
    n = width(combined, growth=0, least=int(-(-8 * tokens // (32 << 20))))
    sent = placed.join(members, "mark").select(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(n)).cast("int").alias("bucket"), "cell", "guest", "mark", "tokens")

    def linked(rows):
        rows.sort(key=lambda r: r[0])  # own sets first
        own = sum(1 for r in rows if not r[0])
        if not own or len(rows) < 2:
            return None
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        shared = overlaps(sets, own)
        near = 100 * shared >= percent * (sizes[:own, None] + sizes[None, :] - shared)
        a, b = np.nonzero(near)
        a, b = a[a != b], b[a != b]
        if not len(a):
            return None
        mark = np.array([r[1] for r in rows], np.int64)
        root = roots(len(rows), a, b)
        moved = root != np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(mark[moved]), pa.array(mark[root[moved]])], names=["a", "b"])

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            for _, c, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    if rows and (found := linked(rows)):
                        yield found
                    cell, rows = c, []
                rows.append(row)
        if rows and (found := linked(rows)):
            yield found

    return dealt(sent, n).sortWithinPartitions("cell").mapInArrow(tidied(run), "a long, b long")


def ngram_components(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Join documents whose sets of word n-grams have a Jaccard similarity of percent / 100 or more.

    Returns (doc_id, n_shingles, component_id, mark), one row for each row of docs: component_id is the smallest
    doc_id that links lead to, itself included; mark is the same for equal sets. Letters A-Z count as a-z, words
    are runs of anything but space and tab to carriage return; fewer than `words` words are one n-gram; a text
    without words, or none, has no n-grams and links with nothing. Repeated rows and equal texts share a
    component; a null doc_id never is a component's id while another can be; an empty table gives no rows;
    other columns are not read.

    Exact: equal sets count once, candidates come from token-combination prefixes, and each is verified on
    whole sets. No list of partners is capped. What shares combined signatures (large groups of near copies) is
    verified cell by cell, where pairs are counted but never sent on.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    small_batches(spark)
    n = width(docs, growth=3.0)
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, words, n))
    met = materialize(_meet(_signatures(docs, words, percent, n, frequent), percent), "signatures", by="kind")
    rows = _unpacked(met, DOC, KINDS[DOC], "doc_id long, no_id long, n long, mark long, sketch binary", ["doc_id", "no_id", "n", "mark", "sketch"])
    rows = rows.withColumn("doc_id", F.when(F.col("no_id") == 0, F.col("doc_id")))
    sets = rows.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = materialize(sets, "sets")
    singles = _unpacked(met, PAIR, PAIRS, "a long, b long", ["a", "b"])
    combined = _unpacked(met, COMBINED, KINDS[COMBINED], "key long, mark long, n long", ["key", "mark", "n"]).distinct()
    combined = materialize(combined, "combined")
    tried = materialize(_plausible(_ordered(singles), sets, percent), "tried")
    several = combined.groupBy("key").count().where("count > 1").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    combined = materialize(combined.withColumn("salt", _salt()).join(several, ["key", "salt"], "left_semi").drop("salt"), "shared")
    needed = tried.select(F.col("a").alias("mark")).unionByName(tried.select(F.col("b").alias("mark"))).unionByName(combined.select("mark")).distinct()
    members = _whole_sets(needed, docs, sets, words)
    group = components(_verified(tried, members, percent).unionByName(_within_groups(combined, members, percent)))
    named = sets.select("mark", "doc_id").join(group.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "component").select("mark", "component_id")
    out = rows.join(of, "mark", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _salt():
    return F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")
