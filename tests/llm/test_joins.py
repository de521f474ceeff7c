"""N-gram join, vector operators, components, id filter."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizmatch.llm import ann, ngram_join, vecdedup
from bizmatch.llm.ann import nearest_neighbours
from bizmatch.llm.common import components, without_ids
from bizmatch.llm.ngram_join import ngram_components
from bizmatch.llm.shingles import shingle_sets
from bizmatch.llm.vecdedup import vector_duplicates


def groups(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def sets_of(rows, k):
    out = {}
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[d] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def brute(rows, k, percent):
    sets, links = sets_of(rows, k), []
    where = {}
    for d, s in sets.items():
        for t in s:
            where.setdefault(t, []).append(d)
    for a, s in sets.items():
        for b, n in Counter(b for t in s for b in where[t] if b > a).items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                links.append((a, b))
    group = groups(sets, links)
    return {d: (len(s), group[d]) for d, s in sets.items()}


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(250)]
    base, passage, rows = [rng.choice(words) for _ in range(90)], [rng.choice(words) for _ in range(60)], []
    for i in range(n):
        r = rng.random()
        if r < 0.35:
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif r < 0.5:
            t = passage + [rng.choice(words) for _ in range(rng.choice([1, 3, 8, 20]))]
        elif r < 0.6 and rows:
            t = (rng.choice(rows)[1] or "x").split(" ")
            t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 30, 150]))]
        rows.append((i * 3 + 1, " ".join(t)))
    rng.shuffle(rows)
    return rows + [(90001, None), (90002, ""), (90003, " \n "), (90004, "A b C"), (90005, "a B\tc"), (90006, "é É à"), (90007, "long " * 20000), (90008, "z" * 9000)]


@pytest.mark.parametrize("rare,most,cell", [(16, 1 << 20, 512), (2, 1 << 20, 16), (2, 8, 512)])
def test_ngram_join(spark, monkeypatch, rare, most, cell):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", most)
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    rows = corpus(rare)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("n", F.lit(None).cast("int")).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()}
    assert got == brute(rows, 4, 85)


def test_ngram_join_other_parameters(spark):
    rows = corpus(9, 200)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)


def test_ngram_join_repeats_nulls_and_nothing(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, None)]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", 2), ("5", 2), ("5", 2), ("7", 7), ("8", 8), ("None", 2)]
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_over_spans():
    text = " ".join(f"t{i}" for i in range(200_000)) + " " + "q" * 700_000 + " end of it all"
    values, ends = shingle_sets([text, "a b c d", text], 4)
    assert ends[0] == 200_002 and ends[1] == ends[0] + 1
    assert (values[: ends[0]] == values[ends[1] :]).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    nodes = {x for e in links if e[0] != e[1] for x in e}
    want = groups(nodes, [e for e in links if e[0] != e[1]])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_ids(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(300)] + [(None, "null")], "doc_id long, text string")
    drop = spark.createDataFrame([(k,) for k in range(0, 300, 7)] + [(9999,)], "doc_id long")
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in without_ids(rows, drop).collect())
    assert [d for _, d in got] == [k for k in range(300) if k % 7] + [None]


def vectors(seed, n=700, d=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, d))  # one large group
    x[n // 3 : n // 2] = x[rng.integers(n // 2, n, n // 2 - n // 3)] + 0.06 * rng.standard_normal((n // 2 - n // 3, d))
    x[-5:] = x[-10:-5]
    x = x.astype(np.float32)
    rows = [(int(k), [float(v) for v in x[k]], int(k % 3) if k >= n // 3 else 1) for k in rng.permutation(n)]
    return rows + [(10_000, None, 1), (10_100, [0.0] * d, 1), (10_200, [], 1), (10_300, [None] + [1.0] * (d - 1), 1), (10_400, [float("nan")] * d, 2), (10_500, [float("inf")] * d, 2), (10_600, rows_first(x), None), (10_700, [1.0, 2.0], 1)]


def rows_first(x):
    return [float(v) for v in x[0]]


def fine(rows, d=24):
    return [r for r in rows if r[1] and len(r[1]) == d and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("row", F.lit("x")).withColumn("rank", F.lit(0))


def clusters(seed, n=3000, d=24):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((30, d))[rng.integers(0, 30, n)] * 4 + rng.standard_normal((n, d))).astype(np.float32)
    return [(k, [float(v) for v in x[k]], 1) for k in range(n)] + [(None, [1.0] * d, 1), (None, None, None)]


def test_probes_of_clusters_are_few():
    x = np.array([r[1] for r in clusters(5) if r[0] is not None])
    centres = ann.k_means(x, 55)
    assert ann.probes_measured(x, centres, 10) < 20 < ann.probes_measured(np.random.default_rng(1).standard_normal((3000, 64)), np.random.default_rng(2).standard_normal((55, 64)), 10)


@pytest.mark.parametrize("make", [vectors, clusters])
def test_nearest_neighbours(spark, make):
    rows = [r for r in make(1) if make is clusters or r[0] is not None] + [(None, [0.5] * 24, 1)]
    ok = [r for r in fine(rows) if r[0] is not None]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok])
    got = {}
    for r in nearest_neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    assert set(got) == {int(i) for i in ids if i % 10 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        others = ids != q
        order = np.lexsort((ids[others], d[others]))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        for _, v, s in found:
            assert s == pytest.approx(d[ids == v][0], abs=1e-12)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len(set(ids[others][order]) & {v for _, v, _ in found})
        total += 10
    assert hit / total >= 0.95


def test_nearest_neighbours_few_and_none(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIRST", 1)
    rows = [(None, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [5.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(frame(spark, rows), F.col("vec_id") == 100, k=10).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, pytest.approx(2**0.5))]
    assert nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_nearest_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 64))
    rows = [(100, [float(v) for v in x[0]], 1)] + [(k, [float(v) for v in x[0] + (0.3 + 0.05 * k) * x[k]], 1) for k in range(1, 40)]
    rows += [(500, [float(v) for v in x[0] + 1e-3 * rng.standard_normal(64)], 1) for _ in range(90)]
    got = [r["vec_id"] for r in nearest_neighbours(frame(spark, rows), F.col("vec_id") == 100, k=10).orderBy("rank").collect()]
    best = {}
    for i, v, _ in rows[1:]:
        best[i] = min(best.get(i, np.inf), float(((np.float32(v) - np.float32(x[0])) ** 2).sum()))
    assert got == sorted(best, key=best.get)[:10] and got[0] == 500


@pytest.mark.parametrize("least", [256, 20])
def test_vector_duplicates(spark, monkeypatch, least):
    monkeypatch.setattr(vecdedup, "CELL_LEAST", least)
    monkeypatch.setattr(vecdedup, "CELL_MOST", least)
    rows = vectors(2)
    ok = [r for r in fine(rows) if r[2] is not None]
    ids, x, label = np.array([r[0] for r in ok]), np.array([r[1] for r in ok]), np.array([r[2] for r in ok])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    group = groups([int(i) for i in ids], [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near))])
    want = {r[0]: (0, r[0], True) for r in rows} | {int(i): (int(near[k].sum()), group[int(i)], group[int(i)] == int(i)) for k, i in enumerate(ids)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_duplicates(frame(spark, rows)).collect()} == want


def test_links_of_many_equal_vectors(spark):
    """Equal vectors are collapsed: a task never holds all of them, and counts are as if it did."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3, 8))
    near = x[0] + 0.01 * rng.standard_normal(8)
    rows = [(k, [float(v) for v in x[0]], 1) for k in range(5, 30_005)] + [(2, [float(v) for v in near], 1), (3, [float(v) for v in x[1]], 1), (4, [float(v) for v in x[0]], 2)]
    got = Counter((r["n_links"], r["component_id"], r["kept"]) for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == {(30_000, 2, False): 30_000, (30_000, 2, True): 1, (0, 3, True): 1, (0, 4, True): 1}


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles(monkeypatch, tile):
    monkeypatch.setattr(vecdedup, "TILE", tile)
    rng = np.random.default_rng(tile)
    y, z = rng.standard_normal((20, 3)), rng.standard_normal((11, 3))
    for a, b in ((y, None), (y, z)):
        got = {(int(i), int(j)) for x in vecdedup.links_of(a, b, 0.5) for i, j in zip(*x)}
        assert got == {(i, j) for i in range(20) for j in range(20 if b is None else 11) if (i < j or b is not None) and a[i] @ (a if b is None else b)[j] >= 0.5}


def test_vector_duplicates_repeats_and_none(spark):
    rows = [(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (3, [2.0, 4.0], 1), (9, [1.0, 2.0], 2), (None, [1.0, 2.0], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vector_duplicates(frame(spark, rows)).collect())
    assert got == [("3", 3, 3), ("4", 3, 3), ("4", 3, 3), ("9", 0, 9), ("None", 3, 3)]
    assert vector_duplicates(frame(spark, [])).count() == 0
