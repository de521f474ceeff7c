"""Candidates against a plain model of the index."""

import random
from collections import Counter

from pyspark.sql import functions as F

from bizmatch.functions.keys import blocking_keys
from bizmatch.functions.text import prepare_records
from bizmatch.operators import blocking as B


def records(seed, n, source):
    rng = random.Random(seed)
    words = ["acme", "red", "foods", "blue", "sky", "motors", "apex", "st", "inc", "zen"]
    return [
        (f"{source}-{k}", " ".join(rng.choices(words, k=rng.randrange(1, 4))), f"{rng.randrange(1, 30)} {rng.choice(['wayne', 'main', 'oak'])} road {rng.choice([1234, 5678, 1234])} {rng.choice(['', '1234'])}", rng.choice(["US", "India", ""]), k)
        for k in range(n)
    ]


SCHEMA = "entity_id string, business_name string, business_address string, country string, row_idx long"


def model(spark, s1, targets, top_k, block):
    """Postings in dictionaries, counted one query at a time."""
    keyed = {}
    for name, rows in (("q", s1), ("t", targets)):
        df = prepare_records(spark.createDataFrame(rows, SCHEMA)).select("entity_id", "country_clean", "row_idx", blocking_keys("name_clean", "addr_clean", "numbers").alias("k"))
        keyed[name] = sorted((r["row_idx"], r["entity_id"], r["country_clean"], r["k"]) for r in df.collect())
    index = {}
    for row, i, c, keys in keyed["t"]:
        for k in keys:
            index.setdefault((c, k), []).append((row, i))
    index = {k: v for k, v in index.items() if len(v) <= block}
    out = {}
    for _, q, c, keys in keyed["q"]:
        hits = Counter()
        for k in keys:
            for t in index.get((c, k), []):
                hits[t] += 1
        found = list(hits)
        if len(found) > top_k:
            found = sorted(found, key=lambda t: -hits[t])[:top_k]  # stable: ties stay in the order of discovery
        out[q] = [(i, hits[row, i]) for row, i in found]
    return out


def test_candidates_match_the_model(spark):
    for seed, top_k, block in ((1, 5, 1000), (2, 3, 25), (3, 30, 12), (4, 200, 1000)):
        s1, targets = records(seed, 60, "S1"), records(seed + 50, 120, "S2")
        want = model(spark, s1, targets, top_k, block)
        q, t = prepare_records(spark.createDataFrame(s1, SCHEMA)), prepare_records(spark.createDataFrame(targets, SCHEMA))
        got = {i: [] for i in want}
        found = B.candidates(q, t, top_k, block)
        for r in found.orderBy("q_row", "rank").collect():
            got[r["q_id"]].append((r["t_id"], r["overlap"]))
        assert got == want
        lists = {r["source1_entity_id"]: r["candidate_entity_ids"] for r in B.candidate_lists(q, found).collect()}
        assert lists == {i: ",".join(x for x, _ in v) for i, v in want.items()}
        index = B.BlockingIndex(block, top_k).build(t)
        assert index.query_candidates(q).count() == found.count()


def test_hot_keys_and_multiplicity(spark):
    rows = [("S2-1", "abc", "", "US", 1), ("S2-2", "abc", "", "US", 2), ("S2-3", "abc", "", "US", 3), ("S2-4", "abc", "", "FR", 4)]
    t = prepare_records(spark.createDataFrame(rows, SCHEMA))
    p = B.postings(t)
    left = B.prune_hot_keys(p, 2)
    assert {r["entity_id"] for r in left.collect()} == {"S2-4"} and B.prune_hot_keys(p, 3).count() == p.count()
    twice = [("S1-1", "", "1234 oak 1234", "US", 1)], [("S2-1", "", "elm 1234 1234", "US", 1)]
    q, t = (prepare_records(spark.createDataFrame(r, SCHEMA)) for r in twice)
    pairs = B.pair_overlap(B.postings(q), B.postings(t)).collect()
    assert [r["overlap"] for r in pairs] == [4 + 3]  # num: twice on both sides; three keys of the address
    assert B.candidates(q.where("false"), t).count() == 0


def test_countries_never_mix(spark):
    q = prepare_records(spark.createDataFrame([("S1-1", "acme", "", "US", 1), ("S1-2", "acme", "", "", 2), ("S1-3", "acme", "", None, 3)], SCHEMA))
    t = prepare_records(spark.createDataFrame([("S2-1", "acme", "", "IN", 1), ("S2-2", "acme", "", " ", 2)], SCHEMA))
    got = sorted((r["q_id"], r["t_id"]) for r in B.candidates(q, t).collect())
    assert got == [("S1-2", "S2-2"), ("S1-3", "S2-2")]
    lists = B.generate_candidates(q.select("entity_id", "business_name", "business_address", "country", "row_idx"), t.select("entity_id", "business_name", "business_address", "country", "row_idx"))
    assert lists.where(F.col("candidate_entity_ids") == "").count() == 1


def test_candidates_need_no_table_of_pairs(spark, monkeypatch):
    """Copies on both sides, several blocks and parts: each query's best are those of the relation of all pairs, which is not made."""
    from bizmatch.operators import best_pairs as C

    s1 = [(f"S1-{k}", *r[1:4], k) for k, r in enumerate(records(11, 40, "S1") * 3)]
    s2 = [(f"S2-{k}", *r[1:4], 1000 - k) for k, r in enumerate(records(12, 90, "S2") * 4)]
    q, t = prepare_records(spark.createDataFrame(s1, SCHEMA)), prepare_records(spark.createDataFrame(s2, SCHEMA))
    pairs = {}
    for r in B.pair_overlap(B.postings(q), B.prune_hot_keys(B.postings(t), 150)).collect():
        pairs.setdefault(r["q_id"], []).append((-r["overlap"], r["first_pos"], r["t_row"], r["t_id"]))
    want = {}
    for i, found in pairs.items():
        best = sorted(found)[:7]
        best = best if len(found) > 7 else sorted(best, key=lambda x: x[1:])
        want[i] = [(x[3], -x[0], x[1], k + 1) for k, x in enumerate(best)]
    monkeypatch.setattr(B, "pair_overlap", None)
    monkeypatch.setattr(C, "TARGET_CLASSES", 9)
    monkeypatch.setattr(C, "QUERY_CLASSES", 5)
    got = {}
    for r in B.candidates(q, t, 7, 150).orderBy("rank").collect():
        got.setdefault(r["q_id"], []).append((r["t_id"], r["overlap"], r["first_pos"], r["rank"]))
    assert got == want
    crowd = C.target_classes(B.record_keys(t), 3)
    assert crowd.where("size(rows) > 3").count() == 0 and crowd.where("size(rows) = 3").count() > 0
