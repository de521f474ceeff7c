"""Selection, evaluation, training pairs, the classifier."""

import random

import pytest
from pyspark.sql import functions as F

from bizmatch.functions.text import prepare_records
from bizmatch.operators import evaluate as E
from bizmatch.operators import select as S
from bizmatch.operators import training as R
from bizmatch.operators.scoring import MatchModel
from bizmatch.schema import FEATURES

SCORES = [("S2-a", 0.9), ("S3-x", 0.85), ("S2-b", 0.8), ("S2-c", 0.7), ("S3-y", 0.65), ("S2-d", 0.5), ("S9-z", 0.99)]


def scored(spark, rows):
    return spark.createDataFrame([(s, c, x, k) for k, (s, c, x) in enumerate(rows)], "s1_id string, cand_id string, score double, rank int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


def test_lists(spark):
    df = scored(spark, [("S1-1", c, x) for c, x in SCORES] + [("S1-1", "S2-a", 0.3), ("S1-3", "S9-z", 0.99), ("S1-4", "S2-a", 0.6)])
    every = ids(spark, "S1-1", "S1-2", "S1-3", "S1-4")
    get = lambda out: {r["source1_entity_id"]: r["matched_entity_ids"] for r in out.collect()}
    assert get(S.assemble_matches_per_source(df, every, 0.6, 2, 1)) == {"S1-1": "S2-a,S2-b,S3-x", "S1-2": "", "S1-3": "", "S1-4": "S2-a"}
    assert get(S.apply_threshold_and_cap(df, every, 0.6, 2, 1)) == {"S1-1": "S2-a,S3-x,S2-b", "S1-2": "", "S1-3": "", "S1-4": "S2-a"}
    assert get(S.assemble_matches_per_source(df.limit(0), every, 0.6)) == {f"S1-{k}": "" for k in (1, 2, 3, 4)}
    assert S.threshold_filter(df, 0.6).count() == 8


def test_ties_follow_rank(spark):
    df = scored(spark, [("S1-1", f"S2-{k}", 0.8) for k in (5, 3, 9, 1)])
    assert S.assemble_matches_per_source(df, ids(spark, "S1-1"), 0.5, 3).first()["matched_entity_ids"] == "S2-5,S2-3,S2-9"


CASES = [({"A", "B"}, {"A", "C"}, 0.5), ({"A", "B"}, {"A"}, 0.833333), ({"A", "B"}, {"A", "B", "C"}, 0.714286), (set(), set(), 1), (set(), {"A"}, 0), ({"A"}, set(), 0)]


def relations(spark, cases):
    entities = spark.createDataFrame([(f"S1-{k}",) for k in range(len(cases))], "s1_id string")
    truth = spark.createDataFrame([(f"S1-{k}", x) for k, c in enumerate(cases) for x in c[0]], "s1_id string, match_id string")
    pred = spark.createDataFrame([(f"S1-{k}", x) for k, c in enumerate(cases) for x in c[1]], "s1_id string, cand_id string")
    return entities, truth, pred


def test_measures(spark):
    for case in CASES:
        assert E.macro_f05(E.pair_counts(*relations(spark, [case]))).first()[0] == pytest.approx(case[2], abs=1e-6)
    got = E.evaluate_detailed(E.pair_counts(*relations(spark, CASES))).first().asDict()
    want = {"macro_f05": 0.507937, "singleton_accuracy": 0.5, "mean_precision": 0.541667, "mean_recall": 0.5, "non_singleton_f05": 0.511905, "singleton_total": 2, "singleton_correct": 1, "total_entities": 6, "entities_with_predictions": 4, "total_predicted_matches": 7}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    none = E.evaluate_detailed(E.pair_counts(*[x.limit(0) for x in relations(spark, CASES)])).first()
    assert none["macro_f05"] == 0 and none["singleton_accuracy"] == 1


def test_sweep_is_the_loop(spark):
    rng = random.Random(5)
    rows = [(f"S1-{a}", f"S{rng.choice([2, 3])}-{b}", round(rng.random(), 3)) for a in range(25) for b in range(12)]
    df = scored(spark, rows)
    entities = spark.createDataFrame([(f"S1-{k}",) for k in range(28)], "s1_id string")
    truth = spark.createDataFrame([(a, c) for a, c, x in rows if rng.random() < 0.1 + 0.4 * x and a != "S1-3"], "s1_id string, match_id string")
    taus = [0.1, 0.35, 0.5, 0.77, 0.999, 1.5]
    got = {r["threshold"]: r["macro_f05"] for r in E.threshold_sweep(df, entities, truth, taus, 2, 3).collect()}
    for t in taus:
        pred = S.capped(df, t, 2, 3).select("s1_id", "cand_id")
        assert got[t] == pytest.approx(E.macro_f05(E.pair_counts(entities, truth, pred)).first()[0])
    best, f = E.optimize_threshold(df, entities, truth, taus, 2, 3)
    assert f == max(got.values()) and best == min(t for t in taus if got[t] == f)
    assert E.optimize_threshold(df, entities, truth, []) == (0.5, -1.0)
    for style in ("pipeline", "optimizer"):
        t, f = E.two_stage_threshold(df, entities, truth, style, 2, 3)
        assert 0.3 <= t < 0.98 and 0 <= f <= 1


def test_truth_lists(spark):
    rows = [("a", " S2-1,S2-2 ", 0), ("b", "nan", 1), ("c", "", 2), ("d", None, 3), ("a", "S2-3, S2-4", 4)]
    entities, pairs = E.parse_truth(spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string, row_idx int"))
    assert sorted(r[0] for r in entities.collect()) == ["a", "b", "c", "d"]
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", " S2-4"), ("a", "S2-3")]  # the last row wins, ids as they stand


def test_summaries(spark):
    res = spark.createDataFrame([("1", "S2-a,S3-b"), ("2", ""), ("3", "S3-c")], "source1_entity_id string, matched_entity_ids string")
    r = E.result_summary(res).first()
    assert (r["total_entities"], r["singletons"], r["total_matches"], r["max_matches"], r["with_s2"], r["with_s3"]) == (3, 1, 3, 2, 1, 2)
    assert {x["n"]: x["entities"] for x in E.match_histogram(res).collect()} == {0: 1, 1: 1, 2: 1}
    d = E.score_distribution(scored(spark, [("a", "b", x) for x in (0.1, 0.5, 0.9, 0.95)])).first()
    assert d["median"] == pytest.approx(0.7) and d["ge_050"] == 3 and d["min"] == 0.1


def world(spark):
    rng = random.Random(8)
    words = ["acme", "apex", "blue", "crown", "delta", "ember", "fjord", "gamma"]
    s1, s2, truth = [], [], []
    for k in range(60):
        name, addr, c = " ".join(rng.sample(words, 3)), f"{rng.randrange(1, 99)} oak road {10000 + k}", rng.choice(["US", "IN"])
        s1.append((f"S1-{k}", name + " Ltd", addr, c, k))
        s2.append((f"S{2 + k % 2}-{k}", name + " Pvt", addr.replace("road", "rd"), c, k))
        truth.append((f"S1-{k}", f"S{2 + k % 2}-{k}"))
    schema = "entity_id string, business_name string, business_address string, country string, row_idx long"
    return spark.createDataFrame(s1, schema), spark.createDataFrame(s2, schema), spark.createDataFrame(truth, "s1_id string, match_id string")


def test_training_pairs(spark):
    s1, t, truth = world(spark)
    q, p = prepare_records(s1), prepare_records(t)
    assert R.positives(truth, q, p, 10).count() == 10
    good = R.positives(truth, q, p)
    assert R.positives(truth, q, p.limit(0)).count() == 0
    far = R.negatives(good, q, p, 5)
    assert far.count() == 300 and sorted(map(tuple, far.collect())) == sorted(map(tuple, R.negatives(good, q, p, 5).collect()))
    near = R.negatives(good, q, p, 5, same_country=True, exclude=good)
    where = {r["entity_id"]: r["country_clean"] for df in (q, p) for r in df.collect()}
    assert near.count() and all(where[a] == where[b] for a, b in map(tuple, near.collect()))
    assert near.join(good, ["s1_id", "cand_id"]).count() == 0 and near.groupBy("s1_id", "cand_id").count().where("count > 1").count() == 0
    pairs = R.training_pairs(truth, q, p)
    fit, check = R.split_by_entity(pairs)
    assert fit.count() + check.count() == pairs.count() and fit.select("s1_id").intersect(check.select("s1_id")).count() == 0


def test_classifier(spark, tmp_path):
    rng = random.Random(1)
    rows = [tuple([100.0 * (y if f.endswith("r") else rng.random()) for f in FEATURES] + [y]) for y in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    model = MatchModel().fit(df.where("rand(3) < 0.8"), df, max_iter=3)
    out = model.score(df)
    assert out.where("label = 1").agg(F.avg("score")).first()[0] > 0.6 > 0.4 > out.where("label = 0").agg(F.avg("score")).first()[0]
    path = str(tmp_path / "model")
    model.save(path)
    again = MatchModel()
    assert again.load(spark, path) and again.columns == list(FEATURES)
    assert again.score(df).agg(F.sum("score")).first()[0] == pytest.approx(out.agg(F.sum("score")).first()[0])
    assert not MatchModel().load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        MatchModel().save(path)
