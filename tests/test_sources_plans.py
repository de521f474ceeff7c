"""Files, whole runs, command lines, the stream."""

import pytest
from pyspark.sql import functions as F

from bizmatch.plans.cli import parser
from bizmatch.plans.resolve import rescore, resolve, run_optimizer, run_pipeline, train
from bizmatch.schema import Config
from bizmatch.sources import files as I
from bizmatch.streaming.incremental import match_stream

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
S1 = ["S1-1\tAcme Foods Ltd\t12 Oak St 560001\tUS", "S1-2\tZen \"\"Tea\t1 Elm\tUS", "S1-3\tBlue Sky GmbH\t7 Pine Rd\tFR", "S1-4\tNA\t\tnull"]
S2 = ["S2-1\tAcme Foods Limited\t12 Oak Street 560001\tUS", "S2-2\tBlue Sky\t7 Pine Road\tUS"]
S3 = ["S3-1\tAcme Food\t12 Oak St\tUS", "S3-2\tBlue Sky Gmbh\t7 Pine Rd\tFR"]
TRUTH = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS3-2\nS1-4\tnan\n"


@pytest.fixture()
def data(tmp_path):
    for part in ("train", "test"):
        (tmp_path / part).mkdir()
        (tmp_path / part / f"{part}_source1.tsv").write_text(HEAD + "\n".join(S1).replace('""', "") + "\n", encoding="utf-8")
    for k, rows in ((2, S2), (3, S3)):
        (tmp_path / "train" / f"train_source{k}.tsv").write_text(HEAD + "\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "train" / "train_ground_truth.tsv").write_text(TRUTH)
    return tmp_path


def test_records(spark, data):
    rows = I.load_data(spark, f"{data}/train/train_source1.tsv").orderBy("row_idx").collect()
    assert [r["entity_id"] for r in rows] == ["S1-1", "S1-2", "S1-3", "S1-4"]
    assert (rows[3]["business_name"], rows[3]["business_address"], rows[3]["country"]) == ("NA", "", "null")
    s1, t = I.load_sources(spark, str(data), is_train=False, subset=2)
    assert [r["entity_id"] for r in s1.orderBy("row_idx").collect()] == ["S1-1", "S1-2"]
    assert [r["entity_id"] for r in t.orderBy("row_idx").collect()] == ["S2-1", "S2-2", "S3-1", "S3-2"]  # fell back to the training targets
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.load_sources(spark, str(data), is_train=False, fall_back=False)
    assert I.load_candidates(spark, f"{data}/none.tsv", s1) is None


def test_round_trip(spark, tmp_path):
    rows = [("S1-1", "a\tb", 'q"q', ""), ("S1-2", "", "NA", "x, y"), ("S1-3", "é’", "null", " sp ")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    I.write_tsv(df, str(tmp_path / "x"))
    got = sorted(tuple(r)[:3] for r in I.load_data(spark, str(tmp_path / "x")).collect())
    assert got == [r[:3] for r in rows]


def test_resolve_and_rescore(spark, data):
    s1, t = I.load_sources(spark, str(data), True)
    got = {r["source1_entity_id"]: r["matched_entity_ids"] for r in resolve(s1, t, config=Config(threshold=0.6)).collect()}
    assert got == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": "S3-2", "S1-4": ""}
    lists = spark.createDataFrame([("S1-1", "S3-1,S2-1,S2-404")], "source1_entity_id string, candidate_entity_ids string")
    got = {r["source1_entity_id"]: r["matched_entity_ids"] for r in rescore(s1, t, lists).collect()}
    assert got == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": "", "S1-4": ""}


def test_commands(spark, data):
    base = ["--data_dir", str(data), "--model_path", str(data / "model"), "--is_train", "--validate"]
    defaults = parser().parse_args(["pipeline", "--data_dir", "d"])
    assert (defaults.threshold, defaults.top_k, defaults.max_s2, defaults.max_s3, defaults.subset) == (0.80, 30, 5, 6, 0)
    assert parser().parse_args(["optimize", "--data_dir", "d"]).threshold == 0.62
    (data / "train" / "train_ground_truth.tsv").rename(data / "truth")
    args = parser().parse_args(["pipeline", *base[:-1], "--candidate_out", str(data / "cand"), "--matching_out", str(data / "match"), "--threshold", "0.6"])
    assert run_pipeline(spark, args).first()["processed"] == 4  # no truth: the formula
    (data / "truth").rename(data / "train" / "train_ground_truth.tsv")
    assert {r["source1_entity_id"] for r in I.load_data(spark, str(data / "match"), I.TRUTH).collect()} == {"S1-1", "S1-2", "S1-3", "S1-4"}
    s1, _ = I.load_sources(spark, str(data), True)
    assert I.load_candidates(spark, str(data / "cand"), s1).count() == 4
    from bizmatch.operators.scoring import MatchModel
    from bizmatch.operators.evaluate import parse_truth

    s1, t = I.load_sources(spark, str(data), True)
    model = train(s1, t, parse_truth(I.load_truth(spark, f"{data}/train/train_ground_truth.tsv"))[1], max_iter=2, validate=False)
    assert isinstance(model, MatchModel) and model.model is not None
    model.save(str(data / "model"))
    args = parser().parse_args(["optimize", *base, "--candidates", str(data / "cand"), "--output", str(data / "opt")])
    assert run_optimizer(spark, args).first()["processed"] == 4


def test_stream(spark, data, tmp_path):
    s1, t = I.load_sources(spark, str(data), True)
    s1.drop("row_idx").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.drop("row_idx").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    match_stream(stream, t, str(tmp_path / "out"), str(tmp_path / "cp"), config=Config(threshold=0.6)).awaitTermination(120)
    got = {r["source1_entity_id"]: r["matched_entity_ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": "S3-2", "S1-4": ""}


def test_last_rows(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 3, 1)], "k string, v int, row_idx long")
    assert sorted((r["k"], r["v"]) for r in I.last_row_of(df, "k").collect()) == [("a", 2), ("b", 3)]
    assert I.run_summary(spark.createDataFrame([("1", "x"), ("2", "")], "source1_entity_id string, matched_entity_ids string")).select(F.col("matched_percent")).first()[0] == 50
