"""Macro F0.5 and what goes with it, over relations of truth and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import ranked

#: Cut points of the score distribution.
CUTS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def parse_truth(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, pairs) of truth lists: all s1_ids, and (s1_id, match_id).

    Lists are trimmed as a whole; '' and 'nan' are empty; ids are taken as they stand between commas. An entity
    that is listed twice counts with its last row, in the order of the optional column row_idx.
    """
    order = F.col("row_idx") if "row_idx" in truth.columns else F.lit(0)
    lists = truth.select(F.col("source1_entity_id").alias("s1_id"), F.trim(F.coalesce("matched_entity_ids", F.lit(""))).alias("ids"), order.alias("o"))
    lists = lists.groupBy("s1_id").agg(F.max_by("ids", "o").alias("ids"))
    some = lists.where((F.col("ids") != "") & (F.lower("ids") != "nan"))
    return lists.select("s1_id"), some.select("s1_id", F.explode(F.array_distinct(F.split("ids", ","))).alias("match_id"))


def pair_counts(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp) of every entity; predicted is (s1_id, cand_id), distinct."""
    t = truth.select("s1_id", F.col("match_id").alias("id"), F.lit(1).alias("t"))
    p = predicted.select("s1_id", F.col("cand_id").alias("id"), F.lit(1).alias("p"))
    both = t.join(p, ["s1_id", "id"], "full").groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("tp"))
    return entities.join(both, "s1_id", "left").fillna(0, ["n_true", "n_pred", "tp"])


def _measures(n_true: Column, n_pred: Column, tp: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_true > 0, tp / n_true).otherwise(F.lit(0.0))
    f = F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))
    return p, r, f


def macro_f05(counts: DataFrame) -> DataFrame:
    _, _, f = _measures(F.col("n_true"), F.col("n_pred"), F.col("tp"))
    return counts.agg(F.coalesce(F.avg(f), F.lit(0.0)).alias("macro_f05"))


def evaluate_detailed(counts: DataFrame) -> DataFrame:
    """One row of eleven measures; precision, recall and the last F0.5 are over entities with true matches."""
    p, r, f = _measures(F.col("n_true"), F.col("n_pred"), F.col("tp"))
    matched, single = F.col("n_true") > 0, F.col("n_true") == 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.agg(
        zero(F.avg(f)).alias("macro_f05"), zero(F.avg(F.when(matched, p))).alias("mean_precision"), zero(F.avg(F.when(matched, r))).alias("mean_recall"),
        F.coalesce(F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))), F.lit(1.0)).alias("singleton_accuracy"),
        F.count_if(single).alias("singleton_total"), F.count_if(single & (F.col("n_pred") == 0)).alias("singleton_correct"),
        zero(F.avg(F.when(matched, f))).alias("non_singleton_f05"), F.count("*").alias("total_entities"),
        F.count_if(F.col("n_pred") > 0).alias("entities_with_predictions"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("total_predicted_matches"),
        zero(F.avg("n_pred")).alias("avg_predictions_per_entity"),
    )


def threshold_sweep(scored: DataFrame, entities: DataFrame, truth: DataFrame, thresholds: list[float], max_s2: int = 5, max_s3: int = 6) -> DataFrame:
    """(threshold, macro_f05) of each threshold, in one pass over the pairs.

    Capping by falling score and cutting by a threshold commute, so pairs are ranked once. A pair counts at all
    thresholds up to its score: each entity's counts are summed for each threshold's place in the list, and
    entities without predictions there are made up for by the totals.
    """
    taus = sorted(set(float(t) for t in thresholds))
    spark = scored.sparkSession
    top = ranked(scored).where(F.col("nth") <= F.when(F.col("source") == 0, max_s2).otherwise(max_s3))
    top = top.join(entities, "s1_id", "left_semi").join(truth.select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left")
    sums = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("score") >= t).alias("n_pred"), F.count_if((F.col("score") >= t) & F.col("hit").isNotNull()).alias("tp")) for t in taus])
    per = top.groupBy("s1_id").agg(sums.alias("at")).select("s1_id", F.inline("at")).where("n_pred > 0")
    true = entities.join(truth.groupBy("s1_id").agg(F.countDistinct("match_id").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    _, _, f = _measures(F.col("n_true"), F.col("n_pred"), F.col("tp"))
    got = per.join(true, "s1_id").groupBy("threshold").agg(F.sum(f).alias("f"), F.count_if(F.col("n_true") == 0).alias("wrong"))
    totals = true.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("singles")).first()
    out = spark.createDataFrame([(t,) for t in taus], "threshold double").join(got, "threshold", "left")
    value = (F.coalesce("f", F.lit(0.0)) + totals["singles"] - F.coalesce("wrong", F.lit(0))) / totals["n"] if totals["n"] else F.lit(0.0)
    return out.select("threshold", value.alias("macro_f05"))


def optimize_threshold(scored: DataFrame, entities: DataFrame, truth: DataFrame, thresholds: list[float], max_s2: int = 5, max_s3: int = 6) -> tuple[float, float]:
    """The threshold with the highest macro F0.5, the lowest of equal ones; (0.5, -1) without thresholds."""
    if not thresholds:
        return 0.5, -1.0
    best = threshold_sweep(scored, entities, truth, thresholds, max_s2, max_s3).orderBy(F.desc("macro_f05"), "threshold").first()
    return best["threshold"], best["macro_f05"]


def _steps(lo: float, hi: float, step: float) -> list[float]:
    n = int(round((hi - lo) / step + 1e-9))
    return [round(lo + k * step, 10) for k in range(n + (lo + n * step < hi - 1e-9))]


def two_stage_threshold(scored: DataFrame, entities: DataFrame, truth: DataFrame, style: str = "pipeline", max_s2: int = 5, max_s3: int = 6) -> tuple[float, float]:
    """A coarse sweep, then a fine one around its best: in the pipeline's or the optimizer's grid."""
    coarse, below, above, lo, hi = ((0.50, 0.96, 0.02), 0.05, 0.06, 0.50, 0.96) if style == "pipeline" else ((0.40, 0.96, 0.04), 0.06, 0.07, 0.30, 0.98)
    scored = scored.cache()
    best, _ = optimize_threshold(scored, entities, truth, _steps(*coarse), max_s2, max_s3)
    found = optimize_threshold(scored, entities, truth, [round(t, 2) for t in _steps(max(lo, best - below), min(hi, best + above), 0.01)], max_s2, max_s3)
    scored.unpersist()
    return found


def score_distribution(scored: DataFrame) -> DataFrame:
    """Least, exact median, mean and largest score, and counts at or above the cut points."""
    return scored.agg(
        F.count("*").alias("n"), F.min("score").alias("min"), F.percentile("score", 0.5).alias("median"), F.avg("score").alias("mean"), F.max("score").alias("max"),
        *[F.count_if(F.col("score") >= c).alias(f"ge_{round(100 * c):03d}") for c in CUTS],
    )


def _match_sizes(results: DataFrame) -> DataFrame:
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    of = lambda prefix: F.size(F.filter(ids, lambda x: x.startswith(prefix)))
    return results.select(F.size(ids).alias("n"), of("S2-").alias("s2"), of("S3-").alias("s3"))


def result_summary(results: DataFrame) -> DataFrame:
    """One row: entities, singletons, matches, and means and largest counts for both sources."""
    m = _match_sizes(results)
    return m.agg(
        F.count("*").alias("total_entities"), F.count_if(F.col("n") == 0).alias("singletons"), F.count_if(F.col("n") > 0).alias("matched_entities"),
        F.sum("n").alias("total_matches"), F.avg("n").alias("avg_matches"), F.max("n").alias("max_matches"),
        F.count_if(F.col("s2") > 0).alias("with_s2"), F.avg("s2").alias("avg_s2"), F.max("s2").alias("max_s2"),
        F.count_if(F.col("s3") > 0).alias("with_s3"), F.avg("s3").alias("avg_s3"), F.max("s3").alias("max_s3"),
    )


def match_histogram(results: DataFrame) -> DataFrame:
    return _match_sizes(results).groupBy("n").agg(F.count("*").alias("entities"))
