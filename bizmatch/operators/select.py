"""From scored pairs to each entity's matches: threshold, cap for each source, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Id prefixes of the two target sources, in the order of output (fixed values).
SOURCES = ("S2-", "S3-")


def source_of(cand: Column | str) -> Column:
    """0 or 1 for an id of the first or second target source, null for any other."""
    c = F.col(cand) if isinstance(cand, str) else cand
    return F.when(c.startswith(SOURCES[0]), 0).when(c.startswith(SOURCES[1]), 1)


def threshold_filter(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def ranked(scored: DataFrame) -> DataFrame:
    """Known-source pairs with their place `nth` in their entity's source, by score, ties by rank and id; each pair once, at its best."""
    best = scored.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    rows = best.withColumn("source", source_of("cand_id")).where("source is not null")
    order = Window.partitionBy("s1_id", "source").orderBy(F.desc("score"), "rank", "cand_id")
    return rows.withColumn("nth", F.row_number().over(order))


def capped(scored: DataFrame, threshold: float, max_s2: int = 5, max_s3: int = 6) -> DataFrame:
    """Pairs at or above the threshold, at most so many for each source."""
    rows = ranked(threshold_filter(scored, threshold))
    return rows.where(F.col("nth") <= F.when(F.col("source") == 0, max_s2).otherwise(max_s3))


def _lists(pairs: DataFrame, all_ids: DataFrame, order: list[Column]) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("cand_id")))), lambda x: x["cand_id"])
    lists = pairs.groupBy("s1_id").agg(F.array_join(ids, ",").alias("ids"))
    every = all_ids.select(F.col("entity_id").alias("s1_id"))
    return every.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def assemble_matches_per_source(scored: DataFrame, all_ids: DataFrame, threshold: float, max_s2: int = 5, max_s3: int = 6) -> DataFrame:
    """Every entity's list, first source first, each by score; '' where nothing survives."""
    return _lists(capped(scored, threshold, max_s2, max_s3), all_ids, [F.col("source"), F.col("nth")])


def apply_threshold_and_cap(scored: DataFrame, all_ids: DataFrame, threshold: float, max_s2: int = 5, max_s3: int = 6) -> DataFrame:
    """Every entity's list with both sources interleaved by score, ties by rank and id."""
    return _lists(capped(scored, threshold, max_s2, max_s3), all_ids, [(-F.col("score")).alias("by"), F.col("rank")])
