"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .ann import nearest_neighbours
from .binary import read_records, records_dir, write_records
from .licenses import scan_licenses
from .mixing import mixing_probabilities
from .ngram_join import ngram_components
from .oracles import license_scan_sql, ngram_components_sql, vector_duplicates_sql
from .quality import score_quality
from .sharding import assign_shards
from .toxicity import score_toxicity
from .vecdedup import vector_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), n_shards=40)


def op4_quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", by=5, held=0, threshold=0.3)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a tree: a folder for each source, and in it for each language."""
    return scan_licenses(_table(spark, sf_dir, "documents"), path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", by=3, held=1, threshold=0.7)


def op7_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing_probabilities(_table(spark, sf_dir, "documents"), temper=0.7, keep=0.5)
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_sampled").alias("sampled"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = records_dir(spark)
    manifest = write_records(_table(spark, sf_dir, "documents"), uri, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_records(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_jump_shards": op3_jump_shards,
    "op4_quality_features": op4_quality_features,
    "op5_license_scan": op5_license_scan,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_pq_dedup": op7_pq_dedup,
    "op8_raked_mix": op8_raked_mix,
    "op9_token_records": op9_token_records,
    "op10_bpe_automaton": op10_bpe_automaton,
}

#: Ops 1, 3, 4, 6, 8, 9 and 10 search by approximation, draw on models or tokenizers, or need crc32: they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": ngram_components_sql(4, 85),
    "op5_license_scan": license_scan_sql("source || '/' || lang || '/' || doc_id"),
    "op7_pq_dedup": vector_duplicates_sql(0.98),
}
