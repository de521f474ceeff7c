"""Source records from tables that hold no businesses: deterministic, and the same in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (" Pvt Ltd", " LLC", " & Co., Inc.", " GmbH", " SARL", "")
COUNTRIES = ("US", "India", "France", "UK")


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def parts_as_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as businesses of three sources; 'Only1' holds the first source alone, 'Only23' targets alone."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    key = F.col("p_partkey")
    src = key % 3
    country = F.when(key % 50 == 7, F.when(src == 0, "Only1").otherwise("Only23")).otherwise(_pick(COUNTRIES, F.floor(key / 18) % 4))
    return p.select(
        F.concat(F.lit("S"), (src + 1).cast("string"), F.lit("-"), key.cast("string")).alias("entity_id"),
        F.concat("p_name", _pick(SUFFIXES, F.floor(key / 3) % 6)).alias("business_name"),
        F.concat((key % 997 + 100).cast("string"), F.lit(" "), F.coalesce("p_brand", F.lit("")), F.lit(" "), F.coalesce("p_type", F.lit("")), F.when(key % 2 == 0, " St").otherwise(" Road")).alias("business_address"),
        country.alias("country"), (src + 1).cast("int").alias("source"), key.alias("row_idx"),
    )


def docs_as_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as businesses of three sources: four words as name, all others as address, the language as country."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    words = F.split(F.regexp_replace("text", "\n", " "), " ")
    src = F.col("doc_id") % 3
    return d.select(
        F.concat(F.lit("S"), (src + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice(words, 1, 4), " ").alias("business_name"), F.array_join(F.slice(words, F.lit(5), F.size(words)), " ").alias("business_address"),
        F.col("lang").alias("country"), (src + 1).cast("int").alias("source"), F.col("doc_id").alias("row_idx"), F.md5("text").alias("mark"),
    )


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, text) of documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), "text")


def docs_truth(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, pairs): all records of the first source, and targets of equal text."""
    s1, t = docs.where("source = 1"), docs.where("source > 1")
    pairs = s1.select(F.col("entity_id").alias("s1_id"), "mark").join(t.select(F.col("entity_id").alias("match_id"), "mark"), "mark").select("s1_id", "match_id")
    return s1.select(F.col("entity_id").alias("s1_id")), pairs
