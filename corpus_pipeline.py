"""A pipeline over the corpus: quality, toxicity, near copies, mixing, tokens.

Each stage reads all that its predecessor kept; what it decides takes effect in the rows that it returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmatch.llm.bpe import bpe_round_trip
from bizmatch.llm.common import materialize, without_ids
from bizmatch.llm.mixing import mixing_probabilities
from bizmatch.llm.ngram_join import ngram_components
from bizmatch.llm.quality import quality_of
from bizmatch.llm.toxicity import toxicity_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more.

    The score is that of the whole text alone, so that repeated rows share their fate; a null text counts as an
    empty one, and empty texts go or stay by their score. Null ids, other columns and an empty table pass as they are.
    """
    return docs.where(quality_of(docs, _labels(spark, sf_dir))("text") >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7.

    The score is that of the whole text alone, so that repeated rows share their fate; a null or empty text has the
    score of no evidence. Null ids, other columns and an empty table pass as they are.
    """
    return docs.where(toxicity_of(docs, _labels(spark, sf_dir))("text") < 0.7)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-grams, Jaccard 0.8): that with the least id.

    Rows are told apart by a key of their own, so ids may repeat or be null: of rows that share the least id, and
    of equal rows, one stays; a row with a null id stays only where its group has no other. A row that belongs to
    no group stays whatever its id. Texts without words, null ones too, are copies of nothing and all stay. Other
    columns, of whatever name, and an empty table pass as they are.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    groups = ngram_components(keyed, words=5, percent=80, doc_id="__row").where("n_shingles > 0")
    members = groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    members = materialize(members.join(keyed.select("__row", "doc_id"), "__row"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row")))
    kept = members.groupBy("__group").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    copies = materialize(members.select("__row").join(kept, "__row", "left_anti"), "copies")
    return without_ids(keyed, copies, "__row").drop("__row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens, with the shares of sources, languages and topics evened out a little.

    The draw depends on the id alone, so rows that repeat an id and a cell of source, language and topic share
    their fate; nulls of a dimension are a value of their own, as is a null id. Texts without tokens are drawn with
    their cell's probability. Other columns keep their values, whatever their names; an empty table passes as it is.
    """
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns) if c.lower().startswith("mix_")}
    drawn = mixing_probabilities(docs.withColumnsRenamed(own), temper=0.9, keep=0.9).where("mix_sampled")
    return drawn.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit integers), and the hash of what they decode to.

    One row for each row: a null text counts as empty and has no ids; ids, null and repeated ones too, pass as they
    are; other columns are not read; an empty table gives no rows.
    """
    both = bpe_round_trip(docs, TOKENIZER)
    return both.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_copies", one_of_each_group), ("mixing", mixed), ("tokens", tokens)]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
