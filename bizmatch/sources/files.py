"""Tab-separated records, truth, candidate lists and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CANDIDATES, RECORD, TRUTH


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_data(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """All columns as text; an empty field is '' and 'NA' or 'null' stay text. row_idx is the order of the file's rows, of a folder's files by name.

    The columns of the header are taken by name: ones beyond the schema are dropped, missing ones are ''.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    columns = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string") for f in schema.fields]
    named = raw.select(*[c.alias(f.name) for f, c in zip(schema.fields, columns)])
    rows = named.na.fill("")
    files = raw.inputFiles()
    if len(files) < 2:  # the parts of one file are read in its order
        return rows.withColumn("row_idx", F.monotonically_increasing_id())
    # files are read by size: their parts are numbered by name and place, and rows within them
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    blocks = raw.select(*block).distinct().withColumn("__block", F.row_number().over(Window.orderBy("__file", "__start")))
    named = raw.select(*[named_column.alias(f.name) for f, named_column in zip(schema.fields, columns)], *block, F.monotonically_increasing_id().alias("__id"))
    row_idx = F.shiftleft(F.col("__block").cast("long"), 33) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return named.join(F.broadcast(blocks), ["__file", "__start"]).select(*[f.name for f in schema.fields], row_idx.alias("row_idx")).na.fill("")


def source_paths(spark: SparkSession, data_dir: str, is_train: bool, fall_back: bool = True) -> dict[str, str]:
    """Paths of the three sources; test targets that are missing fall back to the training files where asked for."""
    part = "train" if is_train else "test"
    out = {}
    for k in (1, 2, 3):
        path = f"{data_dir}/{part}/{part}_source{k}.tsv"
        if k > 1 and not is_train and fall_back and not _exists(spark, path):
            path = f"{data_dir}/train/train_source{k}.tsv"
        out[f"s{k}"] = path
    return out


def load_sources(spark: SparkSession, data_dir: str, is_train: bool, subset: int = 0, fall_back: bool = True) -> tuple[DataFrame, DataFrame]:
    """(s1, targets): the first `subset` rows of the first source, or all; both target sources, the second before the third."""
    paths = source_paths(spark, data_dir, is_train, fall_back)
    s1 = load_data(spark, paths["s1"])
    return (first_rows(s1, subset) if subset else s1), concat_targets(load_data(spark, paths["s2"]), load_data(spark, paths["s3"]))


def concat_targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Both target sources; row_idx keeps the order of the sources and of the rows in them."""
    return s2.unionByName(s3.withColumn("row_idx", F.col("row_idx") + F.lit(1 << 60)))


def first_rows(records: DataFrame, n: int) -> DataFrame:
    return records.orderBy("row_idx").limit(n)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return load_data(spark, path, TRUTH)


def load_candidates(spark: SparkSession, path: str, s1: DataFrame) -> DataFrame | None:
    """Candidate lists of the chosen entities, or None if the file is missing or names none of them."""
    if not _exists(spark, path):
        return None
    lists = load_data(spark, path, CANDIDATES).drop("row_idx").join(s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    return None if lists.isEmpty() else lists


def write_tsv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of tab-separated files with headers; '' is written as nothing."""
    rows.write.mode(mode).option("header", True).option("sep", "\t").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: entities processed, with matches, singletons, and the share with matches in percent."""
    has = F.col("matched_entity_ids") != ""
    return results.agg(F.count("*").alias("processed"), F.count_if(has).alias("matched_entities"), F.count_if(~has).alias("singletons"), F.round(100 * F.avg(has.cast("double")), 6).alias("matched_percent"))


def last_row_of(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key, in row order."""
    order = Window.partitionBy(key).orderBy(F.desc("row_idx"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
