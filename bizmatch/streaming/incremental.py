"""Arriving records against a fixed target side, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import prepare_records
from ..operators.blocking import BlockingIndex
from ..operators.pairs import featured
from ..operators.scoring import MatchModel
from ..operators.select import assemble_matches_per_source
from ..schema import Config


def match_stream(records: DataFrame, targets: DataFrame, path: str, checkpoint: str, model: MatchModel | None = None, config: Config = Config(), **trigger) -> StreamingQuery:
    """Append each micro-batch's matches to the Parquet folder `path`, in a subfolder of the batch, so that a batch that runs again replaces its own rows.

    The targets' postings and profiles are cached once and reused by every batch.
    """
    model = model or MatchModel()
    prepared = prepare_records(targets).cache()
    index = BlockingIndex(config.max_block_size, config.top_k, config.text).build(prepared)
    index.postings = index.postings.cache()

    def one(batch: DataFrame, number: int) -> None:
        rows = batch if "row_idx" in batch.columns else batch.withColumn("row_idx", F.monotonically_increasing_id())
        rows = prepare_records(rows)
        pairs = index.query_candidates(rows).select(F.col("q_id").alias("s1_id"), F.col("t_id").alias("cand_id"), "rank")
        scored = model.score(featured(pairs, rows, prepared))
        assemble_matches_per_source(scored, rows, config.threshold, config.max_s2, config.max_s3).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
