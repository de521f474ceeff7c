"""Candidates by shared blocking keys within a country.

Both sides are postings (country, key, row); very frequent keys of the target side are dropped, as they are
in the definition of the result. `pair_overlap` is the relation of all pairs that share a key, with the number of keys;
`candidates` are the best of each query row, which `best_pairs` finds without that relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import address_words, blocking_keys
from ..functions.text import prepare_records
from ..session import materialize
from .best_pairs import best_pairs, target_classes

#: Hot keys are sent to all tasks only up to this many.
HOT_KEYS_SENT = 500_000


def postings(prepared: DataFrame, text: str = "clean") -> DataFrame:
    """(country, key hash, pos, entity_id, row) of each key of each prepared record; keys are not made distinct.

    A key travels as its 64-bit hash: two different keys of one country that share one would have to meet among
    all its keys.
    """
    if text not in ("clean", "norm"):
        raise ValueError("text is 'clean' or 'norm'")
    keyed = prepared.select("entity_id", F.col("row_idx").alias("row"), F.col("country_clean").alias("country"), F.posexplode(blocking_keys(f"name_{text}", f"addr_{text}", "numbers")).alias("pos", "key"))
    return keyed.withColumn("key", F.xxhash64("key"))


def record_keys(prepared: DataFrame, text: str = "clean") -> DataFrame:
    """(entity_id, row, country, keys): the key hashes of each prepared record, in order, once made."""
    own = ["entity_id", F.col("row_idx").alias("row"), F.col("country_clean").alias("country")]
    if "keys" in prepared.columns:
        return prepared.select(*own, "keys")
    prepared, keys = _with_keys(prepared, text)
    return materialize(prepared.select(*own, keys.alias("keys")), "record-keys")


def _with_keys(prepared: DataFrame, text: str) -> tuple[DataFrame, Column]:
    if text not in ("clean", "norm"):
        raise ValueError("text is 'clean' or 'norm'")
    prepared = prepared.withColumn("__places", address_words(f"addr_{text}"))
    return prepared, F.transform(blocking_keys(f"name_{text}", F.lit(""), "numbers", F.col("__places")), lambda k: F.xxhash64(k))


def kept_records(records: DataFrame, text: str = "clean") -> DataFrame:
    """Raw records with the text forms that features read and with `keys`, in a scratch table: for runs that train and score, so that text work is done once."""
    prepared, keys = _with_keys(prepare_records(records), text)
    return materialize(prepared.select(*(c for c in records.columns if c not in ("business_name", "business_address")), "country_clean", "name_norm", "name_stripped", "addr_norm", "numbers", keys.alias("keys")), "kept-records")


def _postings_of(records: DataFrame) -> DataFrame:
    return records.select("entity_id", "row", "country", F.posexplode("keys").alias("pos", "key"))


def _records_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("entity_id", "row", "country").agg(F.collect_list("key").alias("keys"))


def block_sizes(target_postings: DataFrame) -> DataFrame:
    return target_postings.groupBy("country", "key").agg(F.count("*").alias("size"))


def _hot_keys(target_postings: DataFrame, max_block_size: int) -> tuple[DataFrame, int]:
    """The keys that more than max_block_size postings of their country hold, and their number up to HOT_KEYS_SENT + 1."""
    hot = block_sizes(target_postings).where(F.col("size") > max_block_size).select("country", "key").cache()
    return hot, hot.limit(HOT_KEYS_SENT + 1).count()


def _without(target_postings: DataFrame, hot: DataFrame, number: int) -> DataFrame:
    # a hot key has more than max_block_size postings: few of them exist, but only a count proves it
    return target_postings.join(F.broadcast(hot) if number <= HOT_KEYS_SENT else hot, ["country", "key"], "left_anti")


def prune_hot_keys(target_postings: DataFrame, max_block_size: int) -> DataFrame:
    """Without the keys that more than max_block_size postings of their country hold."""
    return _without(target_postings, *_hot_keys(target_postings, max_block_size))


def pair_overlap(query_postings: DataFrame, target_postings: DataFrame) -> DataFrame:
    """(q_id, q_row, t_id, t_row, overlap, first_pos) of every pair that shares a key.

    Keys that repeat within a record are counted first, so that the join is over distinct keys of a record and
    carries multiplicities; overlap is the sum of their products.
    """
    q = query_postings.groupBy("country", "key", F.col("entity_id").alias("q_id"), F.col("row").alias("q_row")).agg(F.count("*").alias("qm"), F.min("pos").alias("pos"))
    t = target_postings.groupBy("country", "key", F.col("entity_id").alias("t_id"), F.col("row").alias("t_row")).agg(F.count("*").alias("tm"))
    both = q.join(t, ["country", "key"])
    # ids are grouped by, not picked: so all buffers are numbers, and the aggregate hashes
    return both.groupBy("q_row", "t_row", "q_id", "t_id").agg(F.sum(F.col("qm") * F.col("tm")).alias("overlap"), F.min("pos").alias("first_pos"))


def candidates(queries: DataFrame, targets: DataFrame, top_k: int = 30, max_block_size: int = 10_000, text: str = "clean") -> DataFrame:
    """Each prepared query record's top_k prepared target records of its country by overlap, ties by the first key that found them, then by target row.

    `rank` is a candidate's place in the list: by overlap where candidates had to be dropped, and in the order of discovery
    where all were kept.
    """
    known = record_keys(targets, text)
    hot, number = _hot_keys(_postings_of(known), max_block_size)
    if number:
        known = _records_of(_without(_postings_of(known), hot, number))
    return best_pairs(record_keys(queries, text), materialize(target_classes(known, top_k + 1), "target-classes"), top_k)


def candidate_lists(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids) of every query record, empty lists included."""
    lists = found.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t_id"))), lambda x: x["t_id"]), ",").alias("ids"))
    return queries.select(F.col("entity_id").alias("q_id")).join(lists, "q_id", "left").select(F.col("q_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))


def generate_candidates(s1: DataFrame, targets: DataFrame, top_k: int = 30, max_block_size: int = 10_000, text: str = "norm") -> DataFrame:
    """Candidate lists of raw records (with row_idx): the library's entry point, which blocks on normalised text by default."""
    q, t = prepare_records(s1), prepare_records(targets)
    return candidate_lists(q, candidates(q, t, top_k, max_block_size, text))


class BlockingIndex:
    """Postings of a target side, pruned, that query sides are probed against."""

    def __init__(self, max_block_size: int = 10_000, max_candidates: int = 30, text: str = "clean"):
        self.max_block_size, self.max_candidates, self.text = max_block_size, max_candidates, text
        self.postings: DataFrame | None = None
        self._classes: dict[int, DataFrame] = {}  # by the number of candidates

    def build(self, targets: DataFrame) -> "BlockingIndex":
        """Index prepared target records."""
        self.postings, self._classes = prune_hot_keys(postings(targets, self.text), self.max_block_size), {}
        return self

    def query_candidates(self, queries: DataFrame, max_candidates: int | None = None) -> DataFrame:
        if self.postings is None:
            raise ValueError("build the index first")
        most = max_candidates or self.max_candidates
        if most not in self._classes:
            self._classes[most] = materialize(target_classes(_records_of(self.postings), most + 1), "target-classes")
        return best_pairs(record_keys(queries, self.text), self._classes[most], most)
