"""Record schema, names and defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A source record: all text, empty rather than null.
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "candidate_entity_ids")])

#: Pair features, in the order that models take them (fixed values).
FEATURES = (
    "name_lev_ratio", "name_jw_dist", "name_token_sort", "name_token_set", "name_partial_ratio",
    "stripped_jw", "stripped_tsr", "stripped_exact", "first_token_match", "common_token_frac",
    "name_length_ratio", "name_char_ratio", "name_token_overlap",
    "addr_jaccard", "addr_ngram_sim", "zip_exact", "nums_overlap",
)
#: The nine that the formula reads, which models of the first generation were trained on (fixed values).
LEGACY_FEATURES = ("stripped_jw", "stripped_tsr", "name_token_set", "name_partial_ratio", "stripped_exact", "first_token_match", "addr_jaccard", "nums_overlap", "zip_exact")


@dataclass(frozen=True)
class Config:
    """Defaults of a run. `text` is the form of names and addresses that blocking keys are made from: 'clean' or 'norm'."""

    top_k: int = 30
    max_block_size: int = 10_000
    threshold: float = 0.80
    rescore_threshold: float = 0.62
    max_s2: int = 5
    max_s3: int = 6
    train_entities: int = 50_000
    negatives: int = 5
    seed: int = 42
    text: str = "clean"
