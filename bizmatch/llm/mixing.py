"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Up to so many cells (source x language x topic) are raked on the driver; more stay a table.
DRIVER_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when no probability moves by more.
TOLERANCE = 1e-9
#: Stands for null in a dimension.
NONE = "\x00"


def form_topic(text: Column) -> Column:
    """A topic by the text's form, from marks that it holds anywhere."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.contains(" | "), "table")
        .when(text.contains("###") | text.contains("***") | text.contains("%%%"), "marked")
        .when(text.contains("!!"), "shouting")
        .when(text.contains("icense"), "notice")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def tempered(shares: np.ndarray, power: float) -> np.ndarray:
    out = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), power), 0.0)
    return out / out.sum() if out.sum() else out


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int, tolerance: float) -> np.ndarray:
    """A probability of each cell, so that the expected tokens' marginals are keep x the targets' shares.

    Iterative proportional fitting over the dimensions in turn; no probability is above 1, so a marginal that
    would need more tokens than there are stays below its target.
    """
    p = np.full(len(tokens), keep)
    total = keep * tokens.sum()
    for _ in range(rounds):
        before = p
        for code, share in zip(codes, targets):
            now = np.bincount(code, tokens * p, len(share))
            p = np.minimum(1.0, p * np.where(now > 0, share * total / np.where(now > 0, now, 1), 1)[code])
        if np.abs(p - before).max(initial=0) < tolerance:
            break
    return p


def _raked_table(cells: DataFrame, power: float, targets: dict, keep: float, rounds: int) -> DataFrame:
    """The same for cells that are too many for the driver."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    p = cells.withColumn("p", F.lit(keep))
    for d in DIMENSIONS:
        share = F.when(F.col("t") > 0, F.pow(F.col("t") / max(1, total), power)).otherwise(0.0)
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("t")).withColumn("share", share)
        if d in targets:
            given = F.lit(0.0)
            for value, x in targets[d].items():
                given = F.when(F.col(d) == F.lit(value), F.lit(float(x))).otherwise(given)
            sums = sums.withColumn("share", given)
        whole = sums.agg(F.sum("share")).first()[0] or 1.0  # no share at all stays none
        p = p.join(sums.select(d, (F.col("share") / whole).alias(f"share_{d}")), d)
    p = materialize(p, "cells")
    for _ in range(rounds):
        last = p
        for d in DIMENSIONS:  # sums are added up before they are joined: one value may have a third of the cells
            now = F.col("now")
            sums = p.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
            scaled = F.when(now > 0, F.col("p") * (F.col(f"share_{d}") * keep * total / now)).otherwise(F.col("p"))
            p = p.join(sums, d).withColumn("p", F.least(F.lit(1.0), scaled)).drop("now")
        p = materialize(p, "cells")
        moved = p.alias("x").join(last.alias("y"), list(DIMENSIONS)).agg(F.max(F.abs(F.col("x.p") - F.col("y.p")))).first()[0]
        discard(last)
        if moved is None or moved < TOLERANCE:
            break
    return p.select(*DIMENSIONS, F.col("p").alias("probability"))


def mixing_probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.7, keep: float = 0.5, seed: int = 20, rounds: int = 200, topic: Column | None = None) -> DataFrame:
    """Each document's probability of being sampled, and whether it is, for given marginals of the token weights.

    Returns docs' rows with the columns mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_sampled
    behind their own (of the same names, if any, only these are returned). `targets` maps 'source', 'lang' or 'topic' to the shares of its
    values (values not named get none); a dimension that is not named gets its present token shares to the power
    `temper`. About `keep` of all tokens are sampled. A document's tokens are its words (runs of non-space), one at
    least, or none for a null or empty text; nulls of a dimension are a value of their own; `topic` is by default the text's form.
    The draw depends on doc_id and seed alone, so that repeated rows share their fate. An empty table gives no rows.

    Counts cover all documents. Only cells are raked: on the driver if they are DRIVER_CELLS at most, and as a
    table beyond.
    """
    targets = targets or {}
    text = F.col("text")
    keyed = docs.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "mix_topic": F.coalesce((form_topic(text) if topic is None else topic).cast("string"), F.lit(NONE)),
        "mix_tokens": F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit("\\S+")))).cast("long"),
    })
    cells = materialize(keyed.groupBy(*[F.col(f"mix_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    if cells.count() <= DRIVER_CELLS:
        rows = cells.orderBy(*DIMENSIONS).collect()
        tokens = np.array([r["tokens"] for r in rows], float)
        codes, shares = [], []
        for d in DIMENSIONS:
            values, code = np.unique([r[d] for r in rows], return_inverse=True) if rows else (np.empty(0, str), np.empty(0, int))
            sums = np.bincount(code, tokens, len(values))
            if d in targets:
                share = np.array([float(targets[d].get(str(v), 0)) for v in values])
                share = share / share.sum() if share.sum() else share
            else:
                share = tempered(sums / max(1.0, sums.sum()), temper)
            codes.append(code)
            shares.append(share)
        p = rake(tokens, codes, shares, keep, rounds, TOLERANCE)
        table = docs.sparkSession.createDataFrame([(r["source"], r["lang"], r["topic"], float(x)) for r, x in zip(rows, p)], "mix_source string, mix_lang string, mix_topic string, mix_probability double")
        table = F.broadcast(table)  # DRIVER_CELLS rows at most
    else:
        table = _raked_table(cells, temper, targets, keep, rounds)
        table = table.select(*[F.col(d).alias(f"mix_{d}") for d in DIMENSIONS], F.col("probability").alias("mix_probability"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    names = [c for c in docs.columns if c.lower() not in ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_probability", "mix_sampled")]
    out = keyed.join(table, ["mix_source", "mix_lang", "mix_topic"])
    return out.select(*names, "mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_probability", (draw < F.col("mix_probability")).alias("mix_sampled"))
