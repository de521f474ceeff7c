"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from bizmatch.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    last, seen = docs, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, last, DATA)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen and ids, name
        if name != "tokens":
            assert out.dtypes == docs.dtypes
            last, seen = out, set(ids)
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted(seen)


def test_stages_against_plain_ones(spark):
    """Each stage's rows, one document at a time on the driver."""
    import hashlib

    import numpy as np
    import public_tokenizers
    from test_joins import brute
    from tokenizers import Tokenizer

    from bizmatch.llm.quality import fit_quality, statistics
    from bizmatch.llm.toxicity import fit_toxicity

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, df: {r["doc_id"] for r in stages[name](spark, df, DATA).select("doc_id").collect()}
    quality, toxic = fit_quality(docs, labels), fit_toxicity(docs, labels)
    assert kept("quality", docs) == {d for d, t in texts.items() if quality.score(np.array([statistics(t)]))[0] >= 0.3}
    assert kept("toxicity", docs) == {d for d, t in texts.items() if toxic.score(t) < 0.7}
    assert kept("near_copies", docs) == {d for d, (_, c) in brute(list(texts.items()), 5, 80).items() if c == d}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["tokens"](spark, docs, DATA).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    mixed = kept("mixing", docs)
    words = {d: len(t.split()) for d, t in texts.items()}
    assert mixed <= set(texts) and abs(sum(words[d] for d in mixed) / sum(words.values()) - 0.9) < 0.1


TEXT = " ".join(f"word{k}" for k in range(60))


def test_near_copies_with_repeated_and_null_ids(spark):
    """One row of each group stays, whatever the ids; nothing else goes."""
    keep = lambda rows: sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()), key=str)
    alone, other = "a text of its own that is like no other one here", "two words more than five of them"
    assert keep([(5, TEXT), (5, alone), (2, TEXT), (7, other), (7, other)]) == sorted([(2, TEXT), (5, alone), (7, other)], key=str)
    assert keep([(1, TEXT), (1, TEXT), (2, TEXT), (None, TEXT), (None, alone), (None, other), (9, other)]) == sorted([(1, TEXT), (None, alone), (9, other)], key=str)
    assert keep([(None, TEXT), (None, TEXT + " x")]) == [(None, TEXT)] or keep([(None, TEXT), (None, TEXT + " x")]) == [(None, TEXT + " x")]


ODD = [(1, None), (2, ""), (3, " \n"), (4, TEXT), (4, TEXT), (None, TEXT), (None, None), (5, "very long " * 30000), (6, "x" * 200_000), (7, "short"), (7, "other words")]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, repeats, columns with clashing names; empty tables."""
    rows = [(d, t, "en" if k % 2 else None, None if k % 3 else "s", f"m{k}", k, f"r{k}") for k, (d, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_tokens string, score long, row string")
    out = stage(spark, docs, DATA)
    got = [tuple(r) for r in out.collect()]
    if name == "tokens":
        assert sorted((r[0], r[1]) for r in got if r[0] is not None and r[1] == 0) == [(1, 0), (2, 0)] and len(got) == len(rows)
    else:
        assert out.dtypes == docs.dtypes and set(got) <= set(rows) and len(got) == len(set(got))
    if name == "near_copies":
        assert sorted(r[5] for r in got if r[1] != TEXT) == [k for k, r in enumerate(rows) if r[1] != TEXT] and sum(r[1] == TEXT for r in got) == 1
    if name in ("quality", "toxicity"):
        kept = {}
        for r in rows:
            kept.setdefault(r[1] or "", set()).add(r in got)
        assert all(len(v) == 1 for v in kept.values())
    assert stage(spark, docs.limit(0), DATA).count() == 0
