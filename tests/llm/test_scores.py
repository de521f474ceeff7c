"""Quality, toxicity, mixing, licences, sharding."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bizmatch.llm import licenses, mixing
from bizmatch.llm.fitting import isotonic
from bizmatch.llm.licenses import scan_licenses
from bizmatch.llm.mixing import mixing_probabilities
from bizmatch.llm.quality import FEATURES, KERNEL_WIDTH, NAMES, RIDGE, fit_quality, score_quality, statistics
from bizmatch.llm.sharding import assign_shards, jump_hash
from bizmatch.llm.toxicity import CARRIER, FOLDS, LEAST, PIECES, POWERS, WINDOW, Scorer, chosen, evidence, fit_toxicity, plain_pieces, score_toxicity, telling, windows

ODD = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "x" * 30000), (900_005, "word " * 30000), (None, "null id"), (900_006, "same"), (900_006, "same")]


def words(rng, n):
    return [rng.choice(["ba", "de", "ki", "lo", "mu"]) + rng.choice(["ran", "sol", "tem", "vi", "x"]) + rng.choice(["", "a", "o", "ine"]) for _ in range(n)]


def corpus(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(900):
        w = words(rng, rng.randrange(20, 200))
        bad, toxic = d % 5 == 0, d % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if d % 2 else [w[0]] * len(w)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumbix", "flotzen", "snarvel"])
        rows.append((d, " ".join(w)))
        labels.append((d, 0 if bad else 1, 1 if toxic else 0))
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1)).withColumn("held_out", F.lit(1))
    return docs, spark.createDataFrame(labels + [(900_001, None, None), (None, 1, 1), (5, None, 1), (800_000, 1, 0)], "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


@pytest.mark.parametrize("score,of,by,rest,cut", [(score_quality, 0, 5, 0, 0.3), (score_toxicity, 1, 3, 1, 0.7)])
def test_held_out_accuracy(spark, score, of, by, rest, cut):
    docs, labels, truth = corpus(spark, 2)
    rows = score(docs, labels).collect()
    assert len(rows) == 900 + len(ODD)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % by == rest)
    held = [(truth[r["doc_id"]][of], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    same = {r["score"] for r in rows if r["doc_id"] == 900_006}
    assert len(same) == 1


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores_without_labels_or_rows(spark, score):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in score(docs, labels).collect())
    assert score(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(k, 1, 1) for k in range(40)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in score(spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string"), one).collect())


def test_statistics():
    assert statistics(None) == statistics("") == [0.0] * len(NAMES)
    s = dict(zip(NAMES, statistics("Aa bb bb!\nc|")))
    assert s["distinct"] == pytest.approx(1.0) and s["pipe"] == pytest.approx(1 / 4) and s["bang"] == pytest.approx(1 / 4)
    assert dict(zip(NAMES, statistics("a a b b b")))["repeats"] == pytest.approx(3 / 5)
    assert all(np.isfinite(statistics(t)).all() for _, t in ODD)


def test_isotonic():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=300)
    y = (rng.uniform(size=300) < x).astype(float)
    knots, values = isotonic(x, y)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) >= 0).all()
    assert np.interp(x, knots, values).mean() == pytest.approx(y.mean(), abs=0.02)


def plain_windows(text):
    """Words in a row of WINDOW bytes or a little more together, one word at a time."""
    out, row = set(), b""
    for w in re.findall(r"\w+", (text or "").lower()):
        w = w.encode("utf-8", "replace")
        while w:
            row, w = row + b" " + w[:WINDOW], w[WINDOW:]
            if len(row) >= WINDOW:
                out.add(row + b" ")
                row = b""
    return out | ({row + b" "} if row else set())


def test_windows():
    for t in (None, "", " \n", "Usual words, here", "q" * 500 + " é " + "x " * 300, "a b" * 2000):
        assert windows(t) == plain_windows(t)
    s = Scorer([["grumbix", "flotzen"], []], ["usual", "words", "here", "come", "again"])
    assert (s.differences("usual words here, usual words come again and again").T[1] == 0).all()
    toxic = s.differences("usual words here GRUMBIX, usual words come again and again flotzenix")
    assert toxic[:, 0].max() >= 3 and (toxic[:, 1] == 0).all()
    assert evidence(toxic, 1, 0.5)[0] > 0 and evidence(s.differences(None), 1, 1.0).tolist() == [0, 0]


def lengths(content, many):
    import zstandard

    setup = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=13, hash_log=13, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=setup)
    z = zstandard.ZstdCompressor(dict_data=known, compression_params=setup)
    return [len(z.compress(CARRIER + w)) for w in many]


def test_toxicity_by_hand(spark):
    """Dictionaries, evidence and calibration again from the labelled rows, one text at a time; then every score."""
    docs, labels, truth = corpus(spark, 8)
    rows = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    learn = {}
    for d, t in rows:
        if d in truth and d is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            learn[t or ""] = max(learn.get(t or "", 0), truth[d][1])
    fold = {t: xxhash64(t) % FOLDS for t in learn}
    held = {t: {p for w in set(re.findall(r"\w+", t.lower())) for p in plain_pieces(w)} for t in learn}
    words = Counter(w for t, y in learn.items() if not y for w in set(re.findall(r"\w+", t.lower())) if len(w) <= WINDOW)
    usual = sorted(words, key=lambda w: (-words[w], w))[:600]
    every = sorted({p for t, y in learn.items() if y for p in held[t]})

    def dictionary(texts, most):
        ones, zeros = ([t for t in texts if learn[t] == y] for y in (1, 0))
        count = lambda of: np.array([c[p] for c in [Counter(p for t in of for p in held[t])] for p in every], float)
        return chosen(every, telling(count(ones), count(zeros), len(ones), len(zeros)), most)

    def content(pieces):
        base = (" " + " ".join(reversed(usual)) + " ").encode() + CARRIER
        return ((" " + "  ".join(reversed(pieces)) + " ").encode() if pieces is not None else b"") + base

    def found(text, pieces, least, power):
        many = sorted(plain_windows(text))
        gain = [a - b for a, b in zip(lengths(content(None), many), lengths(content(pieces), many))]
        return sum(g for g in gain if g >= least) / (len(many) + 4) ** power

    model = fit_toxicity(docs, labels)
    size = next(k for k in PIECES if dictionary(list(learn), k) == model.scorer.state[0][0])
    assert sorted(model.scorer.state[1]) == sorted(usual) and model.least in LEAST and model.power in POWERS
    others = {f: dictionary([t for t in learn if fold[t] != f], size) for f in range(FOLDS)}
    s = np.array([found(t, others[fold[t]], model.least, model.power) for t in learn])
    knots = isotonic(s, np.array([float(y) for y in learn.values()]))
    for x, y in zip(knots, model.knots):
        assert x == pytest.approx(y)
    mine = dictionary(list(learn), size)
    for r in score_toxicity(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id < 100 or doc_id > 900000").collect():
        assert r["score"] == pytest.approx(np.clip(np.interp(found(r["text"], mine, model.least, model.power), *knots), 0, 1))


def xxhash64(*values):
    """Spark's hash of integers and strings in a row."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_quality_by_hand(spark):
    """The fit again: all rows' features at once, normal equations solved once, violators pooled by hand."""
    docs, labels, truth = corpus(spark, 9)
    model = fit_quality(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in truth and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0]
    x, y = np.array([statistics(t) for _, t in rows]), np.array([truth[d][0] for d, _ in rows], float)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    rng = np.random.default_rng(5)
    turns = rng.standard_normal((x.shape[1], FEATURES)) / KERNEL_WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def lift(z):
        return np.hstack((np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -10, 10) @ turns + phase), np.ones((len(z), 1))))

    def solve(a, b):
        penalty = np.diag([RIDGE * len(a) / 10] * FEATURES + [1e-9])
        return np.linalg.solve(a.T @ a + penalty, a.T @ b)

    a = lift(z)
    assert a @ solve(a, y) == pytest.approx(model.lift(x) @ model.weights, abs=1e-6)
    fold = np.array([xxhash64(struct.pack("<q", d), struct.pack("<i", 1)) % 5 for d, _ in rows])
    outside = np.empty(len(y))
    for f in range(5):
        outside[fold == f] = a[fold == f] @ solve(a[fold != f], y[fold != f])
    # the greatest lower set mean of all that start at or before a score: the isotonic fit by its definition
    order = np.argsort(outside, kind="stable")
    sums = np.concatenate(([0], np.cumsum(y[order])))
    n = len(y)
    fit = [max(min((sums[j + 1] - sums[i]) / (j + 1 - i) for j in range(k, n)) for i in range(k + 1)) for k in range(0, n, 37)]
    assert np.interp(outside[order][::37], *model.knots) == pytest.approx(fit, abs=1e-6)
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).where("doc_id < 900").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 900").collect()}
    z = (np.array([statistics(t) for t in texts.values()]) - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    want = np.clip(np.interp(lift(z) @ solve(a, y), *model.knots), 0, 1)
    assert [scores[d] for d in texts] == pytest.approx(want, abs=1e-5)


def test_rake():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, n, 60) for n in (5, 4, 3))
    tokens = rng.integers(50, 500, 60).astype(float)
    shares = [mixing.tempered(np.bincount(x, tokens, n) / tokens.sum(), 0.8) for x, n in ((a, 5), (b, 4), (c, 3))]
    p = mixing.rake(tokens, [a, b, c], shares, 0.4, 500, 1e-12)
    assert (p > 0).all() and (p <= 1).all()
    for x, share in zip((a, b, c), shares):
        assert np.bincount(x, tokens * p, len(share)) == pytest.approx(share * 0.4 * tokens.sum(), rel=1e-3)


def mix_docs(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 60))) + rng.choice(["", " | x", "!!"]), rng.choice(["a", "a", "a", "b"]), rng.choice(["en", "de", None])) for k in range(3000)]
    rows += [(5000, None, "a", "en"), (5001, "", None, None), (None, "x", "b", "de"), (7, "again", "a", "en"), (7, "again", "a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("mix_tokens", F.lit("clash")).withColumn("topic", F.lit("own"))


MIXES = [{}, {"source": {"a": 1, "b": 1}}, {"source": {"a": 1}, "lang": {"en": 2, "fr": 1}}, {"source": {"nowhere": 1}}, {"topic": {}}]


@pytest.mark.parametrize("targets", MIXES)
def test_mixing_against_plain_raking(spark, monkeypatch, targets):
    """Cells, shares, probabilities and draws by a plain loop; the driver's way and the table's give the same."""
    docs = mix_docs(spark)
    rows = [(r["doc_id"], r["source"] or mixing.NONE, r["lang"] or mixing.NONE, r["mix_topic"], r["mix_tokens"], r["mix_probability"], r["mix_sampled"], r["text"]) for r in mixing_probabilities(docs, targets=targets, keep=0.3).collect()]
    cells = Counter()
    for _, s, lang, topic, n, _, _, text in rows:
        assert n == len((text or "").split()) or n == 1 and text
        cells[s, lang, topic] += n
    total, p = sum(cells.values()), {c: 0.3 for c in cells}
    shares = []
    for k, d in enumerate(mixing.DIMENSIONS):
        sums = Counter()
        for c, n in cells.items():
            sums[c[k]] += n
        share = {v: float(targets[d].get(v, 0)) if d in targets else (n / total) ** 0.7 if n else 0.0 for v, n in sums.items()}
        shares.append({v: x / (sum(share.values()) or 1) for v, x in share.items()})
    for _ in range(200):
        for k, share in enumerate(shares):
            now = Counter()
            for c, n in cells.items():
                now[c[k]] += n * p[c]
            p = {c: min(1.0, x * share[c[k]] * 0.3 * total / now[c[k]]) if now[c[k]] > 0 else x for c, x in p.items()}
    for d, s, lang, topic, _, x, sampled, _ in rows:
        assert x == pytest.approx(p[s, lang, topic], abs=1e-6)
        draw = (xxhash64(*([struct.pack("<q", d)] if d is not None else []), struct.pack("<i", 20)) % (1 << 64) >> 11) / 2**53
        assert sampled == (draw < x)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    table = {(r["doc_id"], r["text"]): r["mix_probability"] for r in mixing_probabilities(docs, targets=targets, keep=0.3, rounds=12).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1000)
    assert table == {k: pytest.approx(v, abs=1e-9) for k, v in {(r["doc_id"], r["text"]): r["mix_probability"] for r in mixing_probabilities(docs, targets=targets, keep=0.3, rounds=12).collect()}.items()}


def test_mixing(spark, monkeypatch):
    docs = mix_docs(spark)
    got = mixing_probabilities(docs, targets={"source": {"a": 1, "b": 1}}, keep=0.3)
    rows = got.collect()
    assert len(rows) == 3005 and "topic" in got.columns and got.columns.count("mix_tokens") == 1
    total = sum(r["mix_tokens"] for r in rows)
    for s in ("a", "b"):
        assert sum(r["mix_tokens"] * r["mix_probability"] for r in rows if r["source"] == s) == pytest.approx(0.15 * total, rel=0.02)
    kept = sum(r["mix_tokens"] for r in rows if r["mix_sampled"])
    assert kept == pytest.approx(0.3 * total, rel=0.1)
    assert len({r["mix_sampled"] for r in rows if r["doc_id"] == 7}) == 1
    for cells in (1000, 1):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
        assert mixing_probabilities(docs.limit(0)).count() == 0
        empty = docs.where("doc_id = 5000 or doc_id = 5001")
        assert [r["mix_probability"] for r in mixing_probabilities(empty, keep=0.3).collect()] == [0.3, 0.3]


def test_licenses(spark):
    rows = [
        ("r/LICENSE", "MIT License\nReleased under the MIT License."), ("r/a/x.py", "code without any notice"), ("r/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("r/a/b/c/y.py", "nothing"), ("r/a/z.py", "some code\nLicensed under CC BY-NC 4.0.\n" + "more words " * 3000), ("q/w.py", "we mention that a licence is a long and winding thing of many words"), ("top", "plain"),
        (None, "Licensed under the Apache License, Version 2.0."), ("r/n", None), ("r/a/x.py", "code without any notice"), ("e/empty", ""),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, p string, text string").withColumn("license", F.lit("x")).withColumn("folder", F.lit(1))
    got = {r["doc_id"]: (r["license"], r["how"]) for r in scan_licenses(df, F.col("p")).collect()}
    assert got == {
        0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("GPL-3.0", "file"), 3: ("GPL-3.0", "inherited"), 4: ("CC-BY-NC-4.0", "header"), 5: (None, "none"), 6: (None, "none"),
        7: ("Apache-2.0", "file"), 8: ("MIT", "inherited"), 9: ("MIT", "inherited"), 10: (None, "none"),
    }
    assert scan_licenses(df.limit(0), F.col("p")).count() == 0
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        one = spark.createDataFrame([(1, "f", text)], "doc_id long, p string, text string")
        if k % 7 == 0:
            assert scan_licenses(one, F.col("p")).first()["license"] == name


def test_licences_in_longer_lines_wrapped_and_whole(spark):
    mpl = "/* This Source Code Form is subject\n * to the terms of\n * the Mozilla Public\n * License, v. 2.0. */\n" + "int x = 1;\n" * 50
    gpl = "# You can redistribute it and/or modify\n# it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n# of the License, or (at your option)\n# any later version.\ncode"
    whole = lambda name: (licenses.TEXTS / f"{name}.txt").read_text(encoding="utf-8")
    wanted = [
        ("a/1", "Written by the project team in 2019 for public use. Released under the MIT License. Please send questions to the list.", "MIT", "header"),
        ("b/1", mpl, "MPL-2.0", "header"), ("c/1", gpl, "GPL-2.0", "file"), ("c2/1", gpl + "\nx = 1" * 90, "GPL-2.0", "header"), ("d/1", "// SPDX-License-Identifier: MIT\ncode", "MIT", "header"),
        ("e/1", "# SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0", "header"), ("f/1", "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)\n", "GPL-2.0", "header"),
        ("g/1", "Copyright (c) 2020 A. Person\n\n" + whole("MIT"), "MIT", "file"), ("g/2", "code", "MIT", "inherited"), ("h/1", whole("GPL-3.0"), "GPL-3.0", "file"), ("i/1", whole("BSD-2-Clause"), "BSD-2-Clause", "file"),
        ("j/1", "x\nThis is free and unencumbered software\nreleased into the public\ndomain.\n" + "y z\n" * 99, "Unlicense", "header"),
        ("k/1", "We asked which licence the committee would like and it said that permission was a matter for the owners of the domain. " * 9, None, "none"),
        ("l/1", "Our friends prefer the MIT license over others because the lawyers like it.", None, "none"),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(wanted)], "doc_id long, p string, text string")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in scan_licenses(df, F.col("p")).collect()}
    assert got == {k: x[2:] for k, x in enumerate(wanted)}


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    rng = random.Random(6)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").select("k", jump_hash(F.col("k"), [1, 40, 41, 3]).alias("j"), jump_hash(F.col("k"), [7]).alias("s"))
    for r in df.collect():
        k = r["k"] or 0
        assert (r["j"]["s0"], r["j"]["s1"], r["j"]["s2"], r["j"]["s3"], r["s"]["s0"]) == tuple(jump(k, n) for n in (1, 40, 41, 3, 7))
    with pytest.raises(ValueError):
        jump_hash(F.lit(1), [0])


def test_shards(spark):
    rows = [(k, f"té {k}") for k in range(2000)] + [(3, "again"), (3, "again"), (None, None), (None, "x"), (5000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("row", F.lit(0))
    got = assign_shards(df, 40).collect()
    assert len(got) == len(rows)
    slots, texts = {}, {}
    for d, t in rows:
        texts.setdefault(d, set()).add((len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())))
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] == jump(r["doc_id"] or 0, 41)
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert assign_shards(df.limit(0)).count() == 0
