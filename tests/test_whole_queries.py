"""The queries that do the whole job, on parts and documents that a cut would show on."""

from collections import Counter, defaultdict

import pytest

from bizmatch.operators.training import positives
from bizmatch.plans.queries import QUERIES
from bizmatch.sources.adapters import docs_as_business, docs_truth


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Parts of four countries of which more than 40 targets share each key of the name."""
    path = str(tmp_path_factory.mktemp("crowd"))
    rows = [(k, f"amber falcon {'works' if k % 7 else 'mill'}", None, None) for k in range(1, 401)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(k, "the same four words and ten more that all of them begin with here " + f"tail{k} " * 50 + "\nEnd, 77" + str(1000 + k // 3), "en") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_whole_texts(spark, long_texts):
    path, rows = long_texts
    clean = {f"S{k % 3 + 1}-{k}": " ".join(t.lower().replace(",", " ").split()) for k, t, _ in rows}
    assert {r["entity_id"]: r["clean"] for r in QUERIES["clean_text"](spark, path).collect()} == clean
    assert {r["entity_id"]: (r["n_tokens"], r["first"]) for r in QUERIES["tokens"](spark, path).collect()} == {e: (len(t.split()), "the") for e, t in clean.items()}
    assert all(r["words"].endswith(clean[r["entity_id"]][-len("tail9 end 771009"):].split(" ", 1)[1]) for r in QUERIES["significant_words"](spark, path).collect())
    # the number at the end is a key of whole texts only: it is shared within each three
    lists = {q: {} for q in clean if q[:2] == "S1"}
    for r in QUERIES["candidates_docs"](spark, path).collect():
        lists[r["q_id"]][r["t_id"]] = r["overlap"]
    for q, found in lists.items():
        group = int(q.split("-")[1]) // 3
        assert {t for t, n in found.items() if n == max(found.values())} == {t for t in clean if t[:2] != "S1" and int(t.split("-")[1]) // 3 == group}


def test_positives_of_all_entities(spark, tmp_path):
    rows = [(k, f"text {k // 3}", "en") for k in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(f"S1-{k}", f"S{j + 1}-{k + j}") for k in range(0, 900, 3) for j in (1, 2)}
    assert {tuple(r) for r in QUERIES["training_positives"](spark, str(tmp_path)).select("s1_id", "cand_id").collect()} == pairs
    docs = docs_as_business(spark, str(tmp_path))
    few = positives(docs_truth(docs)[1], docs.where("source = 1"), docs.where("source > 1"), 7)
    assert {tuple(r) for r in few.select("s1_id", "cand_id").collect()} == {(q, t) for q, t in pairs if int(q[3:]) < 21}


def test_semi_join_over_all_known_records(spark):
    data = "/root/testdata/sf0.001"
    pairs = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, data).select("s1_id", "cand_id").collect())
    assert pairs("semi_reduce") == pairs("pair_distinct")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def plain_rate(a, b):
    return 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    """Every window of the longer text, whole or cut off at an end; both ways round for equal lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    sides = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    return max(plain_rate(s, t[max(0, k) : k + len(s)]) for s, t in sides for k in range(1 - len(s), len(t)))


def test_scores_and_matches_by_hand(spark, crowd):
    """Partial ratio, formula, threshold and caps over the pairs and features that are held against SQL."""
    names = {r["entity_id"]: r["business_name_norm"] for r in QUERIES["preprocess"](spark, crowd).collect()}
    partial = {(r["s1_id"], r["cand_id"]): r["name_partial_ratio"] for r in QUERIES["feature_partial"](spark, crowd).collect()}
    by_name = {(names[q], names[t]): None for q, t in partial}
    by_name = {k: plain_partial(*k) for k in by_name}
    assert all(v == pytest.approx(by_name[names[q], names[t]], abs=1e-5) for (q, t), v in partial.items())
    features = defaultdict(dict)
    for name in ("features_native", "feature_jaro_winkler", "feature_lcs", "feature_token_set"):
        for r in QUERIES[name](spark, crowd).collect():
            features[r["s1_id"], r["cand_id"]].update(r.asDict())
    want = {}
    for pair, f in features.items():
        jw, tsr, ts = f["stripped_jw"] / 100, f["stripped_tsr"] / 100, f["name_token_set"] / 100
        name = 0.30 * jw + 0.25 * tsr + 0.20 * ts + 0.10 * partial[pair] / 100 + 0.15 * max(jw, tsr)
        address = 0.50 * f["addr_jaccard"] / 100 + 0.30 * f["nums_overlap"] + 0.20 * f["zip_exact"]
        want[pair] = 0.65 * name + 0.25 * address + 0.10 * (0.10 * f["stripped_exact"] + 0.05 * f["first_token_match"])
    got = {(r["s1_id"], r["cand_id"]): r["score"] for r in QUERIES["heuristic_score"](spark, crowd).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    rank = {(r["q_id"], r["t_id"]): r["rank"] for r in QUERIES["candidates_topk"](spark, crowd).collect()}
    lists = {e: [] for e in names if e[:2] == "S1"}
    for source, most in (("S2", 5), ("S3", 6)):
        for q in lists:
            own = sorted((-round(v, 9), rank[q, t], t) for (x, t), v in want.items() if x == q and t[:2] == source and v >= 0.62)
            lists[q] += [t for _, _, t in own[:most]]
    assert {r["source1_entity_id"]: r["matched_entity_ids"] for r in QUERIES["matching_results"](spark, crowd).collect()} == {q: ",".join(x) for q, x in lists.items()}


def test_rows_of_a_folder_are_in_the_order_of_its_files(spark, tmp_path):
    from bizmatch.sources.files import load_data

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for name, n in (("a", 3), ("b", 300), ("c", 30)):
        (tmp_path / f"{name}.tsv").write_text(head + "".join(f"S1-{name}{k:03}\tn\t\tc\n" for k in range(n)))
    rows = load_data(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["entity_id"] for r in rows] == [f"S1-{name}{k:03}" for name, n in (("a", 3), ("b", 300), ("c", 30)) for k in range(n)]
    assert len({r["row_idx"] for r in rows}) == 333 and rows[0]["business_address"] == ""


def test_parts_without_the_small_block_limit(spark, crowd):
    keys = QUERIES["blocking_keys"](spark, crowd).collect()
    country = {r["entity_id"]: r["country"] for r in QUERIES["records_parts"](spark, crowd).collect()}
    held = defaultdict(Counter)
    for r in keys:
        held[r["entity_id"]][r["key"]] += 1
    sizes = Counter((country[e], k) for e, c in held.items() if e[:2] != "S1" for k in c.elements())
    assert 40 < max(sizes.values()) <= 10_000
    want = {}
    for q in (e for e in held if e[:2] == "S1"):
        for t in (e for e in held if e[:2] != "S1" and country[e] == country[q]):
            n = sum(m * held[t][k] for k, m in held[q].items())
            if n:
                want[q, t] = n
    assert {(r["q_id"], r["t_id"]): r["overlap"] for r in QUERIES["pair_overlap"](spark, crowd).collect()} == want
    per = Counter(q for q, _ in want)
    for name, columns in (("candidates_topk", ("q_id", "t_id")), ("heuristic_score", ("s1_id", "cand_id")), ("feature_partial", ("s1_id", "cand_id")), ("features_native", ("s1_id", "cand_id"))):
        got = [tuple(r) for r in QUERIES[name](spark, crowd).select(*columns).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(want), name
        assert Counter(q for q, _ in got) == {q: min(30, n) for q, n in per.items()}, name
    postings = QUERIES["hot_keys_pruned"](spark, crowd).count()
    assert postings == sum(sizes.values())
    matched = QUERIES["matching_results"](spark, crowd).where("matched_entity_ids <> ''").count()
    from bizmatch.plans.resolve import resolve
    from bizmatch.schema import Config
    from bizmatch.sources.adapters import parts_as_business

    rows = parts_as_business(spark, crowd)
    small = resolve(rows.where("source = 1"), rows.where("source > 1"), config=Config(max_block_size=40, threshold=0.62)).where("matched_entity_ids <> ''").count()
    assert matched > small
