"""Queries over the driver's tables, one for each operator, and their SQL.

Records come from the two adapters. Where SQL has no string kernels, scores for selection and evaluation are
made from the number of shared keys, so that both engines can follow.
"""

from __future__ import annotations

from collections.abc import Callable
from string import punctuation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import blocking_keys
from ..operators import blocking as B
from ..operators import evaluate as E
from ..operators import pairs as P
from ..operators import select as S
from ..operators import training as R
from ..operators.scoring import MatchModel
from ..schema import CANDIDATES, FEATURES, RECORD, Config
from ..sources.adapters import docs_as_business, docs_truth, parts_as_business, whole_texts
from ..session import scratch_path
from ..sources.files import load_data, run_summary, write_tsv
from .resolve import rescore, resolve, score_all, train

#: The operators' own limits: postings of a key, candidates of a record, entities that are trained on.
BLOCK, TOP_K, ENTITIES = Config().max_block_size, 30, Config().train_entities
RECORD_COLUMNS = [f.name for f in RECORD.fields]


def _prepared(spark: SparkSession, d: str, of=parts_as_business) -> tuple[DataFrame, DataFrame]:
    rows = T.prepare_records(of(spark, d))
    return rows.where("source = 1"), rows.where("source > 1")


def _found(spark: SparkSession, d: str, of=docs_as_business, block: int = BLOCK, text: str = "clean") -> DataFrame:
    q, t = _prepared(spark, d, of)
    return B.candidates(q, t, TOP_K, block, text)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a score made from shared keys."""
    return _found(spark, d).select(F.col("q_id").alias("s1_id"), F.col("t_id").alias("cand_id"), "rank", F.round(F.col("overlap") / (F.col("overlap") + 2), 6).alias("score"))


def _features(spark: SparkSession, d: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    q, t = _prepared(spark, d)
    pairs = B.candidates(q, t, TOP_K, BLOCK).select(F.col("q_id").alias("s1_id"), F.col("t_id").alias("cand_id"), "rank")
    return P.featured(pairs, q, t, features)


def _some(*names: str):
    return lambda s, d: _features(s, d, names).select("s1_id", "cand_id", *[F.round(n, 6).alias(n) for n in names])


def _text(of, **columns) -> Callable:
    return lambda s, d: of(s, d).select("entity_id", *[c().alias(n) for n, c in columns.items()])


def _block_sizes(s, d):
    return B.block_sizes(_keys_table(s, d)[1])


def _keys_table(s, d, of=parts_as_business):
    """Postings with their keys as text, for queries that show them."""
    out = []
    for rows in _prepared(s, d, of):
        out.append(rows.select("entity_id", F.col("row_idx").alias("row"), F.col("country_clean").alias("country"), F.posexplode(blocking_keys("name_clean", "addr_clean", "numbers")).alias("pos", "key")))
    return out


def _hot(s, d):
    return B.prune_hot_keys(_keys_table(s, d)[1], BLOCK).select("entity_id", "country", "key")


def _overlap(s, d):
    q, t = _prepared(s, d)
    return B.pair_overlap(B.postings(q), B.prune_hot_keys(B.postings(t), BLOCK)).select("q_id", "t_id", "overlap", "first_pos")


def _lists(s, d, of=docs_as_business):
    q, _ = _prepared(s, d, of)
    return B.candidate_lists(q, _found(s, d, of))


def _counts(s, d, threshold=0.5):
    entities, truth = docs_truth(docs_as_business(s, d))
    return E.pair_counts(entities, truth, S.capped(_scored(s, d), threshold).select("s1_id", "cand_id"))


def _truth_lists(s, d):
    entities, pairs = E.parse_truth(_lists(s, d).withColumnRenamed("candidate_entity_ids", "matched_entity_ids"))
    return entities.join(pairs, "s1_id", "left")


def _best_threshold(s, d):
    entities, truth = docs_truth(docs_as_business(s, d))
    best, f = E.optimize_threshold(_scored(s, d), entities, truth, [0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    return s.createDataFrame([(best, round(f, 6))], "threshold double, macro_f05 double")


def _feature_dataset(s, d):
    rows = docs_as_business(s, d)
    names = ("stripped_exact", "addr_jaccard", "nums_overlap")
    out = P.build_feature_dataset(_lists(s, d), rows.where("source = 1"), rows.where("source > 1"), names)
    return out.select("s1_id", "cand_id", *[F.round(n, 6).alias(n) for n in names])


def _classifier(s, d):
    """Scores of a small classifier, trained and applied on the pairs of documents."""
    rows = B.kept_records(docs_as_business(s, d))
    s1, t = rows.where("source = 1"), rows.where("source > 1")
    model = train(s1, t, None, max_iter=3, validate=False)
    scored, _ = score_all(s1, t, model)
    return scored


def _results(s, d, threshold=0.5):
    q, _ = _prepared(s, d, docs_as_business)
    return S.assemble_matches_per_source(_scored(s, d), q, threshold)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sweep(s, d):
    entities, truth = docs_truth(docs_as_business(s, d))
    return _rounded(E.threshold_sweep(_scored(s, d), entities, truth, [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]))


def _semi(s, d):
    """Lists with unknown ids on both sides, reduced to the known records."""
    q, t = _prepared(s, d, docs_as_business)
    lists = _lists(s, d)
    more = lists.select("source1_entity_id", F.concat_ws(",", "candidate_entity_ids", F.concat(F.lit("S2-unknown-"), "source1_entity_id")).alias("candidate_entity_ids"))
    strange = lists.select(F.concat(F.lit("S1-unknown-"), "source1_entity_id").alias("source1_entity_id"), "candidate_entity_ids")
    return P.semi_reduce(P.pair_distinct(P.explode_candidates(more.unionByName(strange))), q, t).select("s1_id", "cand_id")


def _distinct(s, d):
    lists = _lists(s, d)
    twice = lists.select("source1_entity_id", F.concat_ws(", ", "candidate_entity_ids", "candidate_entity_ids", F.lit("")).alias("candidate_entity_ids"))
    return P.pair_distinct(P.explode_candidates(twice)).select("s1_id", "cand_id")


def _positives(s, d):
    q, t = _prepared(s, d, docs_as_business)
    _, truth = docs_truth(docs_as_business(s, d))
    return R.positives(truth, q, t, ENTITIES)


def _negatives(s, d):
    q, t = _prepared(s, d, docs_as_business)
    _, truth = docs_truth(docs_as_business(s, d))
    return R.negatives(R.positives(truth, q, t), q, t, 5, same_country=True)


def _resolved(s, d):
    rows = parts_as_business(s, d)
    return resolve(rows.where("source = 1"), rows.where("source > 1"), config=Config(threshold=0.62))


def _docs_resolved(s, d):
    rows = docs_as_business(s, d)
    return resolve(rows.where("source = 1"), rows.where("source > 1"), config=Config(threshold=0.62))


def _rescored(s, d):
    rows = docs_as_business(s, d)
    return rescore(rows.where("source = 1"), rows.where("source > 1"), _lists(s, d))


def _heuristic(s, d):
    return MatchModel().score(_features(s, d, MatchModel().reads())).select("s1_id", "cand_id", F.round("score", 6).alias("score"))


def _tsv(s, d):
    path = scratch_path(s, "tsv")
    write_tsv(docs_as_business(s, d).select(*RECORD_COLUMNS), path)
    return load_data(s, path).select(*RECORD_COLUMNS)


def _list_file(s, d):
    path = scratch_path(s, "lists")
    write_tsv(_lists(s, d), path)
    return load_data(s, path, CANDIDATES).drop("row_idx")


def _unmatched(s, d):
    """Entities of countries that no target is in."""
    q, t = _prepared(s, d)
    return q.join(t.select("country_clean").distinct(), "country_clean", "left_anti").select("entity_id", "country_clean")


NATIVE = ("stripped_exact", "first_token_match", "common_token_frac", "name_length_ratio", "name_char_ratio", "name_token_overlap", "addr_jaccard", "addr_ngram_sim", "zip_exact", "nums_overlap")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "records_parts": lambda s, d: parts_as_business(s, d),
    "records_docs": lambda s, d: docs_as_business(s, d).drop("mark"),
    "clean_text": _text(whole_texts, clean=lambda: T.clean_text("text")),
    "normalize_abbreviations": _text(parts_as_business, norm=lambda: T.normalize_abbreviations(T.clean_text("business_address"))),
    "strip_legal_suffixes": _text(parts_as_business, stripped=lambda: T.strip_legal_suffixes(T.clean_text("business_name"))),
    "extract_numbers": _text(parts_as_business, numbers=lambda: T.extract_numerical_tokens(T.clean_text("business_address"))),
    "normalize_ampersand": _text(parts_as_business, amp=lambda: T.normalize_ampersand("business_name")),
    "normalize_name": _text(parts_as_business, name=lambda: T.normalize_name_for_matching("business_name")),
    "tokens": _text(whole_texts, n_tokens=lambda: F.size(T.tokens(T.clean_text("text"))), first=lambda: T.first_token(T.clean_text("text"))),
    "significant_words": _text(whole_texts, words=lambda: F.array_join(T.significant_words(T.clean_text("text"), 3), " ")),
    "preprocess": lambda s, d: T.preprocess_dataframe(parts_as_business(s, d)).drop("source", "row_idx"),
    "blocking_keys": lambda s, d: _keys_table(s, d)[0].unionByName(_keys_table(s, d)[1]).select("entity_id", "pos", "key"),
    "block_sizes": _block_sizes,
    "hot_keys_pruned": _hot,
    "pair_overlap": _overlap,
    "candidates_topk": lambda s, d: _found(s, d, parts_as_business).select("q_id", "t_id", "overlap", "rank"),
    "candidates_docs": lambda s, d: _found(s, d).select("q_id", "t_id", "overlap", "rank"),
    "candidate_lists": _lists,
    "generate_candidates": lambda s, d: B.generate_candidates(docs_as_business(s, d).where("source = 1"), docs_as_business(s, d).where("source > 1")),
    "country_only_singletons": _unmatched,
    "features_native": _some(*NATIVE),
    "feature_lcs": _some("name_lev_ratio", "name_token_sort", "stripped_tsr"),
    "feature_jaro_winkler": _some("name_jw_dist", "stripped_jw"),
    "feature_token_set": _some("name_token_set"),
    "feature_partial": _some("name_partial_ratio"),
    "heuristic_score": _heuristic,
    "threshold_filter": lambda s, d: S.threshold_filter(_scored(s, d), 0.5).select("s1_id", "cand_id", "score"),
    "cap_per_source": lambda s, d: _results(s, d, 0.3),
    "cap_interleaved": lambda s, d: S.apply_threshold_and_cap(_scored(s, d), _prepared(s, d, docs_as_business)[0], 0.3),
    "matching_results": _resolved,
    "matching_results_docs": _docs_resolved,
    "explode_candidates": lambda s, d: P.explode_candidates(_lists(s, d)),
    "pair_distinct": _distinct,
    "semi_reduce": _semi,
    "rescore": _rescored,
    "macro_f05": lambda s, d: _rounded(E.macro_f05(_counts(s, d))),
    "eval_detailed": lambda s, d: _rounded(E.evaluate_detailed(_counts(s, d))),
    "threshold_sweep": _sweep,
    "score_distribution": lambda s, d: _rounded(E.score_distribution(_scored(s, d))),
    "match_histogram": lambda s, d: E.match_histogram(_results(s, d)),
    "result_summary": lambda s, d: _rounded(E.result_summary(_results(s, d))),
    "run_summary": lambda s, d: run_summary(_results(s, d)),
    "training_positives": _positives,
    "training_negatives": _negatives,
    "parse_truth": _truth_lists,
    "best_threshold": _best_threshold,
    "feature_dataset": _feature_dataset,
    "classifier_scores": _classifier,
    "tsv_round_trip": _tsv,
    "candidate_file_round_trip": _list_file,
}

# ---- the same in SQL ----

_Q = lambda text: "'" + text.replace("'", "''") + "'"
_PARTS = """parts AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id,
 p_name || CASE (p_partkey // 3) % 6 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' LLC' WHEN 2 THEN ' & Co., Inc.' WHEN 3 THEN ' GmbH' WHEN 4 THEN ' SARL' ELSE '' END AS business_name,
 (p_partkey % 997 + 100) || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') || CASE WHEN p_partkey % 2 = 0 THEN ' St' ELSE ' Road' END AS business_address,
 CASE WHEN p_partkey % 50 = 7 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Only1' ELSE 'Only23' END
  ELSE CASE (p_partkey // 18) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' ELSE 'UK' END END AS country,
 CAST(p_partkey % 3 + 1 AS INTEGER) AS source, p_partkey AS row_idx FROM part)"""
_DOCS = """docs AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:4], ' ') AS business_name, array_to_string(w[5:], ' ') AS business_address,
 lang AS country, CAST(doc_id % 3 + 1 AS INTEGER) AS source, doc_id AS row_idx, md5(text) AS mark
 FROM (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents))"""


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(translate(lower({c}), {_Q(punctuation)}, '{' ' * len(punctuation)}'), '\s+', ' ', 'g'))"


def _norm(c: str) -> str:
    cases = " ".join(f"WHEN {_Q(k)} THEN {_Q(v)}" for k, v in T.ABBREVIATIONS.items())
    return f"array_to_string([CASE w {cases} ELSE w END FOR w IN string_split({c}, ' ')], ' ')"


def _stripped(c: str) -> str:
    for _ in range(T.STRIP_PASSES):
        c = f"trim(regexp_replace({c}, {_Q(T.LEGAL_PATTERN.replace('(?U)', ''))}, ' ', 'g'))"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _numbers(c: str) -> str:
    return rf"array_to_string(regexp_extract_all({c}, '\d+'), ' ')"


def _words(c: str) -> str:
    return f"[w FOR w IN string_split({c}, ' ') IF w <> '']"


def _significant(c: str, least: int) -> str:
    return f"[w FOR w IN string_split({c}, ' ') IF length(w) >= {least} AND w NOT IN ({', '.join(map(_Q, T.STOP_WORDS))})]"


def _prep(table: str) -> str:
    return f"""cleaned AS (SELECT *, {_clean('business_name')} AS name_clean, {_clean('business_address')} AS addr_clean, {_clean('country')} AS country_clean FROM {table}),
 prep AS (SELECT *, {_norm('name_clean')} AS name_norm, {_norm('addr_clean')} AS addr_norm, {_stripped('name_clean')} AS name_stripped, {_numbers('addr_clean')} AS numbers FROM cleaned)"""


def _keys(name: str = "name_clean", addr: str = "addr_clean") -> str:
    return f"""lists AS (SELECT *, {name} AS n, {_significant(name, 3)} AS ws, {_significant(addr, 4)} AS aw, {_words('numbers')} AS nums FROM prep),
 keyed AS (SELECT *, [k FOR k IN ([
  CASE WHEN length(n) >= 4 THEN 'p4:' || n[1:4] END, CASE WHEN length(n) >= 3 THEN 'p3:' || n[1:3] END, CASE WHEN length(n) BETWEEN 3 AND 25 THEN 'exact:' || n END,
  CASE WHEN len(ws) >= 1 THEN 'w1:' || ws[1] END, CASE WHEN len(ws) >= 2 THEN 'w2:' || ws[2] END, CASE WHEN len(ws) >= 3 THEN 'wlast:' || ws[-1] END]
  || ['num:' || x FOR x IN nums IF length(x) >= 4]
  || [CASE WHEN len(nums) > 0 AND len(aw) > 0 THEN 'num_w:' || nums[1] || '_' || aw[1] END, CASE WHEN len(nums) > 0 AND length(n) >= 3 THEN 'num_p3:' || nums[1] || '_' || n[1:3] END,
  CASE WHEN len(aw) > 0 THEN 'aw1:' || aw[1] END, CASE WHEN len(aw) > 1 THEN 'aw2:' || aw[2] END]) IF k IS NOT NULL] AS keys FROM lists),
 posted AS (SELECT entity_id, row_idx, source, country_clean AS country, CAST(unnest(range(len(keys))) AS INTEGER) AS pos, unnest(keys) AS key FROM keyed)"""


def _pairs(block: int) -> str:
    return f"""kept AS (SELECT * FROM posted WHERE source > 1 AND (country, key) NOT IN (SELECT (country, key) FROM posted WHERE source > 1 GROUP BY country, key HAVING count(*) > {block})),
 overlap_counts AS (SELECT q.entity_id AS q_id, t.entity_id AS t_id, q.row_idx AS q_row, t.row_idx AS t_row, count(*) AS overlap, min(q.pos) AS first_pos
  FROM posted q JOIN kept t ON q.country = t.country AND q.key = t.key WHERE q.source = 1 GROUP BY ALL),
 byo AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY overlap DESC, first_pos, t_row) AS o, row_number() OVER (PARTITION BY q_row ORDER BY first_pos, t_row) AS f, count(*) OVER (PARTITION BY q_row) AS c FROM overlap_counts),
 found AS (SELECT q_id, t_id, q_row, t_row, overlap, first_pos, CAST(CASE WHEN c > {TOP_K} THEN o ELSE f END AS INTEGER) AS rank FROM byo WHERE o <= {TOP_K})"""


_P = f"WITH {_PARTS}"
_D = f"WITH {_DOCS}"
_T = f"WITH cleaned AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, {_clean('text')} AS clean FROM documents)"
_PP = f"{_P}, {_prep('parts')}"
_DD = f"{_D}, {_prep('docs')}"
_PK = f"{_PP}, {_keys()}"
_DF = f"{_DD}, {_keys()}, {_pairs(BLOCK)}"
_PF = f"{_PK}, {_pairs(BLOCK)}"
_LISTS = "lists_out AS (SELECT p.entity_id AS source1_entity_id, coalesce(l.ids, '') AS candidate_entity_ids FROM prep p LEFT JOIN (SELECT q_id, string_agg(t_id, ',' ORDER BY rank) AS ids FROM found GROUP BY q_id) l ON p.entity_id = l.q_id WHERE p.source = 1)"
_SC = f"{_DF}, scored AS (SELECT q_id AS s1_id, t_id AS cand_id, rank, round(overlap / (overlap + 2), 6) AS score FROM found)"


def _capped(threshold: float) -> str:
    return f"""placed AS (SELECT *, CASE WHEN cand_id LIKE 'S2-%' THEN 0 ELSE 1 END AS src, row_number() OVER (PARTITION BY s1_id, substr(cand_id, 1, 3) ORDER BY score DESC, rank, cand_id) AS nth FROM scored WHERE score >= {threshold}),
 capped AS (SELECT * FROM placed WHERE nth <= CASE WHEN src = 0 THEN 5 ELSE 6 END)"""


def _matched(order: str) -> str:
    return f"results AS (SELECT p.entity_id AS source1_entity_id, coalesce(l.ids, '') AS matched_entity_ids FROM prep p LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY {order}) AS ids FROM capped GROUP BY s1_id) l ON p.entity_id = l.s1_id WHERE p.source = 1)"


_TRUTH = "truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM docs a JOIN docs b ON a.mark = b.mark WHERE a.source = 1 AND b.source > 1), entities AS (SELECT entity_id AS s1_id FROM docs WHERE source = 1)"


def _measured(pred: str) -> str:
    return f"""counted AS (SELECT e.s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = e.s1_id) AS nt, (SELECT count(*) FROM {pred} c WHERE c.s1_id = e.s1_id) AS np,
  (SELECT count(*) FROM {pred} c JOIN truth t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id WHERE c.s1_id = e.s1_id) AS tp FROM entities e),
 measured AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS r,
  CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END AS f FROM counted)"""


_EV = f"{_SC}, {_capped(0.5)}, {_TRUTH}, {_measured('capped')}"
_RES = f"{_SC}, {_capped(0.5)}, {_matched('src, nth')}"
_SIZES = "sizes AS (SELECT len([x FOR x IN string_split(matched_entity_ids, ',') IF x <> '']) AS n, len([x FOR x IN string_split(matched_entity_ids, ',') IF x LIKE 'S2-%']) AS a, len([x FOR x IN string_split(matched_entity_ids, ',') IF x LIKE 'S3-%']) AS b FROM results)"
_BOTH = f"{_PF}, sides AS (SELECT f.q_id AS s1_id, f.t_id AS cand_id, q.name_norm AS n1, t.name_norm AS n2, q.name_stripped AS s1, t.name_stripped AS s2, q.addr_norm AS a1, t.addr_norm AS a2, q.numbers AS z1, t.numbers AS z2 FROM found f JOIN prep q ON f.q_id = q.entity_id JOIN prep t ON f.t_id = t.entity_id)"


def _set(c: str) -> str:
    return f"list_distinct({_words(c)})"


def _grams(c: str) -> str:
    return f"list_distinct([substr({c}, i, 3) FOR i IN range(1, length({c}) - 1)])"


def _lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence, by rows of the usual table."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0])"
    return f"list_reduce([[x] FOR x IN range(1, length({a}) + 1)], lambda prev, ii: {row.replace('substr(' + a + ', i, 1)', 'substr(' + a + ', ii[1], 1)')}, [0 FOR x IN range(0, length({b}) + 1)])[-1]"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE round(200.0 * {_lcs(a, b)} / (length({a}) + length({b})), 6) END"


def _sorted(c: str) -> str:
    return f"array_to_string(list_sort({_words(c)}), ' ')"


_LCS_SIDES = f"{_BOTH}, lcs_in AS (SELECT DISTINCT n1 AS x, n2 AS y FROM sides UNION SELECT DISTINCT {_sorted('n1')}, {_sorted('n2')} FROM sides UNION SELECT DISTINCT {_sorted('s1')}, {_sorted('s2')} FROM sides), rates AS (SELECT x, y, {_rate('x', 'y')} AS v FROM lcs_in)"
_SET_SIDES = f"""{_BOTH}, pieces AS (SELECT s1_id, cand_id, array_to_string(list_sort(list_intersect({_set('n1')}, {_set('n2')})), ' ') AS i,
 array_to_string(list_sort([w FOR w IN {_set('n1')} IF NOT list_contains({_set('n2')}, w)]), ' ') AS x, array_to_string(list_sort([w FOR w IN {_set('n2')} IF NOT list_contains({_set('n1')}, w)]), ' ') AS y, n1, n2 FROM sides),
 lcs_in AS (SELECT DISTINCT x, y FROM pieces WHERE x <> '' AND y <> ''), rates AS (SELECT x, y, {_lcs('x', 'y')} AS v FROM lcs_in)"""

ORACLE_SQL: dict[str, str] = {
    "records_parts": f"{_P} SELECT * FROM parts",
    "records_docs": f"{_D} SELECT entity_id, business_name, business_address, country, source, row_idx FROM docs",
    "clean_text": f"{_T} SELECT entity_id, clean FROM cleaned",
    "normalize_abbreviations": f"{_PP} SELECT entity_id, addr_norm AS norm FROM prep",
    "strip_legal_suffixes": f"{_PP} SELECT entity_id, name_stripped AS stripped FROM prep",
    "extract_numbers": f"{_PP} SELECT entity_id, numbers FROM prep",
    "normalize_ampersand": rf"{_P} SELECT entity_id, trim(regexp_replace(business_name, '\s*&\s*', ' and ', 'g')) AS amp FROM parts",
    "normalize_name": f"{_PP} SELECT entity_id, CASE WHEN name_stripped <> '' THEN name_stripped ELSE name_clean END AS name FROM prep",
    "tokens": f"{_T} SELECT entity_id, CAST(len({_words('clean')}) AS INTEGER) AS n_tokens, coalesce({_words('clean')}[1], '') AS first FROM cleaned",
    "significant_words": f"{_T} SELECT entity_id, array_to_string({_significant('clean', 3)}, ' ') AS words FROM cleaned",
    "preprocess": f"{_PP} SELECT entity_id, business_name, business_address, country, name_clean AS business_name_clean, name_norm AS business_name_norm, name_stripped AS business_name_stripped, addr_clean AS business_address_clean, addr_norm AS business_address_norm, numbers AS address_numbers, country_clean FROM prep",
    "blocking_keys": f"{_PK} SELECT entity_id, pos, key FROM posted",
    "block_sizes": f"{_PK} SELECT country, key, count(*) AS size FROM posted WHERE source > 1 GROUP BY ALL",
    "hot_keys_pruned": f"{_PF} SELECT entity_id, country, key FROM kept",
    "pair_overlap": f"{_PF} SELECT q_id, t_id, overlap, first_pos FROM overlap_counts",
    "candidates_topk": f"{_PF} SELECT q_id, t_id, overlap, rank FROM found",
    "candidates_docs": f"{_DF} SELECT q_id, t_id, overlap, rank FROM found",
    "candidate_lists": f"{_DF}, {_LISTS} SELECT * FROM lists_out",
    "generate_candidates": f"{_DD}, {_keys('name_norm', 'addr_norm')}, {_pairs(BLOCK)}, {_LISTS} SELECT * FROM lists_out",
    "country_only_singletons": f"{_PP} SELECT entity_id, country_clean FROM prep WHERE source = 1 AND country_clean NOT IN (SELECT country_clean FROM prep WHERE source > 1)",
    "features_native": f"""{_BOTH} SELECT s1_id, cand_id, CAST(CASE WHEN s1 <> '' AND s1 = s2 THEN 1 ELSE 0 END AS DOUBLE) AS stripped_exact, CAST(CASE WHEN {_words('s1')}[1] = {_words('s2')}[1] THEN 1 ELSE 0 END AS DOUBLE) AS first_token_match,
 CASE WHEN s1 <> '' AND s2 <> '' THEN round(len(list_intersect({_set('s1')}, {_set('s2')})) / least(len({_set('s1')}), len({_set('s2')})), 6) ELSE 0.0 END AS common_token_frac,
 CASE WHEN n1 = '' AND n2 = '' THEN 0.0 ELSE round(least(len({_words('n1')}), len({_words('n2')})) / greatest(len({_words('n1')}), len({_words('n2')})), 6) END AS name_length_ratio,
 CASE WHEN n1 = '' AND n2 = '' THEN 1.0 ELSE round(least(length(n1), length(n2)) / greatest(length(n1), length(n2)), 6) END AS name_char_ratio,
 CAST(len(list_intersect({_set('n1')}, {_set('n2')})) AS DOUBLE) AS name_token_overlap,
 CASE WHEN a1 <> '' AND a2 <> '' THEN round(100.0 * len(list_intersect({_set('a1')}, {_set('a2')})) / len(list_distinct(list_concat({_set('a1')}, {_set('a2')}))), 6) ELSE 0.0 END AS addr_jaccard,
 CASE WHEN a1 = '' OR a2 = '' THEN 0.0 WHEN length(a1) < 3 OR length(a2) < 3 THEN CASE WHEN a1 = a2 THEN 100.0 ELSE 0.0 END ELSE round(100.0 * (len(list_intersect({_grams('a1')}, {_grams('a2')})) / (sqrt(len({_grams('a1')})) * sqrt(len({_grams('a2')})))), 6) END AS addr_ngram_sim,
 CAST(CASE WHEN z1 <> '' AND z1 = z2 THEN 1 ELSE 0 END AS DOUBLE) AS zip_exact,
 CASE WHEN z1 <> '' AND z2 <> '' THEN round(len(list_intersect({_set('z1')}, {_set('z2')})) / len(list_distinct(list_concat({_set('z1')}, {_set('z2')}))), 6) ELSE 0.0 END AS nums_overlap FROM sides""",
    "feature_lcs": f"{_LCS_SIDES} SELECT s1_id, cand_id, a.v AS name_lev_ratio, b.v AS name_token_sort, c.v AS stripped_tsr FROM sides JOIN rates a ON a.x = n1 AND a.y = n2 JOIN rates b ON b.x = {_sorted('n1')} AND b.y = {_sorted('n2')} JOIN rates c ON c.x = {_sorted('s1')} AND c.y = {_sorted('s2')}",
    "feature_jaro_winkler": f"{_BOTH} SELECT s1_id, cand_id, round(100.0 * jaro_winkler_similarity(n1, n2), 6) AS name_jw_dist, CASE WHEN s1 = s2 THEN 100.0 ELSE round(100.0 * jaro_winkler_similarity(s1, s2), 6) END AS stripped_jw FROM sides",
    "feature_token_set": f"""{_SET_SIDES} SELECT s1_id, cand_id, round(CASE WHEN n1 = '' OR n2 = '' THEN 0.0 WHEN i <> '' AND (p.x = '' OR p.y = '') THEN 100.0
 WHEN i = '' THEN 200.0 * v / (length(p.x) + length(p.y))
 ELSE greatest(200.0 * (length(i) + 1 + v) / (2 * length(i) + 2 + length(p.x) + length(p.y)), 200.0 * length(i) / (2 * length(i) + 1 + length(p.x)), 200.0 * length(i) / (2 * length(i) + 1 + length(p.y))) END, 6) AS name_token_set
 FROM pieces p LEFT JOIN rates r ON p.x = r.x AND p.y = r.y""",
    "threshold_filter": f"{_SC} SELECT s1_id, cand_id, score FROM scored WHERE score >= 0.5",
    "cap_per_source": f"{_SC}, {_capped(0.3)}, {_matched('src, nth')} SELECT * FROM results",
    "cap_interleaved": f"{_SC}, {_capped(0.3)}, {_matched('score DESC, rank, cand_id')} SELECT * FROM results",
    "explode_candidates": f"{_DF} SELECT q_id AS s1_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY rank) - 1 AS INTEGER) AS rank, t_id AS cand_id FROM found",
    "pair_distinct": f"{_DF} SELECT q_id AS s1_id, t_id AS cand_id FROM found",
    "semi_reduce": f"{_DF} SELECT q_id AS s1_id, t_id AS cand_id FROM found",
    "macro_f05": f"{_EV} SELECT round(avg(f), 6) AS macro_f05 FROM measured",
    "eval_detailed": f"""{_EV} SELECT round(avg(f), 6) AS macro_f05, coalesce(round(avg(p) FILTER (nt > 0), 6), 0.0) AS mean_precision, coalesce(round(avg(r) FILTER (nt > 0), 6), 0.0) AS mean_recall,
 coalesce(round(avg(CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END) FILTER (nt = 0), 6), 1.0) AS singleton_accuracy, count(*) FILTER (nt = 0) AS singleton_total, count(*) FILTER (nt = 0 AND np = 0) AS singleton_correct,
 coalesce(round(avg(f) FILTER (nt > 0), 6), 0.0) AS non_singleton_f05, count(*) AS total_entities, count(*) FILTER (np > 0) AS entities_with_predictions, CAST(sum(np) AS BIGINT) AS total_predicted_matches, round(avg(np), 6) AS avg_predictions_per_entity FROM measured""",
    "threshold_sweep": " UNION ALL ".join(f"SELECT * FROM ({_SC}, {_capped(t)}, {_TRUTH}, {_measured('capped')} SELECT CAST({t} AS DOUBLE) AS threshold, round(avg(f), 6) AS macro_f05 FROM measured)" for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "score_distribution": f"{_SC} SELECT count(*) AS n, min(score) AS min, round(quantile_cont(score, 0.5), 6) AS median, round(avg(score), 6) AS mean, max(score) AS max, " + ", ".join(f"count(*) FILTER (score >= {c}) AS ge_{round(100 * c):03d}" for c in E.CUTS) + " FROM scored",
    "match_histogram": f"{_RES}, {_SIZES} SELECT CAST(n AS INTEGER) AS n, count(*) AS entities FROM sizes GROUP BY ALL",
    "result_summary": f"""{_RES}, {_SIZES} SELECT count(*) AS total_entities, count(*) FILTER (n = 0) AS singletons, count(*) FILTER (n > 0) AS matched_entities, CAST(sum(n) AS BIGINT) AS total_matches, round(avg(n), 6) AS avg_matches, CAST(max(n) AS INTEGER) AS max_matches,
 count(*) FILTER (a > 0) AS with_s2, round(avg(a), 6) AS avg_s2, CAST(max(a) AS INTEGER) AS max_s2, count(*) FILTER (b > 0) AS with_s3, round(avg(b), 6) AS avg_s3, CAST(max(b) AS INTEGER) AS max_s3 FROM sizes""",
    "run_summary": f"{_RES} SELECT count(*) AS processed, count(*) FILTER (matched_entity_ids <> '') AS matched_entities, count(*) FILTER (matched_entity_ids = '') AS singletons, round(100 * avg(CASE WHEN matched_entity_ids <> '' THEN 1.0 ELSE 0.0 END), 6) AS matched_percent FROM results",
    "training_positives": f"{_D}, {_TRUTH}, few AS (SELECT entity_id FROM docs WHERE source = 1 ORDER BY row_idx LIMIT {ENTITIES}) SELECT s1_id, cand_id FROM truth WHERE s1_id IN (SELECT entity_id FROM few)",
    "parse_truth": f"{_DF} SELECT p.entity_id AS s1_id, t_id AS match_id FROM prep p LEFT JOIN found ON q_id = p.entity_id WHERE p.source = 1",
    "best_threshold": "SELECT threshold, macro_f05 FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_SC}, {_capped(t)}, {_TRUTH}, {_measured('capped')} SELECT CAST({t} AS DOUBLE) AS threshold, round(avg(f), 6) AS macro_f05 FROM measured)" for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) + ") ORDER BY macro_f05 DESC, threshold LIMIT 1",
    "feature_dataset": f"""{_DF}, sides AS (SELECT f.q_id AS s1_id, f.t_id AS cand_id, q.name_stripped AS s1, t.name_stripped AS s2, q.addr_norm AS a1, t.addr_norm AS a2, q.numbers AS z1, t.numbers AS z2 FROM found f JOIN prep q ON f.q_id = q.entity_id JOIN prep t ON f.t_id = t.entity_id)
 SELECT s1_id, cand_id, CAST(CASE WHEN s1 <> '' AND s1 = s2 THEN 1 ELSE 0 END AS DOUBLE) AS stripped_exact,
 CASE WHEN a1 <> '' AND a2 <> '' THEN round(100.0 * len(list_intersect({_set('a1')}, {_set('a2')})) / len(list_distinct(list_concat({_set('a1')}, {_set('a2')}))), 6) ELSE 0.0 END AS addr_jaccard,
 CASE WHEN z1 <> '' AND z2 <> '' THEN round(len(list_intersect({_set('z1')}, {_set('z2')})) / len(list_distinct(list_concat({_set('z1')}, {_set('z2')}))), 6) ELSE 0.0 END AS nums_overlap FROM sides""",
    "tsv_round_trip": f"{_D} SELECT entity_id, business_name, business_address, country FROM docs",
    "candidate_file_round_trip": f"{_DF}, {_LISTS} SELECT * FROM lists_out",
}
