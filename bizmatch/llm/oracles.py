"""The SQL of those queries that DuckDB can express."""

from __future__ import annotations

from .licenses import CUES, HEADER, LICENCE_FILES, TEMPLATES, WHOLE, template_weights

_COMPONENTS = """reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 component AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ngram_components_sql(words: int, percent: int) -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {words - 1}], ' ') FOR i IN range(1, len(w) - {words - 2})]) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s),
 t AS (SELECT doc_id, unnest(s) AS t FROM s),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
 {_COMPONENTS}
 SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id FROM n LEFT JOIN component c ON c.id = n.doc_id"""


def vector_duplicates_sql(cosine: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {cosine}),
 counts AS (SELECT a, count(*) AS n FROM link GROUP BY a),
 {_COMPONENTS}
 SELECT v.vec_id, coalesce(counts.n, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
 FROM v LEFT JOIN counts ON counts.a = v.vec_id LEFT JOIN component c ON c.id = v.vec_id"""


def license_scan_sql(path: str) -> str:
    rows, idf, other = template_weights()
    cue = lambda c: "(" + " OR ".join(f"contains(lower({c}), {_text(x)})" for x in CUES) + ")"
    values = lambda table: ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else repr(x) for x in r) + ")" for r in table)
    weights, idfs = values([(k, w, float(x)) for k, w, x in rows]), values(sorted(idf.items()))
    return rf"""WITH weight(template, word, weight) AS (SELECT * FROM (VALUES {weights})), idfs(word, idf) AS (SELECT * FROM (VALUES {idfs})),
 names(template, license) AS (SELECT * FROM (VALUES {values([(k, x[0]) for k, x in enumerate(TEMPLATES)])})),
 f AS (SELECT doc_id, {path} AS path, text FROM documents),
 cued AS (SELECT * FROM f WHERE {cue('text')}),
 lines AS (SELECT doc_id, text, trim(l) AS notice FROM (SELECT doc_id, text, unnest(string_split_regex(text, '[\n\r]+')) AS l FROM cued) WHERE {cue('l')}),
 seg AS (SELECT DISTINCT 'line' AS kind, notice AS t FROM lines UNION SELECT DISTINCT 'text', text FROM cued),
 words AS (SELECT kind, t, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS word FROM seg),
 counts AS (SELECT kind, t, word, count(*) * coalesce(any_value(idf), CAST({other!r} AS DOUBLE)) AS w FROM words LEFT JOIN idfs USING (word) GROUP BY kind, t, word),
 norms AS (SELECT kind, t, sqrt(sum(w * w)) AS norm FROM counts GROUP BY ALL),
 scored AS (SELECT kind, t, template, round(sum(w * weight) / any_value(norm), 6) AS score FROM counts JOIN weight USING (word) JOIN norms USING (kind, t) GROUP BY kind, t, template),
 best AS (SELECT kind, t, license, score FROM (SELECT *, row_number() OVER (PARTITION BY kind, t ORDER BY score DESC, template) AS o FROM scored WHERE score >= CASE kind WHEN 'line' THEN {HEADER} ELSE {WHOLE} END) JOIN names USING (template) WHERE o = 1),
 own AS (SELECT doc_id, license, score FROM (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license DESC) AS o FROM lines JOIN best ON kind = 'line' AND t = notice) WHERE o = 1),
 found AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS folder, w.license IS NOT NULL OR (own.license IS NOT NULL AND regexp_extract(lower(regexp_extract(f.path, '([^/]*)$', 1)), '^([a-z]+)', 1) IN ({', '.join(map(_text, LICENCE_FILES))})) AS is_file,
  coalesce(w.license, own.license) AS license, coalesce(w.score, own.score) AS score FROM f LEFT JOIN own USING (doc_id) LEFT JOIN best w ON w.kind = 'text' AND w.t = f.text),
 dirs AS (SELECT folder AS above, license, score FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, license DESC) AS o FROM found WHERE is_file) WHERE o = 1),
 steps AS (SELECT DISTINCT folder, unnest([array_to_string(string_split(folder, '/')[1:k], '/') FOR k IN range(0, len(string_split(folder, '/')) + 1)]) AS above FROM found WHERE license IS NULL),
 heirs AS (SELECT folder, license, score FROM (SELECT folder, license, score, row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) AS o FROM steps JOIN dirs USING (above)) WHERE o = 1)
 SELECT doc_id, path, coalesce(x.license, h.license) AS license, CASE WHEN is_file THEN 'file' WHEN x.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, coalesce(x.score, h.score) AS score
 FROM found x LEFT JOIN heirs h ON x.folder = h.folder AND x.license IS NULL"""
