"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from molsift.llm.quality_rules import MEASURES

# The separators and words of the contracts, as RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), '17')), 1, 8)) AS BIGINT) >> 1 AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER r AS k, sum(3 * size) OVER r AS c, sum(w) OVER r AS cw, sum(size) OVER () AS t, sum(w) OVER () AS tw FROM s
  WINDOW r AS (ORDER BY 3.0 * size / w, source NULLS LAST)),
levels AS (SELECT 0 AS k, CAST(max(t) AS DOUBLE) / CAST(max(tw) AS DOUBLE) AS level FROM o UNION ALL SELECT k, CAST(t - c AS DOUBLE) / CAST(tw - cw AS DOUBLE) FROM o WHERE tw > cw),
best AS (SELECT level FROM levels l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = l.k + 1 AND 3 * o.size < l.level * o.w) ORDER BY k LIMIT 1),
p AS (SELECT source, size AS source_size, least(level * w, CAST(3 * size AS DOUBLE)) AS target FROM s, best),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p),
x AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.epochs, CAST(floor(q.target) AS BIGINT) - q.epochs * q.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x"""

OP7 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

OP9 = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM t),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.b, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = t.doc_id"""


def _op10() -> str:
    """Base counts, quartiles of bucketed measures per language and source, and fences."""
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS m, {m} AS v, base_failed FROM e" for m in MEASURES)
    high = " ".join(f"WHEN '{m}' THEN {s[0]}" for m, s in MEASURES.items())
    low = " ".join(f"WHEN '{m}' THEN {s[1]}" for m, s in MEASURES.items() if s[1] is not None)

    def fence(name, *by):
        keys = "".join(f"{c}, " for c in by)
        part = ", ".join([*by, "m"])
        return f"""{name} AS (SELECT {keys}m, max(al) AS docs, min(CASE WHEN c * 4 >= al THEN b END) AS q1, min(CASE WHEN c * 4 >= al * 3 THEN b END) AS q3
 FROM (SELECT {keys}m, b, sum(n) OVER (PARTITION BY {part} ORDER BY b ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY {part}) AS al
 FROM (SELECT {keys}m, b, sum(n) AS n FROM h GROUP BY {part}, b)) GROUP BY {part})"""

    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win), (VALUES (0), (1), (2)) o(j) WHERE k > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 CAST(length(regexp_replace(x, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper, coalesce(ln.n, 0) AS n_lines
 FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id LEFT JOIN ln ON ln.doc_id = t.doc_id),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbols_pm,
 coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines_pm, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats_pm,
 coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS upper_pm, coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_len FROM c),
v AS ({values}),
h AS (SELECT lang, source, m, b, count(*) AS n FROM (SELECT lang, source, m, (v >> s) << s AS b FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS s FROM v WHERE NOT base_failed)) GROUP BY 1, 2, 3, 4),
{fence("f0", "lang", "source")}, {fence("f1", "lang")}, {fence("f2")},
f AS (SELECT f0.lang, f0.source, f0.m, CASE WHEN f0.docs >= 200 THEN f0.q1 WHEN f1.docs >= 200 THEN f1.q1 ELSE f2.q1 END AS q1,
 CASE WHEN f0.docs >= 200 THEN f0.q3 WHEN f1.docs >= 200 THEN f1.q3 ELSE f2.q3 END AS q3
 FROM f0 JOIN f1 ON f0.lang IS NOT DISTINCT FROM f1.lang AND f0.m = f1.m JOIN f2 ON f0.m = f2.m),
k AS (SELECT v.doc_id, sum(CASE WHEN v.v > q3 + 3 * (q3 - q1) + CASE v.m {high} END OR v.v < q1 - 3 * (q3 - q1) - CASE v.m {low} END THEN 1 ELSE 0 END) AS n_outside
 FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.m = f.m GROUP BY v.doc_id)
SELECT e.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_outside = 0 AS kept, CAST(n_outside AS INT) AS n_outside
FROM e JOIN k ON k.doc_id = e.doc_id"""


OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = v.label AS same, v.r, v.vec_id, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INT) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id, s.r) <= 5"""


ORACLES = {"op3_mix_sources": OP3, "op7_warc": OP7, "op9_ngram_join": OP9, "op10_quality_rules": _op10(), "op13_hard_negatives": OP13}
