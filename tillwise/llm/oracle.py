"""SQL twins (DuckDB) of the queries that SQL can express."""

_KEPT_PARTS = """
parts AS ({parts}),
full_parts AS (SELECT doc_id, i, regexp_replace(u, '^\\s+|\\s+$', '', 'g') AS s FROM parts WHERE regexp_replace(u, '^\\s+|\\s+$', '', 'g') != ''),
runs AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS body
  FROM full_parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
long_runs AS (SELECT * FROM runs WHERE b IS NOT NULL{least}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM long_runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE nth > 1),
kept AS (
  SELECT p.doc_id, p.i, p.u, g.i IS NOT NULL AS out FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
)
SELECT d.doc_id, count(k.i) AS {total}, count(k.i) FILTER (k.out) AS n_removed,
       CASE WHEN count(k.i) FILTER (k.out) > 0 THEN coalesce(string_agg(k.u, '{joiner}' ORDER BY k.i) FILTER (NOT k.out), '') ELSE any_value(d.text) END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL"
OP9 = "WITH " + _KEPT_PARTS.format(parts=_LINES, least="", total="n_lines", joiner="\n")

_STOPS = ".!?,;:\n。！？、，；：।॥؟،؛۔…"
_PATTERN = f"[^{_STOPS}]*[{_STOPS}]+|[^{_STOPS}]+"
_SPACELESS = r"\x{0E01}-\x{0EFF}\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_WORD = rf"[{_SPACELESS}]|[^ \t\n\x0B\f\r{_SPACELESS}]+"

OP1 = f"""
WITH parts AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERN}')) AS u,
         generate_subscripts(regexp_extract_all(text, '{_PATTERN}'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
),
full_parts AS (SELECT doc_id, i, regexp_replace(u, '^\\s+|\\s+$', '', 'g') AS s FROM parts WHERE regexp_replace(u, '^\\s+|\\s+$', '', 'g') != ''),
runs AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS body
  FROM full_parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
whole_runs AS (SELECT doc_id, a, b, min(doc_id) OVER (PARTITION BY body) AS first_doc FROM runs WHERE b IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM whole_runs WHERE doc_id != first_doc),
islands AS (SELECT p.*, p.i - row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) AS island FROM parts p JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i),
sized AS (SELECT doc_id, i, sum(len(regexp_extract_all(u, '{_WORD}'))) OVER (PARTITION BY doc_id, island) AS words FROM islands),
kept AS (
  SELECT p.doc_id, p.i, p.u, g.i IS NOT NULL AS out FROM parts p LEFT JOIN (SELECT * FROM sized WHERE words >= 30) g ON p.doc_id = g.doc_id AND p.i = g.i
)
SELECT d.doc_id, count(k.i) AS n_sentences, count(k.i) FILTER (k.out) AS n_removed,
       CASE WHEN count(k.i) FILTER (k.out) > 0 THEN coalesce(string_agg(k.u, '' ORDER BY k.i) FILTER (NOT k.out), '') ELSE any_value(d.text) END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""

OP2 = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_spans AS (SELECT item_id, w, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0),
item_windows AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item_spans)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.body = t.body),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""

ORACLE = {"op1_substring_dedup": OP1, "op2_decontaminate": OP2, "op9_line_dedup": OP9}
