"""SQL twins of the data queries."""

from __future__ import annotations

from tillwise.plans.oracle_analytics import AS_OF, DAY, ITEMS, LINE_ID, OBS, RECEIPTS

AMOUNT = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{2})"
INBOX = """inbox AS (
  SELECT '/inbox/' || lang || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ['.pdf', '.JPG', '.png', '.txt', '.heic', '.docx'][doc_id % 6 + 1] AS path,
    'sha256:' || sha256(text) AS fingerprint, lower(['.pdf', '.JPG', '.png', '.txt', '.heic', '.docx'][doc_id % 6 + 1]) AS ext FROM documents),
known AS (SELECT DISTINCT 'sha256:' || sha256(text) AS fingerprint FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def scan(extensions: str) -> str:
    return f"""WITH {INBOX}, wanted AS (SELECT * FROM inbox WHERE ext IN ({extensions})),
first AS (SELECT fingerprint, min(path) AS path FROM wanted GROUP BY 1)
SELECT w.path, w.fingerprint, CASE WHEN f.path = w.path AND w.fingerprint NOT IN (SELECT fingerprint FROM known) THEN 'imported' ELSE 'duplicate' END AS status
FROM wanted w JOIN first f USING (fingerprint)"""


def parse_amount(c: str) -> str:
    """Money text to a number, as in the engine."""
    return f"""try_cast(CASE WHEN contains({c}, ',') AND contains({c}, '.') THEN replace({c}, ',', '')
 WHEN contains({c}, ',') THEN CASE WHEN length(list_last(string_split({c}, ','))) = 2 THEN replace({c}, ',', '.') ELSE replace({c}, ',', '') END ELSE {c} END AS DOUBLE)"""


LINES = """doc AS (SELECT doc_id AS receipt_id, text, CASE WHEN lang = 'es' THEN 'es' WHEN lang = 'en' THEN 'sv' ELSE 'base' END AS loc FROM documents),
raw_lines AS (SELECT receipt_id, loc, trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
lines AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY pos) AS idx FROM raw_lines WHERE line <> '')"""
TOTAL_SCORE = """CASE WHEN contains(lower(line), 'subtotal') OR (loc = 'sv' AND contains(lower(line), 'delsumma')) THEN 0 ELSE
  CASE WHEN (loc = 'base' AND regexp_matches(lower(line), 'grand total|total to pay|amount due'))
    OR (loc = 'sv' AND regexp_matches(lower(line), 'att betala|attbetala')) OR (loc = 'es' AND regexp_matches(lower(line), 'a pagar|importe total')) THEN 5 ELSE 0 END
  + CASE WHEN (loc = 'base' AND regexp_matches(lower(line), 'total|amount|balance|grand')) OR (loc = 'sv' AND regexp_matches(lower(line), 'summa|total|belopp'))
    OR (loc = 'es' AND regexp_matches(lower(line), 'total|importe|saldo')) THEN 3 ELSE 0 END END"""
LOCAL_ORDERS = """WITH l AS (SELECT o_orderdate + CASE WHEN dst THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS t, o_totalprice AS total,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'dining' ELSE 'grocery' END AS category
  FROM (SELECT *, date_diff('hour', o_orderdate, timezone('Europe/Stockholm', timezone('UTC', o_orderdate))) = 2 AS dst FROM orders))"""
ITEM_LINES = LINES.replace("receipt_id, text,", """receipt_id, concat_ws(chr(10), text, 'Brown bread ' || (doc_id % 9 + 1) || ' pcs  ' || (doc_id % 50 + 1) || ',' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')) AS text,""", 1)
READ_WORDS = "orgnr|org nr|tele|kvitto|receipt|moms|vat|summa|att betala|totalt|subtotal|växel|kort|kontant"
STORES = """st AS (
  SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS store_entity_id, s_suppkey, 'Nation ' || n_nationkey AS chain_name, n_nationkey,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS branch_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'High Street ' || (s_suppkey % 7) END AS address,
    CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey % 4 AS VARCHAR), 5, '0') END AS postal_code,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'City ' || n_regionkey END AS city,
    CASE WHEN s_suppkey % 5 = 1 THEN '55' || lpad(CAST(s_suppkey % 25 AS VARCHAR), 4, '0') END AS org_number,
    CASE WHEN s_suppkey % 5 = 2 THEN '070-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS phone,
    CASE WHEN s_suppkey % 3 <> 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 5 IN (1, 2) THEN 1 ELSE 0 END AS filled
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
used AS (SELECT 's' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS store_entity_id, count(DISTINCT l_orderkey) AS receipts FROM lineitem GROUP BY 1),
usage AS (SELECT st.*, coalesce(receipts, 0) AS receipts FROM st LEFT JOIN used USING (store_entity_id)),
kept AS (SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY filled DESC, receipts DESC, s_suppkey DESC) = 1
  AND count(*) OVER (PARTITION BY n_nationkey) > 1),
pairs AS (
  SELECT u.store_entity_id AS from_store, k.store_entity_id AS to_store, k.chain_name AS chain, u.receipts AS from_receipts, k.receipts AS to_receipts,
    u.filled = 0 AS empty,
    coalesce(u.org_number = k.org_number, false) OR coalesce(u.phone = k.phone, false)
      OR coalesce(u.postal_code = k.postal_code AND u.city = k.city, false) AS strict
  FROM usage u JOIN kept k USING (n_nationkey) WHERE u.store_entity_id <> k.store_entity_id),
merges AS (SELECT * FROM pairs WHERE empty OR strict)"""
HINTS = f"""hints AS (
  SELECT {LINE_ID} AS receipt_id, CASE WHEN p_type = 'PROMO' THEN 'other chain' WHEN p_type <> 'SMALL' THEN lower(chain_name) END AS chain,
    CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN address END AS address, CASE WHEN p_type IN ('LARGE', 'ECONOMY') THEN postal_code END AS postal_code,
    CASE WHEN p_type <> 'STANDARD' THEN city END AS city, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN org_number END AS org_number,
    CASE WHEN p_type IN ('PROMO', 'SMALL') THEN phone END AS phone
  FROM lineitem JOIN st ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
probes AS (SELECT DISTINCT chain, address, postal_code, city, org_number, phone FROM hints),
scored AS (
  SELECT p.*, s.store_entity_id, s.branch_name,
    coalesce(p.org_number = s.org_number, false) AS org_hit, coalesce(p.phone = s.phone, false) AS phone_hit,
    coalesce(p.chain = lower(s.chain_name), false) AS chain_hit,
    CASE WHEN p.postal_code = s.postal_code THEN 4 ELSE 0 END + CASE WHEN p.city = s.city THEN 3 ELSE 0 END
      + CASE WHEN p.address IS NULL OR s.address IS NULL THEN 0 ELSE 6 END AS place
  FROM probes p CROSS JOIN st s),
key AS (SELECT *, org_hit::INT * 10 + phone_hit::INT * 8 + chain_hit::INT * 2 + CASE WHEN chain_hit OR org_hit OR phone_hit THEN place ELSE 0 END AS score,
  org_hit::INT * 10 + phone_hit::INT * 8 + place AS history_score FROM scored)"""
# "High Street n Mall" against "High Street m": two of the three words of three letters or more agree, so the overlap is 2/3.
MATCHED = f"""best AS (
  SELECT * FROM key WHERE chain IS NULL OR coalesce(address, postal_code, city, org_number, phone) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chain, address, postal_code, city, org_number, phone ORDER BY score DESC, store_entity_id) = 1),
accepted AS (SELECT * FROM best WHERE score >= 10 OR (score >= 8 AND coalesce(org_number, phone) IS NOT NULL)),
rich AS (SELECT lower(chain_name) AS chain, store_entity_id AS chain_store FROM st QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY filled DESC, s_suppkey DESC) = 1),
matched AS (
  SELECT h.*, coalesce(a.store_entity_id, r.chain_store) AS store_entity_id,
    CASE WHEN a.store_entity_id IS NOT NULL THEN 'hints' WHEN r.chain_store IS NOT NULL THEN 'chain' WHEN h.chain IS NOT NULL THEN 'new' ELSE 'none' END AS match_kind,
    coalesce(a.chain_hit, false) OR (a.store_entity_id IS NULL AND r.chain_store IS NOT NULL) AS learn_alias
  FROM hints h
  LEFT JOIN accepted a ON a.chain IS NOT DISTINCT FROM h.chain AND a.address IS NOT DISTINCT FROM h.address AND a.postal_code IS NOT DISTINCT FROM h.postal_code
    AND a.city IS NOT DISTINCT FROM h.city AND a.org_number IS NOT DISTINCT FROM h.org_number AND a.phone IS NOT DISTINCT FROM h.phone
  LEFT JOIN rich r ON r.chain = h.chain AND coalesce(h.address, h.postal_code, h.city, h.org_number, h.phone) IS NULL)"""
# Dates more than two days ahead are not believed (two-digit years are read as 20yy), which leaves the best-before line.
READ_DAY = f"""CASE WHEN o_orderdate > {AS_OF} + INTERVAL 2 DAY OR (o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '2000-01-01')
  THEN '2001-07-26' ELSE strftime(o_orderdate, '%Y-%m-%d') END"""

ORACLE = {
    "scan_receipt_files": scan("'.pdf', '.jpg', '.png', '.heic'"),
    "scan_inventory_images": scan("'.jpg', '.png', '.heic'"),
    "known_fingerprints": f"WITH {INBOX} SELECT fingerprint FROM known",
    "new_files_only": f"WITH {INBOX} SELECT path FROM inbox WHERE ext IN ('.pdf', '.jpg', '.png', '.heic') AND fingerprint NOT IN (SELECT fingerprint FROM known)",
    "dedupe_by_content": "SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1",
    "ingest_uploads": f"""WITH {INBOX}, up AS (
  SELECT doc_id AS upload_id, CAST(replace(source, 'src', '') AS BIGINT) AS chat_id, lang,
    lang || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.txt' ELSE '.png' END AS filename, strlen(text) AS size, 'sha256:' || sha256(text) AS fingerprint
  FROM documents WHERE CAST(replace(source, 'src', '') AS BIGINT) BETWEEN 1 AND 9 AND strlen(text) <= 26214400),
first AS (SELECT fingerprint, min(upload_id) AS f FROM up GROUP BY 1)
SELECT upload_id, chat_id, filename, size, fingerprint, CASE WHEN f = upload_id AND fingerprint NOT IN (SELECT fingerprint FROM known) THEN 'imported' ELSE 'duplicate' END AS status,
  CASE lang WHEN 'es' THEN 'inventory' ELSE 'receipt' END AS kind, CASE lang WHEN 'de' THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
  CASE lang WHEN 'es' THEN 'caption_keyword' WHEN 'fr' THEN 'caption_keyword' WHEN 'de' THEN 'unknown_extension_default_receipt' ELSE 'pdf_default_receipt' END AS reason,
  CASE lang WHEN 'fr' THEN 'dining' ELSE 'grocery' END AS receipt_category, 'telegram' AS source_type FROM up JOIN first USING (fingerprint)""",
    "classify_upload": """SELECT page_id,
  CASE WHEN regexp_matches(lower(url), 'inventory|fridge|pantry|cupboard|kyl|skafferi') THEN 'inventory' ELSE 'receipt' END AS kind,
  CASE WHEN regexp_matches(lower(url), 'inventory|fridge|pantry|cupboard|kyl|skafferi|receipt|kvitto') OR page_id % 3 = 0 THEN 0.95::DOUBLE ELSE 0.4::DOUBLE END AS confidence,
  CASE WHEN regexp_matches(lower(url), 'inventory|fridge|pantry|cupboard|kyl|skafferi|receipt|kvitto') THEN 'caption_keyword' WHEN page_id % 3 = 0 THEN 'pdf_default_receipt'
    WHEN page_id % 2 = 0 THEN 'no_model_default_receipt' ELSE 'unknown_extension_default_receipt' END AS reason FROM pages""",
    "file_names": "SELECT doc_id, 'Scan ' || doc_id || '.' || upper(lang) AS safe, '.' || lang AS ext, false AS is_pdf FROM documents",
    "load_receipts": f"""WITH r AS (
  SELECT o_orderkey AS receipt_id, o_orderdate, o_totalprice AS total, o_orderpriority AS p, o_orderstatus AS s, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT *, CASE WHEN receipt_id % 10 = 3 THEN 'missing_total' WHEN p = '5-LOW' THEN 'invalid_date' WHEN p = '1-URGENT' AND s = 'F' THEN 'not_allowed_for_category' END AS error,
  CASE p WHEN '1-URGENT' THEN 'dining' WHEN '2-HIGH' THEN 'grocery' ELSE CASE WHEN seg = 'BUILDING' OR s = 'O' THEN 'dining' ELSE 'grocery' END END AS category FROM r)
SELECT receipt_id, CASE WHEN error IS NULL THEN strftime(o_orderdate, {DAY}) END AS purchased_at, CASE WHEN error IS NULL THEN category END AS receipt_category,
  CASE WHEN error IS NULL THEN CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'manual' ELSE 'auto' END END AS receipt_category_source,
  CASE WHEN error IS NULL THEN CASE WHEN p = '2-HIGH' AND s = 'F' THEN 'dairy' ELSE 'unclassified' END END AS subcategory,
  CASE WHEN error IS NULL THEN CASE WHEN p = '2-HIGH' AND s = 'F' THEN 5 ELSE total END END AS sub_total, CASE WHEN error IS NULL THEN 'Milk' END AS items, error FROM e""",
    "load_snapshot": f"""SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, strftime(o_orderdate, {DAY}) AS purchased_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'dining' WHEN '2-HIGH' THEN 'grocery' END AS receipt_category,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'done' END AS extract_status,
  CASE o_orderstatus WHEN 'F' THEN 'dairy' WHEN 'O' THEN 'bakery' END AS subcategory, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS n_rows FROM orders""",
    "parse_model_json": "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props::JSON->>'k' AS INTEGER) END AS k FROM events",
    "low_text_quality": """WITH s AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
n AS (SELECT doc_id, t, length(regexp_replace(t, '\\s', '', 'g')) AS n, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits FROM s)
SELECT doc_id, length(t) < 80 OR n < 80 OR (letters / n < 0.18 AND digits < 20) OR (n - letters - digits) / n > 0.45
  OR (NOT regexp_matches(lower(t), 'total|sek|moms|vat|kvitto|receipt|summa') AND letters / n < 0.25) AS low_quality FROM n""",
    "extract_amounts_documents": f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{AMOUNT}')) AS v, generate_subscripts(regexp_extract_all(text, '{AMOUNT}'), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, i, {parse_amount('v')} AS amount FROM a)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, amount FROM b WHERE amount IS NOT NULL""",
    "extract_total_documents": f"""WITH {LINES}, s AS (SELECT *, {TOTAL_SCORE} AS score FROM lines),
v AS (SELECT receipt_id, idx, score, unnest(regexp_extract_all(line, '{AMOUNT}')) AS v, generate_subscripts(regexp_extract_all(line, '{AMOUNT}'), 1) AS i FROM s),
a AS (SELECT *, {parse_amount('v')} AS amount FROM v),
best AS (SELECT receipt_id, amount FROM a WHERE score > 0 AND amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, idx DESC, i) = 1),
largest AS (SELECT receipt_id, max(amount) AS amount FROM a GROUP BY 1)
SELECT doc.receipt_id, coalesce(best.amount, largest.amount) AS found_total FROM doc LEFT JOIN best USING (receipt_id) LEFT JOIN largest USING (receipt_id)""",
    "extract_items_documents": rf"""WITH {ITEM_LINES}, c AS (
  SELECT receipt_id, idx, lower(line) AS low, regexp_extract(line, '^(.*?)(-?{AMOUNT})\s*$', 1) AS head, regexp_extract(line, '^(.*?)(-?{AMOUNT})\s*$', 2) AS v
  FROM lines WHERE regexp_matches(line, '{AMOUNT}\s*$') AND NOT regexp_matches(lower(line), '^(---|===|\*\*\*)') AND NOT regexp_matches(lower(line), '{READ_WORDS}')),
i AS (SELECT *, regexp_replace(trim(head), '\s\s+', ' ', 'g') AS raw_name, {parse_amount('v')} AS line_total,
  coalesce(nullif(regexp_extract(low, '(\d+(\.\d+)?\s*(st|pcs|pc)\b)', 1), ''), nullif(regexp_extract(low, '(\b\d+\s*st\*)', 1), '')) AS qty_raw FROM c)
SELECT receipt_id, raw_name, line_total, qty_raw FROM i WHERE line_total IS NOT NULL AND length(raw_name) >= 2""",
    "extract_total": "SELECT o_orderkey AS receipt_id, o_totalprice AS found_total FROM orders",
    "extract_date": f"SELECT o_orderkey AS receipt_id, {READ_DAY} AS found_date FROM orders",
    "extract_store": "SELECT o_orderkey AS receipt_id, CASE o_orderstatus WHEN 'F' THEN 'WILLYS Helsingborg' ELSE 'CORNER MARKET' END AS found_store FROM orders",
    "extract_line_items": f"""SELECT {LINE_ID} AS receipt_id, p_name || ' ' || CAST(l_quantity AS INTEGER) || ' pcs' AS raw_name, l_extendedprice AS line_total,
  CAST(l_quantity AS INTEGER) || ' pcs' AS qty_raw FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sanitize_model_fields": """SELECT o_orderkey AS receipt_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Ica Maxi' END AS m_store,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice + 1 <= 50000 THEN round(o_totalprice + 1, 2) END AS m_total, CAST(NULL AS VARCHAR) AS m_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'dining' END AS m_category, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 END AS n_items FROM orders""",
    "extract_receipts": f"""SELECT o_orderkey AS receipt_id,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice + 1 <= 50000 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS total,
  {READ_DAY} AS purchased_at,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Ica Maxi' WHEN o_orderstatus = 'F' THEN 'WILLYS Helsingborg' ELSE 'Corner Market' END AS store_name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus <> 'F' THEN 0 END AS n_items, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Latte' END AS first_item,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'dining' END AS receipt_category_model,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice + 1 <= 50000 THEN 'bar_pub' END AS subcategory_model FROM orders""",
    "intake_receipts": """WITH r AS (SELECT o_orderkey AS receipt_id, o_orderpriority = '1-URGENT' AS model, o_orderstatus AS s, o_totalprice,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice + 1 <= 50000 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS total FROM orders)
SELECT receipt_id, total, CASE WHEN model THEN 'Nation 3' WHEN s = 'F' THEN 'WILLYS Helsingborg' ELSE 'Corner Market' END AS store_name,
  CASE WHEN model AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 3) THEN 'chain' ELSE 'new' END AS match_kind,
  CASE WHEN model THEN 'dining' ELSE 'grocery' END AS receipt_category,
  CASE WHEN model AND o_totalprice + 1 <= 50000 THEN 'bar_pub' WHEN total > 0 THEN 'unclassified' END AS subcategory, true AS has_store FROM r""",
    "clean_line_items": f"""WITH i AS (
  SELECT {LINE_ID} AS line_item_id, p_type, l_extendedprice AS line_total, o_totalprice / 4 AS total,
    CASE p_type WHEN 'LARGE' THEN 'Rabatt total ' || p_name ELSE p_name END AS raw_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT line_item_id, raw_name, line_total, CAST(NULL AS VARCHAR) AS qty_raw FROM i WHERE p_type NOT IN ('PROMO', 'SMALL') AND (p_type = 'LARGE' OR line_total <= total + 1)""",
    "coerce_line_items": f"SELECT {LINE_ID} AS line_item_id, 'Thing' AS raw_name, l_extendedprice AS line_total FROM lineitem WHERE l_returnflag IN ('A', 'N')",
    "names": """SELECT p_partkey, p_name || ' brand ' || replace(p_brand, 'Brand#', '') || ' ' || p_size || 'g strasse x' AS norm_name,
  split_part(p_name, ' ', 1) || ' (Straße)' AS canonical_name, p_name || '-' || lower(p_brand) || ' ' || p_size || 'g (strasse) x' AS store_key FROM part""",
    "alcohol_class": "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Wine' WHEN 'MEDIUM' THEN 'Beer' END AS class FROM part",
    "store_names": """SELECT s_suppkey, 'SUPPLIER ' || CASE WHEN ltrim(replace(s_name, 'Supplier#', ''), '0') = '' THEN '' ELSE ltrim(replace(s_name, 'Supplier#', ''), '0') || ' ' END || (s_nationkey % 10) || ' ab' AS store, true AS needs_help FROM supplier""",
    "store_tags": """SELECT c_custkey, '[Auto] ' || c_name || CASE WHEN c_nationkey > 9 THEN ' @ B' ELSE '' END AS base, CASE WHEN c_nationkey > 9 THEN c_mktsegment END AS store,
  c_name || CASE WHEN c_nationkey > 9 THEN ' @ B' ELSE '' END AS plain, c_name || ' !' AS marked FROM customer""",
    "unit_prices": f"""SELECT {LINE_ID} AS line_item_id, round(CASE WHEN l_linenumber = 1 THEN 2.5 WHEN l_returnflag = 'A' THEN l_extendedprice / (l_quantity / 1000) WHEN l_returnflag = 'N' THEN l_extendedprice / l_quantity END, 6) AS unit_price,
  CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_returnflag = 'A' THEN 'kg' WHEN l_returnflag = 'N' THEN 'pcs' ELSE 'unknown' END AS unit_type FROM lineitem""",
    "parsed_amounts": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice END AS amount,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice < 1000 THEN o_totalprice END AS number FROM orders""",
    "scores": """WITH a AS (SELECT o_orderkey, o_totalprice % 80 AS age FROM orders)
SELECT o_orderkey, round(CASE WHEN age <= 7 THEN 1 WHEN age <= 30 THEN 1 - (age - 7) / 23 * 0.4 WHEN age <= 60 THEN 0.6 - (age - 30) / 30 * 0.6 ELSE 0 END, 6) AS recency,
  round(greatest(0, least(1, 1 - (age + 3 - age) / (age + 20) / 0.25)), 6) AS stability,
  CAST(greatest(0, least(100, round_even(CASE WHEN age / 40 <= 1 THEN age / 40 * 100 ELSE age / 40 END, 0))) AS BIGINT) AS confidence FROM a""",
    "categories": """SELECT c_custkey, CASE WHEN c_nationkey = 20 OR c_nationkey < 5 OR c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'dining' ELSE 'grocery' END AS category,
  CASE WHEN c_nationkey = 20 OR c_nationkey < 5 THEN 'dining' ELSE 'grocery' END AS category_words,
  CAST(NULL AS VARCHAR) AS alias, CASE WHEN c_nationkey = 1 THEN 'dairy' END AS sub_alias FROM customer""",
    "failure_reasons": """SELECT CASE event_type WHEN 'error' THEN 'quota_exceeded' WHEN 'click' THEN 'timed_out' WHEN 'view' THEN 'provider_error' WHEN 'signup' THEN 'parse_failed'
  ELSE 'odd ' || repeat('x', 216) || '...' END AS reason, count(*) AS n FROM events GROUP BY 1""",
    "locale_choice": """SELECT lang, CASE WHEN lang = 'es' AND source = 'src1' THEN 'es-CO' WHEN lang = 'es' THEN 'es-ES' WHEN source = 'src1' THEN 'es-CO' ELSE 'base' END AS locale, count(*) AS n
FROM documents GROUP BY 1, 2""",
    "derive_observations": f"""SELECT l_orderkey AS receipt_id, l_orderkey || '-' || (l_linenumber * 100000000 + l_partkey) AS line_item_id, 'Store ' || (o_custkey % 40) AS store_name,
  strftime(o_orderdate, {DAY}) AS observed_at, l_extendedprice AS pack_price, l_extendedprice / l_quantity AS unit_price, 'pcs' AS unit_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "match_stores": f"WITH {STORES}, {HINTS}, {MATCHED} SELECT receipt_id, store_entity_id, match_kind, learn_alias FROM matched",
    "infer_store_from_history": f"""WITH {STORES}, {HINTS}, best AS (SELECT * FROM key WHERE branch_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chain, address, postal_code, city, org_number, phone ORDER BY history_score DESC, store_entity_id) = 1),
a AS (SELECT * FROM best WHERE history_score >= 10 OR (history_score >= 8 AND coalesce(org_number, phone) IS NOT NULL))
SELECT h.receipt_id AS probe_id, a.branch_name AS store_name, a.history_score AS score FROM hints h JOIN a
  ON a.chain IS NOT DISTINCT FROM h.chain AND a.address IS NOT DISTINCT FROM h.address AND a.postal_code IS NOT DISTINCT FROM h.postal_code
  AND a.city IS NOT DISTINCT FROM h.city AND a.org_number IS NOT DISTINCT FROM h.org_number AND a.phone IS NOT DISTINCT FROM h.phone""",
    "enrich_stores": f"""WITH {STORES}, {HINTS}, {MATCHED}, l AS (
  SELECT store_entity_id, max(CASE WHEN learn_alias THEN upper(chain) END) AS name, arg_min(city, receipt_id) FILTER (city IS NOT NULL) AS city,
    arg_min(org_number, receipt_id) FILTER (org_number IS NOT NULL) AS org_number, arg_min(phone, receipt_id) FILTER (phone IS NOT NULL) AS phone,
    arg_min(address, receipt_id) FILTER (address IS NOT NULL) AS address, arg_min(postal_code, receipt_id) FILTER (postal_code IS NOT NULL) AS postal_code
  FROM matched WHERE match_kind IN ('hints', 'chain') GROUP BY 1)
SELECT store_entity_id, CASE WHEN l.name IS NOT NULL THEN l.name || '|' || st.chain_name ELSE st.chain_name END AS aliases, coalesce(st.city, l.city) AS city,
  coalesce(st.org_number, l.org_number) AS org_number,
  strftime(CASE WHEN l.name IS NOT NULL OR (st.city IS NULL AND l.city IS NOT NULL) OR (st.org_number IS NULL AND l.org_number IS NOT NULL) OR (st.phone IS NULL AND l.phone IS NOT NULL)
    OR (st.address IS NULL AND l.address IS NOT NULL) OR (st.postal_code IS NULL AND l.postal_code IS NOT NULL) THEN {AS_OF}
    ELSE TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(s_suppkey AS INTEGER)) END, {DAY}) AS updated_at
FROM st LEFT JOIN l USING (store_entity_id)""",
    "new_stores": f"""WITH {STORES}, {HINTS}, {MATCHED}, n AS (
  SELECT *, CASE WHEN org_number IS NOT NULL THEN 'o' || org_number WHEN phone IS NOT NULL THEN 'p' || phone
    ELSE 'a' || chain || '|' || coalesce(postal_code, '') || '|' || coalesce(city, '') || '|' || coalesce(address, '') END AS key FROM matched WHERE match_kind = 'new')
SELECT arg_min(CASE WHEN chain = 'other chain' THEN 'Other Chain' ELSE upper(chain) END, receipt_id) AS chain_name,
  arg_min(postal_code, receipt_id) FILTER (postal_code IS NOT NULL) AS postal_code, arg_min(city, receipt_id) FILTER (city IS NOT NULL) AS city,
  arg_min(org_number, receipt_id) FILTER (org_number IS NOT NULL) AS org_number, arg_min(phone, receipt_id) FILTER (phone IS NOT NULL) AS phone FROM n GROUP BY key""",
    "store_usage": f"WITH {STORES} SELECT store_entity_id, CAST(filled AS BIGINT) AS filled, receipts FROM usage",
    "dedupe_stores": f"WITH {STORES} SELECT from_store, to_store, chain, from_receipts, to_receipts FROM merges",
    "dedupe_stores_strict": f"WITH {STORES} SELECT from_store, to_store FROM pairs WHERE strict",
    "dedupe_stores_chain_only": f"WITH {STORES} SELECT from_store, to_store FROM pairs",
    "dedupe_report": f"""WITH {STORES}, refs AS (SELECT DISTINCT coalesce(to_store, store_entity_id) AS s FROM used LEFT JOIN merges ON from_store = store_entity_id),
p AS (SELECT count(*) AS projected FROM st WHERE store_entity_id IN (SELECT s FROM refs))
SELECT (SELECT count(*) FROM st) AS stores_before, (SELECT count(*) FROM merges) AS store_merges,
  (SELECT coalesce(sum(from_receipts), 0)::BIGINT FROM merges) AS receipts_updated, projected AS stores_after_projected,
  (SELECT count(*) FROM st) - projected AS orphans_projected, projected AS stores_after FROM p""",
    "learn_store_alias": """WITH l AS (SELECT n_nationkey, 'Chain ' || arg_max(s_name, s_suppkey) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT lower(replace(n_name, '_', ' ')) AS key, coalesce(c, n_name) AS canonical FROM nation LEFT JOIN l USING (n_nationkey)""",
    "auto_category": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'dining' WHEN o_orderpriority = '2-HIGH' THEN NULL WHEN o_orderstatus = 'F' THEN 'grocery' ELSE 'dining' END AS category,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'manual' ELSE 'auto' END WHEN o_orderpriority = '2-HIGH' THEN NULL
    WHEN o_orderstatus = 'F' THEN 'manual' ELSE 'auto' END AS source FROM orders""",
    "auto_subcategories": """WITH r AS (SELECT o_orderkey, floor(o_totalprice) AS t, o_orderpriority AS p, o_orderstatus AS s FROM orders),
u AS (
  SELECT o_orderkey, 'dairy' AS subcategory, t * 0.75 AS total FROM r WHERE p = '1-URGENT' AND s <> 'O'
  UNION ALL SELECT o_orderkey, 'restaurant', t * 0.25 FROM r WHERE p = '1-URGENT' AND s <> 'F'
  UNION ALL SELECT o_orderkey, 'bakery', t * 0.5 FROM r WHERE p = '2-HIGH' AND s = 'F'
  UNION ALL SELECT o_orderkey, 'unclassified', t * 0.25 FROM r WHERE p = '2-HIGH' AND s = 'F'
  UNION ALL SELECT o_orderkey, 'fast_food', t * 0.25 FROM r WHERE p = '2-HIGH' AND s = 'O'
  UNION ALL SELECT o_orderkey, unnest(['eggs', 'unclassified']), t * 0.5 FROM r WHERE p = '3-MEDIUM'
  UNION ALL SELECT o_orderkey, 'unclassified', t FROM r WHERE p > '4' AND s IN ('F', 'O'))
SELECT o_orderkey, subcategory, CAST(total AS DOUBLE) AS total FROM u""",
    "sanitize_subcategories": """WITH m AS (
  SELECT l_orderkey AS receipt_id, CASE p_type WHEN 'PROMO' THEN 'dairy' WHEN 'SMALL' THEN 'dairy' WHEN 'LARGE' THEN 'eggs' END AS subcategory, floor(l_extendedprice) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT receipt_id, subcategory, sum(total) AS total FROM m WHERE subcategory IS NOT NULL GROUP BY 1, 2),
rest AS (SELECT o_orderkey AS receipt_id, 'unclassified' AS subcategory, floor(any_value(o_totalprice)) - coalesce(sum(k.total), 0) AS total FROM orders LEFT JOIN k ON k.receipt_id = o_orderkey GROUP BY 1)
SELECT receipt_id, subcategory, total FROM (SELECT * FROM k UNION ALL SELECT * FROM rest WHERE total > 0.009)""",
    "apply_receipt_updates": f"""WITH {RECEIPTS}, u AS (SELECT r.*, o_orderstatus = 'F' AS f, o_orderpriority AS p FROM receipts r JOIN orders ON o_orderkey = receipt_id)
SELECT receipt_id, CASE WHEN f AND p = '1-URGENT' THEN 'Willys' ELSE store_name END AS store_name, CASE WHEN f AND p = '1-URGENT' THEN 7 ELSE total END AS total,
  strftime(CASE WHEN f AND p IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN TIMESTAMP '2001-01-02 00:00:00' ELSE purchased_at END, {DAY}) AS purchased_at,
  CASE WHEN f AND p = '2-HIGH' THEN NULL ELSE 'kr' END AS currency,
  CASE WHEN f AND p = '2-HIGH' THEN 'dining' WHEN f AND p <> '5-LOW' THEN 'grocery' ELSE receipt_category END AS receipt_category,
  CASE WHEN f AND p = '2-HIGH' THEN 'manual' ELSE 'auto' END AS receipt_category_source FROM u""",
    "delete_receipts": f"""WITH {OBS}, {ITEMS}, gone AS (SELECT o_orderkey AS receipt_id FROM orders WHERE o_orderstatus = 'P')
SELECT 'receipts' AS table_name, count(*) FILTER (o_orderstatus <> 'P') AS row_count FROM orders
UNION ALL SELECT 'line_items', count(*) FROM items WHERE receipt_id NOT IN (SELECT receipt_id FROM gone)
UNION ALL SELECT 'observations', count(*) FROM obs WHERE receipt_id NOT IN (SELECT receipt_id FROM gone)""",
    "reparse_receipts": """SELECT o_orderkey AS receipt_id, o_totalprice AS total, true AS changed, o_orderpriority = '1-URGENT' AS items_changed FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2002-01-01'""",
    "semantic_duplicates": """WITH t AS (
  SELECT o_orderkey * 2 AS receipt_id, 'pdf' AS class, o_orderdate AS day, o_custkey % 40 AS store, o_totalprice AS total, o_orderdate AS created FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, 'image', o_orderdate, o_custkey % 40, o_totalprice, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderpriority = '1-URGENT'),
k AS (SELECT *, first_value(receipt_id) OVER w AS kept, first_value(class) OVER w AS kept_class FROM t WINDOW w AS (PARTITION BY day, store, round(total, 2) ORDER BY created, receipt_id))
SELECT receipt_id, kept AS kept_receipt_id FROM k WHERE class <> kept_class""",
    "merge_semantic_duplicates": """SELECT o_orderkey * 2 AS receipt_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'read from photo' END AS ocr_text, 'kr' AS currency,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS n_items FROM orders""",
    "extraction_backlog": f"WITH {RECEIPTS} SELECT receipt_id FROM receipts WHERE file_path <> '' AND extract_status IS NULL",
    "image_backlog": "SELECT doc_id AS image_id, CASE lang WHEN 'fr' THEN 'failed' ELSE 'pending' END AS status FROM documents WHERE lang <> 'en'",
    "stuck_receipts": "SELECT o_orderkey AS receipt_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate - INTERVAL 1 DAY <= TIMESTAMP '1999-12-31 23:00:00'",
    "reset_stuck_receipts": """WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN CASE WHEN o_orderdate - INTERVAL 1 DAY <= TIMESTAMP '1999-12-31 23:00:00' THEN 'queued' ELSE 'running' END END AS extract_status FROM orders)
SELECT extract_status, count(*) AS n, count(*) FILTER (extract_status IS DISTINCT FROM 'queued') AS started, count(*) FILTER (extract_status IS DISTINCT FROM 'queued') AS timed FROM s GROUP BY 1""",
    "mark_extract_failed": f"""WITH {RECEIPTS}, f AS (SELECT l_orderkey AS receipt_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT receipt_id, CASE WHEN n IS NOT NULL THEN 'failed' ELSE coalesce(extract_status, 'none') END AS extract_status, coalesce(n, 0) AS extract_attempts,
  CASE WHEN n IS NOT NULL THEN greatest(0, date_diff('millisecond', purchased_at - INTERVAL 1 DAY, {AS_OF})) ELSE extract_duration_ms END AS extract_duration_ms,
  CASE WHEN n IS NOT NULL THEN 'grocery' ELSE receipt_category END AS receipt_category FROM receipts LEFT JOIN f USING (receipt_id)""",
    "export_counts": f"""WITH {RECEIPTS}, {OBS}, {ITEMS}, r AS (SELECT * FROM receipts WHERE purchased_at >= TIMESTAMP '2001-07-01' AND purchased_at < TIMESTAMP '2001-07-11')
SELECT 'receipts' AS table_name, count(*) AS row_count FROM r UNION ALL SELECT 'line_items', count(*) FROM items WHERE receipt_id IN (SELECT receipt_id FROM r)
UNION ALL SELECT 'observations', count(*) FROM obs WHERE receipt_id IN (SELECT receipt_id FROM r) UNION ALL SELECT 'stores', count(DISTINCT store_name) FROM r
UNION ALL SELECT 'products', count(DISTINCT product_id) FROM obs WHERE receipt_id IN (SELECT receipt_id FROM r)
UNION ALL SELECT 'inventory_images', count(*) FROM pages UNION ALL SELECT 'activities', count(*) FROM events""",
    "export_receipts": f"""WITH {RECEIPTS} SELECT receipt_id, strftime(purchased_at, {DAY}) AS purchased_at, strftime(purchased_at, {DAY}) AS created_at, total, store_name, receipt_category,
  receipt_category_source, filename, customer_id, extract_status FROM receipts WHERE receipts.purchased_at >= TIMESTAMP '2001-07-01' AND receipts.purchased_at < TIMESTAMP '2001-07-11'""",
    "in_date_range": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR (o_orderdate >= TIMESTAMP '2000-06-01' AND o_orderdate < TIMESTAMP '2000-07-01')",
    "stream_ingest_files": "SELECT DISTINCT 'sha256:' || sha256(text) AS fingerprint FROM documents",
    "stream_spend_by_week": f"""{LOCAL_ORDERS}
SELECT strftime(date_trunc('week', t), {DAY}) AS week_start, category, round(sum(total), 2) AS total, count(*) AS receipt_count FROM l
GROUP BY date_trunc('week', t), category""",
    "stream_spend_by_month": f"""{LOCAL_ORDERS}
SELECT strftime(t, '%Y-%m') AS month, category, round(sum(total), 2) AS total, count(*) AS receipt_count FROM l GROUP BY 1, 2""",
    "stream_observations": f"""SELECT l_orderkey AS receipt_id, {LINE_ID} AS line_item_id, 'Store ' || (o_custkey % 40) AS store_name, strftime(o_orderdate, {DAY}) AS observed_at, l_extendedprice / l_quantity AS unit_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "write_tables": "SELECT strftime(o_orderdate, '%Y-%m') AS purchase_month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "emit_activity": f"""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'receipt_added' ELSE 'llm_completed' END AS kind, 'Receipt ' || o_orderkey AS description,
  '{{"receipt_id":' || o_orderkey || '}}' AS payload, strftime({AS_OF}, {DAY}) AS timestamp, CAST(32 AS BIGINT) AS id_length FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "undo_receipts": """SELECT 'receipts' AS table_name, count(*) AS row_count FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 'line_items', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT'""",
    "undo_extraction": """SELECT o_orderkey AS receipt_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'running' END AS extract_status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'LLM' WHEN o_orderpriority = '3-MEDIUM' THEN 'heuristic' END AS extract_method FROM orders""",
    "undo_shopping_run": """SELECT 'i' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id,
  CASE WHEN c_acctbal < 0 THEN 'renamed since' WHEN c_mktsegment = 'MACHINERY' THEN c_name ELSE c_name || ' @ X' END AS name, false AS complete
FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
    "undo_state": f"""SELECT CAST(c_custkey AS VARCHAR) AS product_id, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'run' ELSE 'image' END AS of,
  strftime(TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey AS INTEGER)), {DAY}) AS at, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN c_mktsegment END AS tag,
  c_acctbal AS confidence FROM customer""",
    "stream_activity_counts": f"""SELECT strftime(date_trunc('day', ts), {DAY}) AS window_start, event_type AS kind, count(*) AS n FROM events
GROUP BY date_trunc('day', ts), event_type""",
}
