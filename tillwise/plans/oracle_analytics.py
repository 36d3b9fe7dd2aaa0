"""SQL twins of the analytics queries, run by another engine on the same tables."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-07-25 12:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"
DAY = "'%Y-%m-%d %H:%M:%S'"

RECEIPTS = """receipts AS (
  SELECT o_orderkey AS receipt_id, o_orderdate AS purchased_at, o_totalprice AS total, o_custkey AS customer_id,
    'Store ' || (o_custkey % 40) AS store_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'dining' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'grocery' END AS receipt_category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'dining' WHEN '4-NOT SPECIFIED' THEN 'uncategorized' ELSE 'grocery' END AS category,
    'auto' AS receipt_category_source,
    'r' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN '.pdf' ELSE '.jpg' END AS filename,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' END AS extract_status,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE '/in/' || o_orderkey END AS file_path,
    CAST(floor(o_totalprice % 9000) AS BIGINT) AS extract_duration_ms,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'llm' WHEN o_orderpriority = '3-MEDIUM' THEN 'heuristic' ELSE 'unknown' END AS method,
    CASE o_custkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'unknown' END AS provider
  FROM orders)"""
SUBS = """subs AS (
  SELECT l_orderkey AS receipt_id, lower(p_type) AS subcategory, sum(l_extendedprice * (1 - l_discount)) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
A7 = """pos AS (SELECT * FROM subs WHERE total > 0),
known AS (
  SELECT r.receipt_id, any_value(r.total) AS total, coalesce(sum(p.total), 0) AS known
  FROM receipts r LEFT JOIN pos p USING (receipt_id) GROUP BY 1),
rest AS (
  SELECT receipt_id, 'unclassified' AS subcategory, CASE WHEN known <= 0 AND total > 0 THEN total ELSE total - known END AS total
  FROM known WHERE (known <= 0 AND total > 0) OR total > known + 0.009),
a7 AS (SELECT receipt_id, subcategory, sum(total) AS total FROM (SELECT * FROM pos UNION ALL SELECT * FROM rest) GROUP BY 1, 2)"""
PERIODS = f"""periods AS (
  SELECT receipt_id, category, total, period, month FROM (
    SELECT *, 'week' AS period, NULL AS month FROM receipts WHERE date_trunc('week', purchased_at) = date_trunc('week', {AS_OF})
    UNION ALL SELECT *, 'month', NULL FROM receipts WHERE date_trunc('month', purchased_at) = date_trunc('month', {AS_OF})
    UNION ALL SELECT *, 'year', NULL FROM receipts WHERE date_trunc('year', purchased_at) = date_trunc('year', {AS_OF})
    UNION ALL SELECT *, 'month_12m', strftime(purchased_at, '%Y-%m') FROM receipts
      WHERE purchased_at >= date_trunc('month', {AS_OF}) - INTERVAL 11 MONTH AND purchased_at < date_trunc('month', {AS_OF}) + INTERVAL 1 MONTH))"""
PERIOD_RANK = "CASE period WHEN 'week' THEN 1 WHEN 'month' THEN 2 WHEN 'year' THEN 3 ELSE 4 END"
ITEMS = """items AS (
  SELECT l_orderkey AS receipt_id, l_linenumber * 100000000 + l_partkey AS pos,
    upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS raw_name,
    l_extendedprice AS line_total, CAST(l_quantity AS INTEGER) || ' pcs' AS qty_raw
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LINE_ID = "l_orderkey || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || l_partkey || '-' || l_suppkey"
OBS = f"""obs AS (
  SELECT p_name AS product_id, r_name AS store_name, o_orderdate AS observed_at, l_extendedprice / l_quantity AS unit_price,
    least(100, 65 + 5 * l_linenumber) AS confidence, l_orderkey AS receipt_id, o_custkey AS customer, {LINE_ID} AS line_item_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CAPITAL = "upper(split_part({c}, ' ', 1)[1]) || split_part({c}, ' ', 1)[2:] || ' ' || upper(split_part({c}, ' ', 2)[1]) || split_part({c}, ' ', 2)[2:]"


def capital(c: str) -> str:
    return CAPITAL.format(c=c)


BASELINES = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, line_item_id DESC) AS rn,
    count(*) OVER (PARTITION BY product_id) AS n FROM obs),
base AS (
  SELECT product_id, median(unit_price) AS baseline, any_value(n) AS n FROM ranked WHERE rn <= 5 AND n >= 3 GROUP BY 1)"""
LEVELS = f"""buys AS (SELECT o_custkey AS product_id, o_orderdate AS ts FROM orders),
gaps AS (
  SELECT product_id, ts, date_diff('second', lag(ts) OVER (PARTITION BY product_id ORDER BY ts), ts) / 86400.0::DOUBLE AS gap FROM buys),
cad AS (SELECT product_id, median(gap) AS cadence FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
mads AS (SELECT product_id, median(abs(gap - cadence)) AS mad FROM gaps JOIN cad USING (product_id) WHERE gap IS NOT NULL GROUP BY 1),
tot AS (SELECT product_id, count(*) AS purchases, max(ts) AS last_ts FROM buys GROUP BY 1),
joined AS (
  SELECT t.*, coalesce(purchases >= 3 AND cadence > 0, false) AS known, cadence, mad,
    greatest(0, date_diff('second', last_ts, {AS_OF}) / 86400.0::DOUBLE) AS days
  FROM tot t LEFT JOIN cad USING (product_id) LEFT JOIN mads USING (product_id)),
levels AS (
  SELECT product_id, purchases, CASE WHEN known THEN cadence ELSE 0 END AS cadence, CASE WHEN known THEN days ELSE 0 END AS days_since_last,
    CASE WHEN NOT known THEN 'medium' WHEN days / cadence < 0.7 THEN 'plenty' WHEN days / cadence < 1 THEN 'medium' ELSE 'likely_low' END AS level,
    CASE WHEN NOT known THEN 0 ELSE greatest(0, least(1, 0.6 * (1 - least(1, mad / cadence)) + 0.4 * least(1, purchases / 8.0::DOUBLE))) END AS confidence
  FROM joined)"""
STATE = f"""state AS (
  SELECT c_custkey AS product_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN {AS_OF} - INTERVAL 3 DAY WHEN 'MACHINERY' THEN {AS_OF} - INTERVAL 9 DAY END AS last_added,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 0.8::DOUBLE END AS tag_confidence,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN {AS_OF} - INTERVAL 2 DAY END AS last_seen
  FROM customer)"""
STATUSES = f"""statuses AS (
  SELECT l.*, CASE WHEN purchases < 3 THEN 'not_enough_history' WHEN level <> 'likely_low' THEN 'not_low'
    WHEN confidence < 0.5 THEN 'low_confidence' WHEN {AS_OF} < last_added + INTERVAL 7 DAY THEN 'cooldown'
    WHEN {AS_OF} < last_seen + INTERVAL 7 DAY THEN 'recently_seen' ELSE 'candidate' END AS status
  FROM levels l LEFT JOIN state USING (product_id))"""
STORE_PRICES = f"""recent AS (
  SELECT product_id, CASE WHEN store_name = 'MIDDLE EAST' THEN 'ASIA' ELSE store_name END AS store, unit_price, observed_at, line_item_id
  FROM obs WHERE confidence >= 75 AND unit_price > 0 AND observed_at >= {AS_OF} - INTERVAL 120 DAY),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY unit_price) - 1 AS rn,
    count(*) OVER (PARTITION BY product_id, store) AS n, count(*) OVER (PARTITION BY product_id) AS total FROM recent),
sp AS (
  SELECT product_id, store, any_value(n) AS n, median(unit_price) AS median,
    max(CASE WHEN rn = round_even((n - 1) * 0.25, 0) THEN unit_price END) AS q25,
    max(CASE WHEN rn = round_even((n - 1) * 0.75, 0) THEN unit_price END) AS q75,
    max(observed_at) AS last_seen, min(strftime(observed_at, '%Y%m%d') || line_item_id) AS seen
  FROM ranked WHERE total >= 3 GROUP BY 1, 2)"""
RECS = f"""cand AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY median, seen, store) AS place FROM sp
  WHERE n >= 3 AND date_diff('second', last_seen, {AS_OF}) / 86400.0::DOUBLE <= 60),
wr AS (
  SELECT w.product_id, w.store, w.median AS wm, w.n AS wn, w.q25, w.q75, w.last_seen, r.store AS rstore, r.median AS rm, r.n AS rn,
    (r.median - w.median) / r.median AS gap, greatest(0, date_diff('second', w.last_seen, {AS_OF}) / 86400.0::DOUBLE) AS age
  FROM cand w JOIN cand r ON w.product_id = r.product_id AND w.place = 1 AND r.place = 2),
recs AS (
  SELECT product_id, store, rstore, wm, rm, gap,
    greatest(0, least(1, (0.6 * least(1, wn / 3.0::DOUBLE) + 0.4 * least(1, rn / 2.0::DOUBLE)) * (
      0.45 * greatest(0, least(1, (gap - 0.02) / 0.10))
      + 0.30 * CASE WHEN wn >= 4 THEN greatest(0, least(1, 1 - greatest(0, q75 - q25) / greatest(1e-9, wm) / 0.25)) ELSE 0.6 END
      + 0.25 * CASE WHEN age <= 7 THEN 1 WHEN age <= 30 THEN 1 - (age - 7) / 23 * 0.4 WHEN age <= 60 THEN 0.6 - (age - 30) / 30 * 0.6 ELSE 0 END
    ))) AS confidence
  FROM wr WHERE gap >= 0.02)"""
PLAN = """votes AS (SELECT * FROM recs WHERE CAST(printf('%.3f', confidence) AS DOUBLE) >= 0.75),
plan AS (
  SELECT store, count(*) AS wins, row_number() OVER (ORDER BY count(*) DESC, min(product_id), store) AS place FROM votes GROUP BY 1
  QUALIFY place <= 2)"""
PLANNED = """offer AS (SELECT v.product_id, v.store AS best, v.wm AS best_price, s.store, s.median, p.place
  FROM votes v JOIN sp s USING (product_id) LEFT JOIN plan p ON p.store = s.store),
wide AS (
  SELECT product_id, best, any_value(best_price) AS best_price, max(CASE WHEN place = 1 THEN median END) AS primary_price,
    max(CASE WHEN place = 1 THEN store END) AS primary_store, max(CASE WHEN store = best THEN place END) AS best_place,
    arg_min(store, median) FILTER (place IS NOT NULL) AS cheapest FROM offer GROUP BY 1, 2),
planned AS (
  SELECT product_id, best, CASE WHEN (primary_price - best_price) / best_price <= 0.05 THEN primary_store WHEN best_place IS NOT NULL THEN best ELSE cheapest END AS planned_store
  FROM wide WHERE planned_store IS NOT NULL)"""
RUN_LEVELS = LEVELS.replace("SELECT o_custkey AS product_id", "SELECT o_custkey // 10 AS product_id", 1)
CUSTOMER_LIST = """raw_list AS (
  SELECT 'i' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_acctbal < 0 AS complete,
    CASE c_mktsegment WHEN 'MACHINERY' THEN lower(c_name) || ' @ AFRICA' WHEN 'FURNITURE' THEN '[Auto] ' || c_name END AS name, c_mktsegment
  FROM customer)"""


def _round(columns: str, places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split())


TOTALS = f"""SELECT {{keys}}
  round(coalesce(sum(CASE WHEN date_trunc('week', purchased_at) = date_trunc('week', {AS_OF}) THEN total END), 0), 4) AS week_total,
  round(coalesce(sum(CASE WHEN date_trunc('month', purchased_at) = date_trunc('month', {AS_OF}) THEN total END), 0), 4) AS month_total,
  round(coalesce(sum(CASE WHEN year(purchased_at) = year({AS_OF}) THEN total END), 0), 4) AS year_total
FROM receipts"""
CATEGORY_ROWS = f"""cats AS (SELECT {{keys}} period, category, month, sum(total) AS total, count(*) AS receipt_count FROM {{src}} GROUP BY ALL)"""

ORACLE = {
    "spend_totals": f"WITH {RECEIPTS} " + TOTALS.format(keys=""),
    "spend_week": f"WITH {RECEIPTS} SELECT week_total FROM (" + TOTALS.format(keys="") + ")",
    "spend_month": f"WITH {RECEIPTS} SELECT month_total FROM (" + TOTALS.format(keys="") + ")",
    "spend_year": f"WITH {RECEIPTS} SELECT year_total FROM (" + TOTALS.format(keys="") + ")",
    "spend_totals_by_tenant": f"WITH {RECEIPTS} SELECT * FROM ("
    + TOTALS.format(keys="customer_id % 20 AS tenant,") + " WHERE year(purchased_at) = 2001 GROUP BY 1)",
    "receipt_subcategory_totals": f"WITH {RECEIPTS}, {SUBS}, {A7} SELECT receipt_id, subcategory, round(total, 4) AS total FROM a7",
    "spend_by_category_periods": f"""WITH {RECEIPTS}, {PERIODS}, {CATEGORY_ROWS.format(keys='', src='periods')}
SELECT period, category, month, month || '-01' AS month_start, round(total, 4) AS total, receipt_count FROM cats
ORDER BY {PERIOD_RANK}, category, month DESC, total DESC""",
    "spend_by_category_periods_by_tenant": f"""WITH {RECEIPTS}, {PERIODS.replace('SELECT receipt_id, category', 'SELECT receipt_id, customer_id % 20 AS tenant, category')},
{CATEGORY_ROWS.format(keys='tenant,', src='periods')}
SELECT tenant, period, category, month, month || '-01' AS month_start, round(total, 4) AS total, receipt_count FROM cats""",
    "spend_by_subcategory_periods": f"""WITH {RECEIPTS}, {SUBS}, {A7}, {PERIODS},
rows_ AS (SELECT period, category, subcategory, month, sum(a7.total) AS total, count(*) AS receipt_count
  FROM periods JOIN a7 USING (receipt_id) WHERE a7.total > 0 GROUP BY ALL)
SELECT period, category, subcategory, month, month || '-01' AS month_start, round(total, 4) AS total, receipt_count, false AS is_vice
FROM rows_ ORDER BY {PERIOD_RANK}, category, month DESC NULLS LAST, total DESC, subcategory""",
    "truncation_meta": f"""WITH {RECEIPTS}, {SUBS}, {A7}, {PERIODS},
rows_ AS (SELECT DISTINCT period, category, subcategory, month FROM periods JOIN a7 USING (receipt_id))
SELECT count(*) > 180 AS truncated, CAST(180 AS BIGINT) AS max_rows, least(count(*), 180) AS returned_rows,
  greatest(count(*) - 180, 0) AS dropped_rows,
  'period_priority(week,month,year,month_12m) then category then newest month_12m then total_desc' AS drop_policy FROM rows_""",
    "category_pivot": f"""WITH {RECEIPTS}, {PERIODS}
SELECT category, {', '.join(f"round(coalesce(sum(CASE WHEN period = '{p}' THEN total END), 0), 4) AS {p}" for p in ('week', 'month', 'year'))}
FROM periods WHERE period IN ('week', 'month', 'year') GROUP BY 1""",
    "receipt_status_counts": f"""WITH {RECEIPTS}
SELECT coalesce(extract_status, CASE WHEN file_path <> '' THEN 'pending' ELSE 'done' END) AS status, count(*) AS count FROM receipts GROUP BY 1""",
    "receipt_status_summary": f"""WITH {RECEIPTS}, s AS (
SELECT coalesce(extract_status, CASE WHEN file_path <> '' THEN 'pending' ELSE 'done' END) AS status FROM receipts)
SELECT count(*) AS total_receipts, count(*) FILTER (status IN ('pending', 'queued', 'running')) AS in_progress,
  count(*) FILTER (status = 'failed') AS failed FROM s""",
    "processing_timing": f"""WITH {RECEIPTS}, newest AS (
  SELECT receipt_id, method, provider, extract_duration_ms / 1000.0::DOUBLE AS s FROM receipts
  WHERE extract_status = 'done' AND extract_duration_ms > 0),
g AS (
  SELECT 'overall' AS group_kind, 'all' AS group_value, s FROM newest UNION ALL SELECT 'method', method, s FROM newest
  UNION ALL SELECT 'provider', provider, s FROM newest WHERE method = 'llm'),
r AS (SELECT *, row_number() OVER (PARTITION BY group_kind, group_value ORDER BY s) - 1 AS rn, count(*) OVER (PARTITION BY group_kind, group_value) AS n FROM g)
SELECT group_kind, group_value, count(*) AS count, round(avg(s), 6) AS avg_s, round(median(s), 6) AS median_s,
  round(max(CASE WHEN rn = round_even((n - 1) * 0.95, 0) THEN s END), 6) AS p95_s,
  CAST(NULL AS BIGINT) AS window_n, (SELECT count(*) FROM newest) AS considered FROM r GROUP BY 1, 2""",
    "recent_receipts": f"""WITH {RECEIPTS}
SELECT receipt_id, strftime(purchased_at, {DAY}) AS purchased_at, store_name, total, filename, receipt_category, receipt_category_source
FROM receipts ORDER BY receipts.purchased_at DESC, receipt_id LIMIT 20""",
    "recent_receipts_by_tenant": f"""WITH {RECEIPTS}
SELECT customer_id % 20 AS tenant, receipt_id, strftime(purchased_at, {DAY}) AS purchased_at, total FROM receipts
QUALIFY row_number() OVER (PARTITION BY customer_id % 20 ORDER BY receipts.purchased_at DESC, receipt_id) <= 5""",
    "dedupe_recent_receipts": f"""WITH {RECEIPTS}, recent AS (SELECT * FROM receipts),
one AS (SELECT *, row_number() OVER (PARTITION BY CAST(purchased_at AS DATE), store_name, round(total, 2) ORDER BY purchased_at DESC, receipt_id) AS rn FROM recent)
SELECT receipt_id, strftime(purchased_at, {DAY}) AS purchased_at, store_name, total, filename, receipt_category, receipt_category_source
FROM one WHERE rn = 1 ORDER BY one.purchased_at DESC, receipt_id LIMIT 15""",
    "unknown_category": f"""WITH {RECEIPTS}
SELECT receipt_id, strftime(purchased_at, {DAY}) AS purchased_at, store_name, total, filename, receipt_category, receipt_category_source
FROM receipts WHERE receipt_category = '' ORDER BY receipts.purchased_at DESC, receipt_id""",
    "is_unknown_subcategory": """WITH p AS (SELECT CASE p_type WHEN 'PROMO' THEN ' Misc ' WHEN 'SMALL' THEN '' WHEN 'LARGE' THEN 'Other' ELSE p_type END AS subcategory FROM part)
SELECT subcategory, count(*) AS n, trim(lower(subcategory)) IN ('misc', '', 'other') AS is_unknown FROM p GROUP BY 1""",
    "unknown_subcategory_items": f"""WITH {RECEIPTS}, {SUBS}, {A7}, {ITEMS},
flagged AS (SELECT r.*, u.unknown FROM receipts r JOIN (SELECT receipt_id, sum(total) AS unknown FROM a7 WHERE subcategory = 'unclassified' GROUP BY 1) u USING (receipt_id)),
named AS (
  SELECT f.receipt_id, f.purchased_at, f.category, f.store_name, coalesce(i.pos, 0) AS pos,
    coalesce(i.raw_name, '[No line items] ' || f.store_name) AS name, greatest(coalesce(i.line_total, f.unknown), 0) AS amount
  FROM flagged f LEFT JOIN items i USING (receipt_id)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY receipt_id, pos) AS rn FROM named),
agg AS (
  SELECT lower(name) AS key, round(sum(amount), 2) AS total, count(*) AS count, max(CASE WHEN rn = 1 THEN name END) AS item,
    max(CASE WHEN rn = 1 THEN category END) AS category, max(CASE WHEN rn = 1 THEN store_name END) AS sample_store_name,
    max(CASE WHEN rn = 1 THEN receipt_id END) AS sample_receipt_id, max(CASE WHEN rn = 1 THEN strftime(purchased_at, {DAY}) END) AS sample_purchased_at
  FROM firsts GROUP BY 1)
SELECT item, total, count, category, sample_store_name, sample_receipt_id, sample_purchased_at FROM agg
ORDER BY total DESC, count DESC, item, key""",
    "unknown_item_report": f"""WITH {SUBS}, {ITEMS}, flagged AS (SELECT receipt_id FROM subs WHERE subcategory = 'promo' GROUP BY 1 HAVING sum(total) > 0)
SELECT receipt_id, coalesce(pos, 0) AS line_no, CASE WHEN pos IS NULL THEN '- No line items extracted for this receipt.'
  ELSE '- ' || raw_name || ' | qty ' || qty_raw || ' | ' || printf('%.2f', line_total) || ' kr' END AS line
FROM flagged JOIN orders ON o_orderkey = receipt_id LEFT JOIN items USING (receipt_id)""",
    "price_baselines": f"""WITH {OBS}, {BASELINES}
SELECT product_id, round(baseline, 8) AS baseline, n AS count, CAST(least(100, n * 20) AS INTEGER) AS confidence FROM base""",
    "last_prices": f"""WITH {OBS}, {BASELINES}
SELECT product_id, line_item_id, strftime(observed_at, {DAY}) AS observed_at, unit_price FROM ranked WHERE rn <= 5""",
    "overpaid_items": f"""WITH {OBS}, {BASELINES}
SELECT {capital('product_id')} AS product, store_name AS store, round(unit_price, 8) AS unit_price, round(baseline, 8) AS baseline,
  round((unit_price - baseline) / baseline, 8) AS overpaid_pct, strftime(observed_at, {DAY}) AS observed_at, line_item_id
FROM obs JOIN base USING (product_id)
WHERE date_trunc('week', observed_at) = date_trunc('week', {AS_OF}) AND baseline > 0 AND unit_price >= baseline * (1 + 0.15::DOUBLE) AND unit_price - baseline >= 2
ORDER BY (unit_price - baseline) / baseline DESC, obs.observed_at, line_item_id""",
    "overpaid_items_by_tenant": f"""WITH {OBS}, {BASELINES.replace('PARTITION BY product_id', 'PARTITION BY store_name, product_id').replace('SELECT product_id, median', 'SELECT store_name, product_id, median').replace('GROUP BY 1)', 'GROUP BY 1, 2)')}
SELECT store_name AS tenant, {capital('product_id')} AS product, round(unit_price, 8) AS unit_price, round(baseline, 8) AS baseline,
  round((unit_price - baseline) / baseline, 8) AS overpaid_pct, line_item_id
FROM obs JOIN base USING (store_name, product_id)
WHERE date_trunc('week', observed_at) = date_trunc('week', {AS_OF}) AND baseline > 0 AND unit_price >= baseline * (1 + 0.15::DOUBLE) AND unit_price - baseline >= 2
QUALIFY row_number() OVER (PARTITION BY store_name ORDER BY (unit_price - baseline) / baseline DESC, observed_at, line_item_id) <= 5""",
    "top_price_increases": f"""WITH {OBS}, g AS (
  SELECT product_id, count(*) AS observations, count(*) FILTER (observed_at >= {AS_OF} - INTERVAL 30 DAY) AS rn,
    median(CASE WHEN observed_at >= {AS_OF} - INTERVAL 30 DAY THEN unit_price END) AS rm,
    median(CASE WHEN observed_at < {AS_OF} - INTERVAL 30 DAY AND observed_at >= {AS_OF} - INTERVAL 90 DAY THEN unit_price END) AS pm
  FROM obs GROUP BY 1)
SELECT {capital('product_id')} AS product, round((rm - pm) / pm, 8) AS increase_pct, round(rm, 8) AS recent_median, round(pm, 8) AS prior_median,
  'pcs' AS unit_type, observations FROM g WHERE rm > pm AND pm > 0 AND (rn >= 2 OR observations >= 3)
ORDER BY (rm - pm) / pm DESC, product_id""",
    "best_store_by_item": f"""WITH {OBS}, w AS (SELECT * FROM obs WHERE observed_at >= {AS_OF} - INTERVAL 90 DAY),
t AS (SELECT product_id, count(*) AS n, count(*) FILTER (observed_at >= {AS_OF} - INTERVAL 60 DAY) AS recent, median(unit_price) AS overall FROM w GROUP BY 1),
s AS (SELECT product_id, store_name, count(*) AS n, median(unit_price) AS m, min(strftime(observed_at, '%Y%m%d') || line_item_id) AS seen FROM w GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY m, seen) AS rn FROM s WHERE n >= 2)
SELECT {capital('product_id')} AS product, store_name AS best_store, round(m, 8) AS best_median, round(overall, 8) AS overall_median,
  round((overall - m) / overall, 8) AS savings_pct, 'pcs' AS unit_type
FROM t JOIN b USING (product_id) WHERE rn = 1 AND (t.n >= 4 OR recent >= 2) AND t.n >= 2 AND overall > 0 AND (overall - m) / overall >= 0.05
ORDER BY (overall - m) / overall DESC, product_id""",
    "purchase_gaps": f"WITH {LEVELS} SELECT product_id, round(gap, 6) AS gap, count(*) AS weight FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2",
    "restock_levels": f"WITH {LEVELS} SELECT product_id, purchases, {_round('cadence days_since_last', 6)}, level, round(confidence, 6) AS confidence FROM levels",
    "restock_candidates": f"WITH {LEVELS}, {STATE}, {STATUSES} SELECT product_id, status, level, round(confidence, 6) AS confidence FROM statuses",
    "resolve_store_alias": f"WITH {OBS} SELECT CASE WHEN store_name = 'MIDDLE EAST' THEN 'ASIA' ELSE store_name END AS store_name, count(*) AS n FROM obs GROUP BY 1",
    "store_prices": f"""WITH {OBS}, {STORE_PRICES}
SELECT product_id, store, n, {_round('median q25 q75', 8)}, strftime(last_seen, {DAY}) AS last_seen, 'pcs' AS unit_type FROM sp""",
    "store_recommendation": f"""WITH {OBS}, {STORE_PRICES}, {RECS}
SELECT product_id, store, round(confidence, 8) AS confidence, 'pcs' AS unit_type, round(wm, 8) AS winner_median, rstore AS runner_up_store,
  round(rm, 8) AS runner_up_median, round(gap, 8) AS gap_pct FROM recs""",
    "plan_stores": f"WITH {OBS}, {STORE_PRICES}, {RECS}, {PLAN} SELECT store, wins, place FROM plan",
    "store_plan": f"""WITH {OBS}, {STORE_PRICES}, {RECS}, {PLAN},
{PLANNED} SELECT product_id, planned_store, best FROM planned""",
    "reconcile_shopping_list": f"""WITH {STATE}, {CUSTOMER_LIST},
list AS (SELECT id, name, c_mktsegment, lower(CASE c_mktsegment WHEN 'MACHINERY' THEN split_part(name, ' @ ', 1) ELSE name[8:] END) AS key FROM raw_list
  WHERE name IS NOT NULL AND NOT complete),
cand AS (
  SELECT c_custkey AS product_id, c_name AS name, 0.70 + (c_custkey % 30) / 100.0::DOUBLE AS sc,
    CASE n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'ASIA' END AS store FROM customer JOIN nation ON c_nationkey = n_nationkey),
named AS (SELECT *, '[Auto] ' || name || CASE WHEN store IS NOT NULL AND sc >= 0.75 THEN ' @ ' || store ELSE '' END AS new_name,
  store IS NOT NULL AND sc >= 0.75 AS tagged FROM cand),
j AS (SELECT n.*, l.id, l.name AS old_name, l.c_mktsegment AS seg, s.tag_confidence FROM named n LEFT JOIN list l ON l.key = lower(n.name) LEFT JOIN state s USING (product_id)),
a AS (SELECT *, CASE WHEN id IS NULL THEN 'add' WHEN lower(old_name) = lower(new_name) THEN 'already_present'
  WHEN tagged AND (seg <> 'MACHINERY' OR sc >= greatest(0.75, coalesce(tag_confidence, 0) + 0.10::DOUBLE)) THEN 'rename' ELSE 'already_present' END AS action FROM j)
SELECT product_id, action, new_name, old_name, CASE WHEN action <> 'add' THEN id END AS shopping_list_item_id, store FROM a""",
    "auto_shopping_run": f"""WITH {RUN_LEVELS}, {STATE}, {STATUSES}, {CUSTOMER_LIST},
obs AS (
  SELECT o_custkey // 10 AS product_id, CASE WHEN o_orderkey % 4 = 0 THEN 'MIDDLE EAST' WHEN o_orderkey % 2 = 0 THEN 'ASIA' ELSE 'AFRICA' END AS store_name,
    o_orderdate AS observed_at, CAST(o_orderkey % 7 + CASE WHEN o_orderkey % 2 = 0 THEN 130 ELSE 100 END AS DOUBLE) AS unit_price, 90 AS confidence,
    lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS line_item_id
  FROM orders WHERE o_custkey // 10 IN (SELECT product_id FROM statuses WHERE status = 'candidate')),
{STORE_PRICES}, {RECS}, {PLAN}, {PLANNED},
list AS (SELECT id, name, c_mktsegment, lower(CASE c_mktsegment WHEN 'MACHINERY' THEN split_part(name, ' @ ', 1) ELSE name[8:] END) AS key FROM raw_list
  WHERE name IS NOT NULL AND NOT complete),
named AS (
  SELECT s.product_id, coalesce(c_name, CAST(s.product_id AS VARCHAR)) AS name, s.confidence, planned_store AS store, CAST(printf('%.3f', r.confidence) AS DOUBLE) AS sc,
    planned_store IS NOT NULL AND CAST(printf('%.3f', r.confidence) AS DOUBLE) >= 0.75 AS tagged
  FROM statuses s LEFT JOIN customer ON c_custkey = s.product_id LEFT JOIN recs r ON r.product_id = s.product_id
    LEFT JOIN planned p ON p.product_id = s.product_id WHERE status = 'candidate'),
j AS (SELECT n.*, '[Auto] ' || n.name || CASE WHEN tagged THEN ' @ ' || store ELSE '' END AS new_name, l.id, l.name AS old_name, l.c_mktsegment AS seg, s.tag_confidence
  FROM named n LEFT JOIN list l ON l.key = lower(n.name) LEFT JOIN state s ON s.product_id = n.product_id),
a AS (SELECT *, CASE WHEN id IS NULL THEN 'add' WHEN lower(old_name) = lower(new_name) THEN 'already_present'
  WHEN tagged AND (seg <> 'MACHINERY' OR sc >= greatest(0.75, coalesce(tag_confidence, 0) + 0.10::DOUBLE)) THEN 'rename' ELSE 'already_present' END AS action FROM j)
SELECT product_id, action, new_name, old_name, CASE WHEN action <> 'add' THEN id END AS shopping_list_item_id, store, CAST(printf('%.3f', confidence) AS DOUBLE) AS confidence FROM a""",
    "auto_shopping_skipped": f"WITH {RUN_LEVELS}, {STATE}, {STATUSES} SELECT product_id, status FROM statuses WHERE status <> 'candidate'",
    "inventory_recently_seen": f"""WITH s AS (SELECT user_id AS product_id, max(ts) AS seen, max(value) / 500 AS conf FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT product_id, c_name AS product, strftime(seen, {DAY}) AS last_seen_at, strftime(seen + INTERVAL 7 DAY, {DAY}) AS expires_at, CAST(printf('%.3f', conf) AS DOUBLE) AS confidence
FROM s JOIN customer ON c_custkey = product_id WHERE seen + INTERVAL 7 DAY > {EVENTS_AS_OF} ORDER BY seen DESC, product_id""",
    "inventory_by_day": f"""WITH s AS (SELECT user_id AS product_id, max(ts) AS seen, max(value) / 500 AS conf FROM events WHERE event_type = 'view' GROUP BY 1),
top AS (SELECT product_id, c_name, seen, CAST(printf('%.3f', conf) AS DOUBLE) AS conf FROM s JOIN customer ON c_custkey = product_id
  WHERE seen + INTERVAL 7 DAY > {EVENTS_AS_OF})
SELECT CAST(CAST(seen AS DATE) AS VARCHAR) AS day, count(*) OVER (PARTITION BY CAST(seen AS DATE)) AS n, product_id,
  c_name || ' (' || CAST(round_even(conf * 100, 0) AS BIGINT) || '%)' AS item FROM top""",
    "apply_inventory_evidence": f"""WITH a AS (SELECT user_id AS product_id, max(greatest(0, least(1, value / 500))) AS c FROM events GROUP BY 1),
s AS (SELECT user_id AS product_id, max(ts) AS seen, max(value) / 500 AS conf FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT product_id, round(greatest(c, coalesce(conf, 0)), 6) AS last_seen_confidence, strftime({EVENTS_AS_OF}, {DAY}) AS last_seen_at,
  strftime(seen, {DAY}) AS previous_seen_at FROM a LEFT JOIN s USING (product_id)""",
    "detected_items": """SELECT event_id AS image_id,
  CASE event_type WHEN 'view' THEN 'Milk ' WHEN 'click' THEN 'Egg ' ELSE 'Rice ' END || CAST(props::JSON->>'k' AS VARCHAR) AS label,
  CASE event_type WHEN 'click' THEN round(greatest(0, least(1, value / 100)), 6) ELSE 0.7::DOUBLE END AS confidence
FROM events WHERE event_type <> 'error'""",
    "recent_activities": """SELECT event_id AS activity_id, event_type AS kind,
  CASE WHEN length(repeat(event_type || ' happened ', 14)) > 180 THEN substr(repeat(event_type || ' happened ', 14), 1, 177) || '...' ELSE repeat(event_type || ' happened ', 14) END AS description,
  props::JSON->>'k' AS k, '{"count":3}' AS seen, substr(repeat('ab ', 50), 1, 117) || '...' AS note, '{"a":"1"}' AS sub, CAST(4 AS BIGINT) AS n_keys
FROM events ORDER BY ts DESC, event_id LIMIT 25""",
    "compact_payload": """SELECT event_id AS activity_id, substr(repeat('ab ', 50), 1, 117) || '...' AS note, '{"count":3}' AS seen FROM events""",
    "date_keys": """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(date_trunc('month', o_orderdate) - INTERVAL 11 MONTH, '%Y-%m-%d') AS first_of_12, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
    "effective_status": f"""WITH {RECEIPTS} SELECT receipt_id, coalesce(extract_status, CASE WHEN file_path <> '' THEN 'pending' ELSE 'done' END) AS status, category FROM receipts""",
}
