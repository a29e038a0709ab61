"""The relational surface, as a catalogue of SQL queries over the driver's tables.

Spark SQL offers all of it; what the catalogue adds are the dialect's differences, spelled out: each entry has the text for
Spark and, where the other dialect needs another spelling, the oracle's text. Catalyst plans all of them: filters and
columns reach the scans, and joins are broadcast only where a size estimate allows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.sqlview import with_tables
from millrace.plans.table import with_index

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# name: (inventory rows, Spark SQL, other dialect or None if it's the same text)
CATALOGUE: dict[str, tuple[str, str, str | None]] = {
    "scan_project": ("S5 P29", "SELECT event_id, user_id, event_type FROM events", None),
    "filter_pred": ("P29 D30", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '1%'", None),
    "leaderboard": ("A1", "SELECT user_id, round(sum(value), 2) AS points FROM events GROUP BY user_id ORDER BY points DESC, user_id LIMIT 20", None),
    "leaderboard_rank": ("W3", "SELECT user_id, points, CAST(row_number() OVER (ORDER BY points DESC, user_id) AS BIGINT) AS rank FROM (SELECT user_id, round(sum(value), 2) AS points FROM events GROUP BY user_id ORDER BY points DESC, user_id LIMIT 20)", None),
    "error_rate": ("A2 D13", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, round(CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / NULLIF(count(*), 0), 6) AS rate FROM events GROUP BY event_type", None),
    "recent_window": ("A2 D47", "SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '1' DAY", None),
    "multi_leaderboard": ("U3", "SELECT user_id, round(sum(points), 2) AS points FROM (SELECT user_id, sum(value) AS points FROM events WHERE event_type = 'click' GROUP BY user_id UNION ALL SELECT user_id, sum(value) FROM events WHERE event_type = 'view' GROUP BY user_id) GROUP BY user_id", None),
    "inner_join": ("D1 J4", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", None),
    "using_join": ("D1", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)", None),
    "tpch_join_chain": ("D1 D2", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", None),
    "theta_join": ("D3 J6", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "range_join": ("D3 J6", "WITH w AS (SELECT event_id, user_id, ts, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'click'), p AS (SELECT *, h AS b FROM w UNION ALL SELECT *, h - INTERVAL '1' HOUR FROM w) SELECT p.event_id, count(*) AS n FROM p JOIN c ON p.user_id = c.user_id AND p.b = c.h WHERE c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1' HOUR GROUP BY p.event_id", "SELECT p.event_id, count(*) AS n FROM events p JOIN events c ON p.user_id = c.user_id WHERE p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1' HOUR GROUP BY p.event_id"),
    "cross_join": ("D4", "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "left_join": ("D5", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "right_join": ("D5", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None),
    "full_outer": ("D5", "SELECT d.doc_id AS d, l.doc_id AS l FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id", None),
    "semi_join": ("D6", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", None),
    "anti_join": ("D6", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None),
    "in_subquery": ("D6", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)", None),
    "not_in_subquery": ("D6", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)", None),
    "asof_join": ("D7 J6", "SELECT event_id, last_click FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, last_value(CASE WHEN event_type = 'click' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events) WHERE event_type = 'purchase'", "SELECT event_id, last_click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events) WHERE event_type = 'purchase'"),
    "scalar_subquery": ("D8", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)", None),
    "correlated_subquery": ("D8", "SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", None),
    "lateral_join": ("D8", "SELECT c_custkey, t.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) t", None),
    "cte": ("D9", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM big WHERE s > 500000", None),
    "recursive_cte": ("D9", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "group_having": ("D10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "group_rollup": ("D11 A3", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "group_cube": ("D11 A3", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "grouping_sets": ("D11 A3", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "distinct_rows": ("D12", "SELECT DISTINCT event_type, user_id FROM events", None),
    "distinct_on": ("D12 W4", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id DESC"),
    "distinct_agg": ("A3 D14", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(*) AS n, round(avg(l_quantity), 4) AS q, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag", None),
    "median_percentile": ("D15", "SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 2) AS p90 FROM lineitem GROUP BY l_returnflag", None),
    "statistics_agg": ("D17", "SELECT event_type, round(stddev_samp(value), 3) AS sd, round(stddev_pop(value), 3) AS sp, round(var_samp(value), 3) AS v, round(var_pop(value), 3) AS vp, round(covar_samp(value, user_id), 3) AS cs, round(corr(value, user_id), 5) AS c, round(regr_slope(value, user_id), 6) AS slope FROM events GROUP BY event_type", None),
    "ordered_list_agg": ("D18", "SELECT o_custkey, array_join(transform(sort_array(collect_list(o_orderkey)), x -> cast(x AS string)), ',') AS ks, listagg(o_orderstatus, '') WITHIN GROUP (ORDER BY o_orderkey) AS ss FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ks, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS ss FROM orders GROUP BY o_custkey"),
    "bool_bit_agg": ("D19", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS o, bit_and(l_partkey) AS ba, bit_or(l_partkey) AS bo, bit_xor(l_partkey) AS bx FROM lineitem GROUP BY l_returnflag", None),
    "first_last_agg": ("D20", "SELECT user_id, min_by(event_id, struct(ts, event_id)) AS f, max_by(event_id, struct(ts, event_id)) AS l FROM events GROUP BY user_id", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS f, last(event_id ORDER BY ts, event_id) AS l FROM events GROUP BY user_id"),
    "rank_window": ("D21 W1", "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)", None),
    "lag_lead": ("D22 W1", "SELECT event_id, lag(event_id) OVER w AS p, lead(event_id, 2) OVER w AS n, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "ignore_nulls_window": ("D22", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events"),
    "running_frame": ("D23 W1", "SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, min(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "range_frame": ("D23", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "groups_frame": ("D24", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders)", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "qualify": ("D25", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "order_nulls": ("D26 O1", "SELECT k, CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS BIGINT) AS d FROM (SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS v FROM events)", None),
    "topk": ("D27 O1 O4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "offset_limit": ("D27 O3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100", None),
    "union_all": ("D28 U2", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("D28 U2", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect_sets": ("D28 U2", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("D28 U2", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_sets": ("D28 U2", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000", None),
    "except_all": ("D28 U2", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "values_table": ("D29", "SELECT v.k, v.name, n_name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) v(k, name) JOIN nation ON n_nationkey = v.k", None),
    "comparison_fn": ("D30", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_name ILIKE 'P%' AS i, p_brand RLIKE '[12]$' AS r, p_size BETWEEN 5 AND 20 AS b FROM part", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_name ILIKE 'P%' AS i, regexp_matches(p_brand, '[12]$') AS r, p_size BETWEEN 5 AND 20 AS b FROM part"),
    "null_safe_equal": ("D31", "SELECT a.event_id, a.u IS NOT DISTINCT FROM b.u AS same FROM (SELECT event_id, NULLIF(user_id % 4, 0) AS u FROM events) a JOIN (SELECT event_id, NULLIF(user_id % 2, 0) AS u FROM events) b ON a.event_id = b.event_id", None),
    "conditional_fn": ("D32", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS c, coalesce(NULLIF(user_id % 3, 0), -1) AS co, greatest(event_id, user_id) AS g, least(event_id, user_id) AS l, nvl(NULLIF(user_id % 2, 0), 7) AS nv, nvl2(NULLIF(user_id % 2, 0), 'y', 'n') AS n2 FROM events", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS c, coalesce(NULLIF(user_id % 3, 0), -1) AS co, greatest(event_id, user_id) AS g, least(event_id, user_id) AS l, coalesce(NULLIF(user_id % 2, 0), 7) AS nv, CASE WHEN NULLIF(user_id % 2, 0) IS NOT NULL THEN 'y' ELSE 'n' END AS n2 FROM events"),
    "cast_fn": ("D33", "SELECT event_id, CAST(event_id AS STRING) AS s, try_cast(event_type AS INT) AS bad, try_cast(concat('', event_id) AS BIGINT) AS good, event_id::double AS d FROM events", "SELECT event_id, CAST(event_id AS VARCHAR) AS s, try_cast(event_type AS INT) AS bad, try_cast(concat('', event_id) AS BIGINT) AS good, event_id::double AS d FROM events"),
    "string_fn": ("D34", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, initcap(lower(c_mktsegment)) AS ic, trim(concat('  ', c_name, ' ')) AS tr, ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, left(c_name, 4) AS l4, right(c_name, 4) AS r4, repeat(left(c_name, 1), 3) AS re, reverse(c_name) AS rv, replace(c_name, '0', 'z') AS rp0, translate(c_name, '0123', 'abcd') AS tl FROM customer", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, concat(upper(left(c_mktsegment, 1)), lower(substr(c_mktsegment, 2))) AS ic, trim(concat('  ', c_name, ' ')) AS tr, ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, left(c_name, 4) AS l4, right(c_name, 4) AS r4, repeat(left(c_name, 1), 3) AS re, reverse(c_name) AS rv, replace(c_name, '0', 'z') AS rp0, translate(c_name, '0123', 'abcd') AS tl FROM customer"),
    "string_search_fn": ("D35", "SELECT p_partkey, contains(p_name, 'a') AS c, startswith(p_name, 'P') AS s, endswith(p_type, 'L') AS e, CAST(locate('a', p_name) AS BIGINT) AS l, CAST(position('r' IN p_type) AS BIGINT) AS p, CAST(find_in_set('b', 'a,b,c') AS BIGINT) AS f FROM part", "SELECT p_partkey, contains(p_name, 'a') AS c, starts_with(p_name, 'P') AS s, ends_with(p_type, 'L') AS e, CAST(strpos(p_name, 'a') AS BIGINT) AS l, CAST(position('r' IN p_type) AS BIGINT) AS p, CAST(list_position(string_split('a,b,c', ','), 'b') AS BIGINT) AS f FROM part"),
    "string_slice_fn": ("D36", "SELECT c_custkey, substr(c_name, 2, 5) AS s, split_part(c_name, '#', 2) AS p, substring_index(c_name, '#', 1) AS i FROM customer", "SELECT c_custkey, substr(c_name, 2, 5) AS s, split_part(c_name, '#', 2) AS p, split_part(c_name, '#', 1) AS i FROM customer"),
    "string_measure_fn": ("D37", "SELECT doc_id, CAST(char_length(text) AS BIGINT) AS n, CAST(octet_length(text) AS BIGINT) AS o, CAST(bit_length(text) AS BIGINT) AS b, CAST(ascii(lang) AS BIGINT) AS a, CAST(levenshtein(lang, source) AS BIGINT) AS d, lower(hex(doc_id)) AS h, chr(65) AS c FROM documents", "SELECT doc_id, length(text) AS n, strlen(text) AS o, strlen(text) * 8 AS b, ascii(lang)::BIGINT AS a, levenshtein(lang, source) AS d, lower(to_hex(doc_id)) AS h, chr(65) AS c FROM documents"),
    "concat_fn": ("D38", "SELECT event_id, concat_ws('', event_type, NULL, '!') AS skip, concat_ws('-', event_type, CAST(user_id AS STRING)) AS ws, event_type || '/' || user_id AS op FROM events", "SELECT event_id, concat(event_type, NULL, '!') AS skip, concat_ws('-', event_type, user_id) AS ws, event_type || '/' || user_id AS op FROM events"),
    "regex_fn": ("D39", "SELECT c_custkey, regexp_like(c_name, '[5-9]$') AS l, regexp_extract(c_name, '([0-9]+)', 1) AS x, regexp_replace(c_name, '[0-9]', '') AS r, CAST(regexp_count(c_name, '0') AS BIGINT) AS n FROM customer", "SELECT c_custkey, regexp_matches(c_name, '[5-9]$') AS l, regexp_extract(c_name, '([0-9]+)', 1) AS x, regexp_replace(c_name, '[0-9]', '', 'g') AS r, len(regexp_extract_all(c_name, '0')) AS n FROM customer"),
    "math_fn": ("D40", "SELECT event_id, round(abs(-value), 4) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 6) AS q, round(cbrt(value), 6) AS cb, round(exp(value / 1000), 6) AS e, round(ln(value + 1), 6) AS ln, round(log2(value + 1), 6) AS l2, round(log10(value + 1), 6) AS l10, round(power(value, 2), 2) AS p, sign(value - 50) AS s, round(degrees(radians(value)), 4) AS dr, round(sin(value) + cos(value) + atan(value), 6) AS t, CAST(factorial(event_id % 10) AS BIGINT) AS fa, round(pi(), 6) AS pi FROM events", "SELECT event_id, round(abs(-value), 4) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 6) AS q, round(cbrt(value), 6) AS cb, round(exp(value / 1000), 6) AS e, round(ln(value + 1), 6) AS ln, round(log2(value + 1), 6) AS l2, round(log10(value + 1), 6) AS l10, round(power(value, 2), 2) AS p, sign(value - 50)::DOUBLE AS s, round(degrees(radians(value)), 4) AS dr, round(sin(value) + cos(value) + atan(value), 6) AS t, CAST(factorial((event_id % 10)::INT) AS BIGINT) AS fa, round(pi(), 6) AS pi FROM events"),
    "modulo": ("D42", "SELECT event_id, (event_id - 100) % 7 AS m, (event_id - 100) div 7 AS q, pmod(event_id - 100, 7) AS pm FROM events", "SELECT event_id, (event_id - 100) % 7 AS m, (event_id - 100) // 7 AS q, ((event_id - 100) % 7 + 7) % 7 AS pm FROM events"),
    "date_part_fn": ("D44", "SELECT event_id, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(MONTH FROM ts) AS BIGINT) AS m, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(date_part('DAY', ts) AS BIGINT) AS d, CAST(dayofweek(ts) - 1 AS BIGINT) AS dow, CAST(date_trunc('HOUR', ts) AS STRING) AS t FROM events", "SELECT event_id, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS m, extract(HOUR FROM ts) AS h, date_part('DAY', ts) AS d, dayofweek(ts) AS dow, strftime(date_trunc('HOUR', ts), '%Y-%m-%d %H:%M:%S') AS t FROM events"),
    "date_bin": ("D45", "SELECT window(ts, '15 minutes').start AS b, count(*) AS n FROM events GROUP BY window(ts, '15 minutes')", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, count(*) AS n FROM events GROUP BY 1"),
    "date_convert_fn": ("D46", "SELECT o_orderkey, to_date(o_orderdate) AS d, date_format(o_orderdate, 'yyyy/MM/dd') AS f, datediff(o_orderdate, DATE'1990-01-01') AS n, make_date(year(o_orderdate), month(o_orderdate), 1) AS m, CAST(unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS u FROM orders", "SELECT o_orderkey, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y/%m/%d') AS f, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS n, make_date(year(o_orderdate), month(o_orderdate), 1) AS m, epoch(o_orderdate)::BIGINT AS u FROM orders"),
    "interval_fn": ("D47", "SELECT event_id, CAST(ts - INTERVAL '1' HOUR + INTERVAL '2' DAY AS STRING) AS t FROM events", "SELECT event_id, rtrim(rtrim(strftime(ts - INTERVAL '1' HOUR + INTERVAL '2' DAY, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS t FROM events"),
    "array_fn": ("D48 D49 D50 D51 D52 D53", "SELECT k, CAST(size(a) AS BIGINT) AS n, element_at(a, 2) AS e, CAST(array_position(a, 3) AS BIGINT) AS p, array_contains(a, 4) AS c, arrays_overlap(a, array(2, 99)) AS o, size(array_except(array(1, 2), a)) = 0 AS all_, array_join(transform(slice(a, 2, 2), x -> cast(x AS string)), ',') AS s, array_join(transform(array_union(a, array(1, 77)), x -> cast(x AS string)), ',') AS u, array_join(transform(array_remove(a, 3), x -> cast(x AS string)), ',') AS r, array_join(transform(reverse(a), x -> cast(x AS string)), ',') AS rv, array_min(a) AS mn, array_max(a) AS mx, array_join(array_append(split('x,y', ','), 'z'), '+') AS ap FROM (SELECT n_nationkey AS k, sequence(1, 1 + n_nationkey % 6 + 1) AS a FROM nation)", "SELECT k, len(a) AS n, a[2] AS e, coalesce(list_position(a, 3), 0)::BIGINT AS p, list_contains(a, 4) AS c, list_has_any(a, [2, 99]) AS o, list_has_all(a, [1, 2]) AS all_, array_to_string(a[2:3], ',') AS s, array_to_string(a || list_filter([1, 77], lambda x: NOT list_contains(a, x)), ',') AS u, array_to_string(list_filter(a, lambda x: x <> 3), ',') AS r, array_to_string(list_reverse(a), ',') AS rv, list_min(a) AS mn, list_max(a) AS mx, array_to_string(list_append(string_split('x,y', ','), 'z'), '+') AS ap FROM (SELECT n_nationkey AS k, range(1, 1 + n_nationkey % 6 + 2)::INT[] AS a FROM nation)"),
    "unnest": ("D54 A11", "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "map_fn": ("D55", "SELECT k, element_at(m, 'a') AS a, element_at(m, 'z') AS z, array_join(sort_array(map_keys(m)), ',') AS ks, CAST(size(map_values(m)) AS BIGINT) AS n, CAST(size(map_entries(m)) AS BIGINT) AS e FROM (SELECT n_nationkey AS k, map_from_arrays(array('a', 'b'), array(n_nationkey, n_regionkey)) AS m FROM nation)", "SELECT n_nationkey AS k, n_nationkey AS a, NULL::INT AS z, 'a,b' AS ks, 2::BIGINT AS n, 2::BIGINT AS e FROM nation"),
    "struct_fn": ("D56 P16", "SELECT k, s.a AS a, s.b.c AS c, named_struct('x', k).x AS x FROM (SELECT n_nationkey AS k, named_struct('a', n_name, 'b', named_struct('c', n_regionkey)) AS s FROM nation)", "SELECT k, s.a AS a, s.b.c AS c, k AS x FROM (SELECT n_nationkey AS k, {'a': n_name, 'b': {'c': n_regionkey}} AS s FROM nation)"),
    "hash_fn": ("D57 K16", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s, base64(encode(lang, 'UTF-8')) AS b, lower(hex(lang)) AS h FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, base64(encode(lang)) AS b, lower(hex(lang)) AS h FROM documents"),
    "json_fn": ("D58 F13", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1, to_json(named_struct('k', from_json(props, 'k BIGINT').k)) AS j FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events"),
    "tumbling_window": ("T20", "SELECT window(ts, '1 hour').start AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "session_window": ("T20", "SELECT user_id, session_window(ts, '2 hours').start AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '2 hours')", "WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2' HOUR THEN 0 ELSE 1 END AS new FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s"),
    "count_min_max_index": ("A4 A6 A7", "SELECT count(*) AS n, min(event_id) AS lo, max(event_id) + 1 AS next FROM events", None),
    "approx_distinct": ("D16 A3", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near, abs(hll_sketch_estimate(hll_sketch_agg(user_id)) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS sketch_near FROM events GROUP BY event_type", "SELECT event_type, true AS near, true AS sketch_near FROM events GROUP BY event_type"),
    "approx_percentile": ("D15", "SELECT l_returnflag, forall(sequence(0, 2), i -> abs(a[i] - e[i]) <= 0.01 * e[i]) AS near FROM (SELECT l_returnflag, approx_percentile(l_extendedprice, array(0.25, 0.5, 0.75)) AS a, percentile(l_extendedprice, array(0.25, 0.5, 0.75)) AS e FROM lineitem GROUP BY l_returnflag)", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag"),
    "now_fn": ("D43", "SELECT event_id, current_date() >= DATE'2020-01-01' AS d, now() > TIMESTAMP'2020-01-01 00:00:00' AS n, CAST(length(uuid()) AS BIGINT) AS u, rand() < 1 AS r FROM events", "SELECT event_id, true AS d, true AS n, 36::BIGINT AS u, true AS r FROM events"),
    "last_entry": ("W4", "SELECT conv_id, max_by(md5(text), turn) AS last FROM conversations GROUP BY conv_id", "SELECT conv_id, arg_max(md5(text), turn) AS last FROM conversations GROUP BY conv_id"),
}


def runner(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_tables(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}, sql) if used else spark.sql(sql)

    query.__name__ = name
    return query


def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both row numbers of the SQL text by range shuffles; a window without partitions would put all rows into one task."""
    rows = with_tables(spark, {"events": spark.read.parquet(f"{sf_dir}/events.parquet")}, "SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS v FROM events")
    up = with_index(rows, [F.col("v").asc_nulls_last(), "k"], 1, "a")
    return with_index(up, [F.col("v").desc_nulls_first(), "k"], 1, "d").select("k", "a", "d")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: runner(k, v[1]) for k, v in CATALOGUE.items()} | {f.__name__: f for f in (order_nulls,)}


def oracle_sql() -> dict[str, str]:
    return {k: other or sql for k, (_, sql, other) in CATALOGUE.items()}
