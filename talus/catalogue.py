"""A query for each operator and function: its SQL of the dialect, and the SQL of the oracle where that differs. None: no oracle, rows alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import aggregates, joins, windows
from .session import configure, table

SAME = "same"
SQL: dict[str, tuple[str, str | None]] = {}
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def q(name: str, sql: str, oracle: str | None = SAME) -> None:
    SQL[name] = (sql, sql if oracle == SAME else oracle)


def frame(name: str, oracle: str | None):
    def keep(f):
        FRAMES[name] = (f, oracle)
        return f

    return keep


# scans and filters
q("flagship_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
q("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
q("filter_between_symmetric", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN SYMMETRIC 90000 AND 50000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000")
q("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)")
q("filter_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_%' AND p_name NOT LIKE 'z%'")
q("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%BUILD%'")
q("filter_similar_to", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)_'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')")
q("filter_regex", "SELECT p_partkey FROM part WHERE p_type ~ '^[A-M]' AND p_type !~* 'xyz' AND p_brand ~* 'BRAND'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M]') AND NOT regexp_matches(p_type, '(?i)xyz') AND regexp_matches(p_brand, '(?i)BRAND')")
q("filter_starts_with", "SELECT p_partkey FROM part WHERE p_brand ^@ 'Brand#1' OR starts_with(p_type, 'STD')", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_type, 'STD')")
q("filter_is_distinct", "SELECT event_id FROM events WHERE nullif(event_type, 'view') IS DISTINCT FROM nullif(event_type, 'click')")
q("filter_is_not_distinct", "SELECT event_id FROM events WHERE nullif(event_type, 'view') IS NOT DISTINCT FROM NULL")
q("filter_bool_test", "SELECT event_id FROM events WHERE (nullif(event_type, 'view') = 'click') IS NOT TRUE AND (value > 1) IS TRUE AND (value < 0) IS FALSE")
q("filter_null_logic", "SELECT event_id FROM events WHERE NOT (nullif(event_type, 'view') = 'click') OR nullif(event_type, 'error') IS NULL")
q("filter_index_key", "SELECT * FROM orders WHERE o_orderkey = 7")
q("row_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity, l_linenumber) < (25, 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25 OR l_quantity = 25 AND l_linenumber < 3")
q("values_table", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)")
q("result_row", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab")
q("select_star_alias", "SELECT * FROM region AS r(k, n)")
q("subquery_scan", "SELECT s.k, s.n FROM (SELECT r_regionkey AS k, r_name AS n FROM region) AS s WHERE s.k > 1")
q("tablesample", "SELECT l_orderkey FROM lineitem TABLESAMPLE BERNOULLI (10)", None)
q("virtual_catalog", "SELECT table_name FROM information_schema.tables", None)
# projections
q("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c FROM orders")
q("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS c FROM orders")
q("coalesce_nullif", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS c FROM events")
q("greatest_least", "SELECT p_partkey, greatest(p_size, 10) AS g, least(p_retailprice, 1000.5) AS l FROM part", "SELECT p_partkey, greatest(p_size, 10) AS g, least(p_retailprice, 1000.5::DOUBLE) AS l FROM part")
q("cast_matrix", "SELECT p_partkey, p_size::TEXT AS a, p_size::BIGINT AS b, CAST(p_retailprice AS INT) AS d, '12'::INT + p_size AS e, CAST(p_size AS DOUBLE PRECISION) AS f, '2020-01-05'::DATE AS g, (p_size > 3)::TEXT AS h FROM part", "SELECT p_partkey, p_size::VARCHAR AS a, p_size::BIGINT AS b, CAST(trunc(p_retailprice) AS INT) AS d, 12 + p_size AS e, CAST(p_size AS DOUBLE) AS f, DATE '2020-01-05' AS g, (p_size > 3)::VARCHAR AS h FROM part")
q("arith_int_div", "SELECT l_orderkey, l_linenumber, div(l_orderkey, 3) AS d, l_orderkey % 7 AS m, -l_linenumber AS n, 7 / 2 AS h FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 3 AS d, l_orderkey % 7 AS m, -l_linenumber AS n, (7 // 2)::BIGINT AS h FROM lineitem")
q("arith_decimal", "SELECT p_partkey, CAST(p_retailprice AS NUMERIC(12, 2)) * 2 AS a, CAST(p_retailprice AS NUMERIC(12, 2)) + CAST(1.5 AS NUMERIC(12, 2)) AS b FROM part", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) * 2 AS DECIMAL(14, 2)) AS a, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) + CAST(1.5 AS DECIMAL(12, 2)) AS DECIMAL(13, 2)) AS b FROM part")
# joins
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
q("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000")
q("join_full", "SELECT s_suppkey, n_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_implicit", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
q("join_theta", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
q("join_using", "SELECT r_regionkey, a.r_name FROM region a JOIN region b USING (r_regionkey)")
q("join_multiway_reorder", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 1) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name")
q("join_lateral_topk", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS t")
q("join_lateral_left", "SELECT c_custkey, t.m FROM customer LEFT JOIN LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) AS t ON true")
q("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
q("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
q("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
q("not_in_null_aware", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, -1) FROM supplier)")
q("any_quantified", "SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT p_retailprice + 50 FROM part WHERE p_size = 3) AND p_size = ANY (ARRAY[3, 4, 5])")
q("all_quantified", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 3) AND p_size <> ALL (SELECT 7)")
q("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
q("scalar_subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
# aggregates
q("agg_count", "SELECT event_type, count(*) AS n, count(nullif(user_id, 5)) AS m FROM events GROUP BY event_type")
q("agg_sum", "SELECT l_linestatus, round(sum(l_tax), 3) AS s, CAST(sum(l_linenumber) AS BIGINT) AS i FROM lineitem GROUP BY l_linestatus")
q("agg_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
q("agg_min_max", "SELECT min(o_totalprice) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS c FROM orders")
q("agg_bool", "SELECT event_type, bool_and(value > 1) AS a, every(value >= 0) AS e, bool_or(value > 99) AS o FROM events GROUP BY event_type", "SELECT event_type, bool_and(value > 1) AS a, bool_and(value >= 0) AS e, bool_or(value > 99) AS o FROM events GROUP BY event_type")
q("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
q("agg_filter", "SELECT count(*) FILTER (WHERE value > 50) AS a, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS b FROM events")
q("agg_string", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey")
q("agg_array", "SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS a FROM nation GROUP BY n_regionkey")
q("agg_json", "SELECT n_regionkey, json_agg(n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
q("agg_json_object", "SELECT n_regionkey, json_object_agg(n_name, n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
q("agg_xml", "SELECT n_regionkey, xmlagg(xmlelement(NAME n, n_name)) AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY '<n>' || n_name || '</n>') AS x FROM nation GROUP BY n_regionkey")
for _f in ("stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop"):
    q(f"agg_{_f}", f"SELECT l_returnflag, round({_f}(l_quantity), 6) AS x FROM lineitem GROUP BY l_returnflag")
for _f in ("corr", "covar_pop", "covar_samp", "regr_slope", "regr_intercept", "regr_r2", "regr_avgx", "regr_avgy", "regr_sxx", "regr_syy", "regr_sxy"):
    q(f"agg_{_f}", f"SELECT l_returnflag, round({_f}(l_discount, l_quantity), 4) + 0.0 AS x FROM lineitem GROUP BY l_returnflag")
q("agg_regr_count", "SELECT l_returnflag, CAST(regr_count(l_discount, nullif(l_quantity, 1)) AS BIGINT) AS x FROM lineitem GROUP BY l_returnflag")
q("agg_percentile_cont", "SELECT l_returnflag, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS x FROM lineitem GROUP BY l_returnflag")
q("agg_percentile_disc", "SELECT l_returnflag, percentile_disc(0.3) WITHIN GROUP (ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY l_returnflag")
q("agg_mode", "SELECT mode() WITHIN GROUP (ORDER BY event_type) AS m FROM (SELECT event_type FROM events UNION ALL SELECT 'view' FROM events) AS e", "SELECT mode(event_type ORDER BY event_type) AS m FROM (SELECT event_type FROM events UNION ALL SELECT 'view' FROM events) AS e")
q("agg_hyp_rank", "SELECT p_brand, rank(30) WITHIN GROUP (ORDER BY p_size) AS x FROM part GROUP BY p_brand", "SELECT p_brand, count(*) FILTER (WHERE p_size < 30) + 1 AS x FROM part GROUP BY p_brand")
q("agg_hyp_dense_rank", "SELECT p_brand, dense_rank(30) WITHIN GROUP (ORDER BY p_size) AS x FROM part GROUP BY p_brand", "SELECT p_brand, count(DISTINCT p_size) FILTER (WHERE p_size < 30) + 1 AS x FROM part GROUP BY p_brand")
q("agg_hyp_percent_rank", "SELECT p_brand, round(percent_rank(30) WITHIN GROUP (ORDER BY p_size), 8) AS x FROM part GROUP BY p_brand", "SELECT p_brand, round(count(*) FILTER (WHERE p_size < 30) / count(p_size), 8) AS x FROM part GROUP BY p_brand")
q("agg_hyp_cume_dist", "SELECT p_brand, round(cume_dist(30) WITHIN GROUP (ORDER BY p_size), 8) AS x FROM part GROUP BY p_brand", "SELECT p_brand, round((count(*) FILTER (WHERE p_size <= 30) + 1) / (count(p_size) + 1), 8) AS x FROM part GROUP BY p_brand")
q("agg_empty", "SELECT count(*) AS n, sum(l_tax) AS s, max(l_orderkey) AS m FROM lineitem WHERE l_orderkey < 0")
q("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
q("group_expression", "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate)")
q("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()) HAVING count(*) > 10")
q("rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 1) AS s, CAST(grouping(o_orderpriority) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("cube", "SELECT l_returnflag, l_linestatus, round(avg(l_tax), 6) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
# windows
_w = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
for _n, _f in (("row_number", "CAST(row_number() {} AS BIGINT)"), ("rank", "CAST(rank() {} AS BIGINT)"), ("dense_rank", "CAST(dense_rank() {} AS BIGINT)"), ("percent_rank", "round(percent_rank() {}, 9)"), ("cume_dist", "round(cume_dist() {}, 9)"), ("ntile", "CAST(ntile(4) {} AS BIGINT)"), ("lag", "lag(o_totalprice, 2, -1.0::DOUBLE PRECISION) {}"), ("lead", "lead(o_orderkey) {}"), ("first", "first_value(o_orderkey) {}"), ("last", "last_value(o_orderkey) {}"), ("nth", "nth_value(o_orderkey, 2) {}"), ("count", "count(*) {}"), ("sum", "round(sum(o_totalprice) {}, 2)"), ("avg", "round(avg(o_totalprice) {}, 6)"), ("min", "min(o_totalprice) {}"), ("max", "max(o_orderkey) {}"), ("stddev", "round(stddev_pop(o_totalprice) {}, 3)")):
    q(f"win_{_n}", f"SELECT o_orderkey, {_f.format(_w)} AS x FROM orders", f"SELECT o_orderkey, {_f.format(_w)} AS x FROM orders".replace("DOUBLE PRECISION", "DOUBLE"))
q("win_sum_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS x FROM events")
q("win_avg_range", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS x FROM part")
q("win_count_distinct", "SELECT p_partkey, count(DISTINCT p_size) OVER (PARTITION BY p_brand) AS x FROM part")
q("win_named", "SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS r, count(*) OVER w AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)")
q("win_over_aggregate", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey")
q("win_whole_partition", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 5) AS x FROM events")
# set operations, order
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
q("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
q("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
q("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
q("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 17")
q("order_offset", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10 OFFSET 25")
q("order_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC OFFSET 3 ROWS FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 3")
q("order_nulls", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'view'), event_id) AS n FROM events", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'view') NULLS LAST, event_id) AS n FROM events")
q("for_update", "SELECT r_name FROM region FOR UPDATE", "SELECT r_name FROM region")
# common table expressions
q("cte_simple", "WITH b AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM b WHERE s > 100000")
q("cte_multi", "WITH a(k) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), b AS (SELECT k FROM a WHERE k > 5) SELECT c_custkey FROM customer JOIN b ON c_nationkey = b.k")
q("cte_recursive_counter", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 400) SELECT CAST(sum(n) AS BIGINT) AS s FROM t")
q("cte_recursive_hierarchy", "WITH RECURSIVE t(k, d) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT p_partkey, d + 1 FROM t JOIN part ON p_partkey IN (2 * k, 2 * k + 1)) SELECT k, d FROM t")
q("cte_recursive_distinct", "WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT (n_nationkey * 7 + 3) % 25 FROM nation JOIN t ON n_nationkey = t.k) SELECT k FROM t")
# strings
_D = "SELECT doc_id, {} AS x FROM documents"
for _n, _s, _o in (
    ("length", "CAST(length(text) AS BIGINT)", SAME), ("octet_length", "octet_length(text)", "CAST(octet_length(encode(text)) AS INT)"), ("bit_length", "bit_length(text)", "CAST(bit_length(text) AS INT)"), ("upper", "upper(source || lang)", SAME), ("lower", "lower(text)", SAME),
    ("concat", "concat(lang, NULL, '-', source)", SAME), ("concat_ws", "concat_ws('/', lang, NULL, source)", SAME), ("pipe", "lang || '_' || source", SAME), ("substring", "substring(text, 3, 9)", SAME), ("substring_from", "substring(text FROM 2 FOR 5)", SAME),
    ("trim", "trim('  ' || lang || ' ')", SAME), ("btrim", "btrim('xx' || lang || 'x', 'x')", "trim('xx' || lang || 'x', 'x')"), ("ltrim", "ltrim('xy' || lang, 'yx')", SAME), ("rtrim", "rtrim(lang || 'xyx', 'xy')", SAME), ("replace", "replace(text, 'e', '<E>')", SAME),
    ("position", "CAST(position('an' in text) AS BIGINT)", SAME), ("strpos", "CAST(strpos(text, 'th') AS BIGINT)", SAME), ("left", "left(text, 7)", SAME), ("right", "right(text, 7)", SAME), ("lpad", "lpad(lang, 6, '*-')", SAME), ("rpad", "rpad(source, 9, '.')", SAME), ("repeat", "repeat(lang, 3)", SAME),
    ("reverse", "reverse(text)", SAME), ("split_part", "split_part(text, ' ', 2)", SAME), ("translate", "translate(text, 'aeiou', '12345')", SAME), ("ascii", "ascii(text)", "CAST(ascii(text) AS INT)"), ("chr", "chr(65 + CAST(doc_id % 26 AS INT))", SAME), ("md5", "md5(text)", SAME),
    ("overlay", "overlay(lang placing 'ZZ' from 2 for 1)", "left(lang, 1) || 'ZZ' || substring(lang, 3)"), ("format", "format('%s|%L|%%', lang, source)", "lang || '|''' || source || '''|%'"), ("encode_hex", "encode(lang, 'hex')", "lower(hex(lang))"), ("encode_base64", "encode(lang, 'base64')", "base64(encode(lang))"),
    ("decode", "CAST(decode(encode(lang, 'hex'), 'hex') AS TEXT)", "lang"), ("regexp_replace", "regexp_replace(text, '([a-z])e', '[\\1]')", "regexp_replace(text, '([a-z])e', '[\\1]')"), ("regexp_replace_all", "regexp_replace(text, 'E', '_', 'gi')", SAME),
    ("regexp_match", "regexp_match(text, '(th[a-z]+)')", "CASE WHEN regexp_matches(text, '(th[a-z]+)') THEN regexp_extract(text, '(th[a-z]+)', 1) END"), ("starts_with", "starts_with(text, 'T')", SAME), ("to_char_number", "to_char(n_chars * 1.5, '999,999.99')", "format('{:,.2f}', n_chars * 1.5)"),
    ("to_number", "CAST(to_number('$1,' || lpad(CAST(doc_id % 1000 AS TEXT), 3, '0'), '9,999') AS DOUBLE PRECISION)", "CAST(1000 + doc_id % 1000 AS DOUBLE)"), ("string_to_array", "string_to_array(source || ',b', ',')", "string_split(source || ',b', ',')"), ("initcap", "initcap(lang)", "upper(left(lang, 1)) || substring(lang, 2)"),
    ("num_nulls", "num_nulls(lang, nullif(lang, 'en'), NULL)", "CASE WHEN lang = 'en' THEN 2 ELSE 1 END"), ("num_nonnulls", "num_nonnulls(lang, nullif(lang, 'en'), NULL)", "CASE WHEN lang = 'en' THEN 1 ELSE 2 END"),
):
    q(f"fn_string_{_n}", _D.format(_s), SAME if _o == SAME else _D.format(_o))
q("fn_string_uuid", "SELECT gen_random_uuid() AS x FROM region", None)
# dates
_O = "SELECT o_orderkey, {} AS x FROM orders"
for _n in ("year", "month", "day", "hour", "minute", "dow", "doy", "week", "quarter", "epoch", "second", "milliseconds", "microseconds"):
    q(f"fn_date_extract_{_n}", f"SELECT event_id, CAST(extract({_n} FROM ts) AS DOUBLE PRECISION) AS x FROM events", f"SELECT event_id, CAST({'extract(second FROM ts) + (extract(microseconds FROM ts) % 1000000) / 1e6' if _n == 'second' else f'extract({_n} FROM ts)' if _n != 'milliseconds' else 'extract(microseconds FROM ts) / 1000'} AS DOUBLE) AS x FROM events")
q("fn_date_part", _O.format("date_part('month', o_orderdate)"), _O.format("CAST(date_part('month', o_orderdate) AS DOUBLE)"))
for _n in ("hour", "day", "week", "month", "quarter", "year"):
    q(f"fn_date_trunc_{_n}", f"SELECT event_id, CAST(date_trunc('{_n}', ts) AS TIMESTAMP) AS x FROM events")
q("fn_date_age", _O.format("age(TIMESTAMP '2003-05-20', o_orderdate)"), None)
q("fn_date_age_months", _O.format("age_months(TIMESTAMP '2003-05-20', o_orderdate)"), _O.format("CAST(datesub('month', o_orderdate, TIMESTAMP '2003-05-20') AS INT)"))
q("fn_date_plus_interval", _O.format("o_orderdate + INTERVAL '1 month 3 days 02:30:00'"), _O.format("o_orderdate + INTERVAL '1 month' + INTERVAL '3 days' + INTERVAL '150 minutes'"))
q("fn_date_minus_interval", _O.format("o_orderdate - INTERVAL '2' DAY"), _O.format("o_orderdate - INTERVAL 2 DAY"))
q("fn_date_interval_cast", _O.format("o_orderdate + '1 year 2 hours'::interval"), _O.format("o_orderdate + INTERVAL '1 year' + INTERVAL '2 hours'"))
q("fn_date_interval_text", "SELECT o_orderkey, interval_text(CAST(o_orderkey % 30 AS INT), o_orderkey * 1000000) AS x FROM orders", None)
q("fn_date_to_char", _O.format("to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS')"), _O.format("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"))
q("fn_date_to_date", _O.format("to_date(to_char(o_orderdate, 'DD/MM/YYYY'), 'DD/MM/YYYY')"), _O.format("CAST(o_orderdate AS DATE)"))
q("fn_date_to_timestamp", _O.format("to_timestamp(to_char(o_orderdate, 'YYYY-MM-DD HH24:MI'), 'YYYY-MM-DD HH24:MI')"), _O.format("date_trunc('minute', o_orderdate)"))
q("fn_date_to_timestamp_epoch", _O.format("to_timestamp(o_orderkey)"), _O.format("CAST(make_timestamp(o_orderkey * 1000000) AS TIMESTAMP)"))
q("fn_date_parse", "SELECT parse_timestamp('2020-03-04 05:06') AS a, parse_timestamp('03/04/2020') AS b, parse_timestamp('nothing') AS c", "SELECT TIMESTAMP '2020-03-04 05:06:00' AS a, TIMESTAMP '2020-03-04 00:00:00' AS b, CAST(NULL AS TIMESTAMP) AS c")
q("fn_date_difference", _O.format("CAST(extract(epoch FROM TIMESTAMP '2003-01-01') - extract(epoch FROM o_orderdate) AS BIGINT)"), _O.format("CAST(epoch(TIMESTAMP '2003-01-01') - epoch(o_orderdate) AS BIGINT)"))
q("fn_date_now", "SELECT now() >= TIMESTAMP '2020-01-01' AS a, current_date >= DATE '2020-01-01' AS b")
# math
_P = "SELECT p_partkey, {} AS x FROM part"
for _n, _s, _o in (
    ("abs", "abs(p_size - 20)", SAME), ("ceil", "CAST(ceil(p_retailprice / 7) AS BIGINT)", SAME), ("floor", "CAST(floor(p_retailprice / 7) AS BIGINT)", SAME), ("round", "round(p_retailprice / 7, 2)", SAME), ("trunc", "CAST(trunc(p_retailprice - 1000) AS BIGINT)", SAME), ("mod", "mod(p_partkey, 7)", SAME),
    ("power", "round(power(p_size, 2.0), 6)", SAME), ("sqrt", "round(sqrt(p_retailprice), 9)", SAME), ("cbrt", "round(cbrt(p_retailprice), 9)", SAME), ("exp", "round(exp(p_size / 10.0), 6)", SAME), ("sign", "CAST(sign(p_size - 20) AS INT)", SAME), ("pi", "round(pi() * p_size, 9)", SAME),
    ("ln", "round(ln(p_retailprice), 9)", SAME), ("log", "round(log(p_retailprice), 9)", "round(log10(p_retailprice), 9)"), ("log_base", "round(log(2.0, p_retailprice), 9)", "round(log2(p_retailprice), 9)"), ("log10", "round(log10(p_retailprice), 9)", SAME),
):
    q(f"fn_math_{_n}", _P.format(_s), SAME if _o == SAME else _P.format(_o))
q("fn_math_random", "SELECT random() < 1.0 AS x FROM part")
# arrays
for _n, _s, _o in (
    ("constructor", "ARRAY[p_size, 1, 2]", "[p_size, 1, 2]"), ("subscript", "(ARRAY[p_size, 11, 12])[2]", "([p_size, 11, 12])[2]"), ("subscript_beyond", "(ARRAY[p_size])[5]", "([p_size])[5]"), ("slice", "(ARRAY[p_size, 11, 12, 13])[2:3]", "([p_size, 11, 12, 13])[2:3]"), ("concat", "ARRAY[p_size] || ARRAY[9]", "[p_size] || [9]"),
    ("contains", "ARRAY[p_size, 1] @> ARRAY[1]", SAME), ("contained", "ARRAY[p_size] <@ ARRAY[1, 2, 3, 4, 5]", "list_has_all([1, 2, 3, 4, 5], [p_size])"), ("overlap", "ARRAY[p_size, 7] && ARRAY[3, 4]", "list_has_any([p_size, 7], [3, 4])"), ("append", "array_append(ARRAY[p_size], 3)", "list_append([p_size], 3)"),
    ("length", "array_length(ARRAY[p_size, 1], 1)", "2"), ("literal", "'{3,4}'::int[]", "[3, 4]"), ("to_string", "array_to_string(string_to_array(p_name, ' '), '-')", "array_to_string(string_split(p_name, ' '), '-')"),
):
    q(f"fn_array_{_n}", _P.format(_s), SAME if _o == SAME else _P.format(_o))
q("fn_array_unnest", "SELECT p_partkey, unnest(string_to_array(p_name, ' ')) AS w FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
q("unnest_embedding", "SELECT vec_id, round(sum(CAST(e AS DOUBLE PRECISION)), 3) AS s FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) AS u GROUP BY vec_id", "SELECT vec_id, round(sum(e), 3) AS s FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) AS u GROUP BY vec_id")
# JSON
_E = "SELECT event_id, {} AS x FROM events"
for _n, _s, _o in (
    ("arrow", "props -> 'k'", "CAST(props -> '$.k' AS VARCHAR)"), ("arrow_text", "CAST(props ->> 'k' AS INT)", "CAST(props ->> '$.k' AS INT)"), ("hash_arrow", "CAST(props #>> '{k}' AS INT)", "CAST(props ->> '$.k' AS INT)"), ("chain", "('{\"a\":[1,{\"b\":\"z\"}]}' -> 'a' -> 1 ->> 'b') || event_type", "'z' || event_type"), ("contains", "props @> '{\"k\":5}'", "CAST(props ->> '$.k' AS INT) = 5"),
    ("contained", "'{\"k\":5}' <@ props", "CAST(props ->> '$.k' AS INT) = 5"), ("exists", "props ? 'k'", "json_exists(props, '$.k')"), ("exists_any", "props ?| ARRAY['z', 'k']", "json_exists(props, '$.k')"), ("exists_all", "props ?& ARRAY['z', 'k']", "json_exists(props, '$.k') AND json_exists(props, '$.z')"),
    ("delete", "props - 'k'", "'{}'"), ("delete_path", "'{\"a\":{\"b\":1,\"c\":2}}' #- '{a,b}'", "'{\"a\":{\"c\":2}}'"), ("extract_path_text", "json_extract_path_text(props, 'k')", "props ->> '$.k'"), ("array_length", "json_array_length('[1,2,3]')", "3"), ("typeof", "json_typeof(props)", "'object'"),
    ("build_object", "json_build_object('id', event_id, 'n', NULL)", "'{\"id\":' || event_id || ',\"n\":null}'"), ("to_json", "to_json(event_type)", "'\"' || event_type || '\"'"),
):
    q(f"json_{_n}", _E.format(_s), _E.format(_o))
q("json_row_to_json", "SELECT r_regionkey, row_to_json(struct(r_regionkey, r_name)) AS j FROM region", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")
# text search
q("fts_match", "SELECT doc_id FROM documents WHERE to_tsvector('simple', text) @@ to_tsquery('the & of')", "SELECT doc_id FROM documents WHERE list_has_all(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), ['the', 'of'])")
q("fts_boolean", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('(the | de) & !of')", "SELECT doc_id FROM (SELECT doc_id, list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) AS w FROM documents) WHERE list_has_any(w, ['the', 'de']) AND NOT list_contains(w, 'of')")
q("fts_phrase", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('of <-> the')", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> ''), ' ') || ' ', ' of the ')")
q("fts_rank", "SELECT doc_id, ts_rank(to_tsvector(text), plainto_tsquery('de la')) AS x FROM documents", "SELECT doc_id, CAST(list_has_all(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), ['de', 'la']) AS DOUBLE) AS x FROM documents")
q("fts_vector", "SELECT to_tsvector('The cat, the hat!') AS v, to_tsquery('a & b') AS t, ts_headline('x y') AS h", "SELECT '''the'':1,3 ''cat'':2 ''hat'':4' AS v, '''a'' & ''b''' AS t, 'x y' AS h")
# networks, ranges, XML, shapes
q("fn_network", "SELECT host('10.1.2.3/24') AS a, masklen('10.1.2.3/24') AS b, family('::1') AS c, network('10.1.2.3/24') AS d, broadcast('10.1.2.3/24') AS e", "SELECT '10.1.2.3' AS a, 24 AS b, 6 AS c, '10.1.2.0/24' AS d, '10.1.2.255/24' AS e")
q("fn_range", "SELECT p_partkey, int4range(p_size, p_size + 5) AS r, lower_range(int4range(p_size, 60)) AS l, isempty(int4range(3, 3)) AS e, range_contains(int4range(1, 10), p_size) AS c FROM part", "SELECT p_partkey, '[' || p_size || ',' || (p_size + 5) || ')' AS r, CAST(p_size AS VARCHAR) AS l, true AS e, p_size >= 1 AND p_size < 10 AS c FROM part WHERE p_size < 60")
q("fn_xml", "SELECT r_regionkey, xmlelement(NAME reg, r_name) AS a, xmlforest(r_name AS n, r_regionkey AS k) AS b, xmlconcat('<a/>', '<b/>') AS c FROM region", "SELECT r_regionkey, '<reg>' || r_name || '</reg>' AS a, '<n>' || r_name || '</n><k>' || r_regionkey || '</k>' AS b, '<a/><b/>' AS c FROM region")
q("fn_shapes", "SELECT p_partkey, point(p_size, 2) AS p, round(circle(point(0, 0), p_size) <-> point(3, 4), 6) AS d, round(area(circle(point(0, 0), 2)), 6) AS a, area(box(point(0, 0), point(2, 3))) AS b, npoints('((0,0),(1,1),(2,0))') AS n, isclosed('((0,0),(1,1))') AS c, pclose('[(0,0),(1,1)]') AS k, center(circle(point(1, 2), 3)) AS m, diameter(circle(point(1, 2), 3)) AS q, bound_box(box(point(0, 0), point(1, 1)), box(point(5, 5), point(2, 2))) AS bb FROM part", "SELECT p_partkey, '(' || p_size || ',2)' AS p, 5.0::DOUBLE AS d, round(4 * pi(), 6) AS a, 6.0::DOUBLE AS b, 3::BIGINT AS n, true AS c, '((0,0),(1,1))' AS k, '(1,2)' AS m, 6.0::DOUBLE AS q, '(5,5),(0,0)' AS bb FROM part")
q("fn_system", "SELECT pg_typeof(r_regionkey) AS t, has_table_privilege('region', 'select') AS h, pg_relation_size('region') AS s FROM region", "SELECT 'int' AS t, true AS h, 0::BIGINT AS s FROM region")


@frame("win_sum_groups", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS x FROM part")
def win_sum_groups(spark, d):
    return windows.groups_frame(table(spark, d, "part"), F.sum("p_size"), "x", ["p_brand"], ["p_size"], -1, 1).select("p_partkey", F.col("x").cast("long").alias("x"))


@frame("agg_custom", "SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS x FROM nation GROUP BY n_regionkey")
def agg_custom(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.fold(F.col("n_nationkey").cast("long"), F.lit(0).cast("long"), lambda a, v: a + v * v).alias("x"))


@frame("join_semi_frame", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi_frame(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return joins.semi(c, o, c["c_custkey"] == o["o_custkey"]).select("c_custkey")


@frame("join_range", "SELECT event_id, p_partkey FROM events JOIN part ON value >= p_size AND value < p_size + 2")
def join_range(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size").withColumn("high", F.col("p_size") + 2)
    return joins.range_join(table(spark, d, "events"), p, "value", "p_size", "high", 2).select("event_id", "p_partkey")


@frame("topk_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_key(spark, d):
    return windows.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def changed(*statements: str, result: str):
    """The rows of a query after statements that change tables; the tables themselves stay as they are."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        db = Engine(spark, d)
        for s in statements:
            db.sql(s)
        return db.sql(result)

    return run


def change(name: str, statements: list[str], result: str, oracle: str) -> None:
    FRAMES[name] = (changed(*statements, result=result), oracle)


change("dml_insert_values", ["INSERT INTO region VALUES (9, 'MARS'), (10, NULL)"], "SELECT * FROM region", "SELECT * FROM region UNION ALL VALUES (9, 'MARS'), (10, NULL)")
change("dml_insert_select", ["CREATE TABLE big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000", "INSERT INTO big SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 2000"], "SELECT * FROM big", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 OR o_totalprice < 2000")
change("dml_update", ["UPDATE customer SET c_acctbal = c_acctbal + 10, c_mktsegment = 'X' WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"], "SELECT c_custkey, round(c_acctbal, 2) AS b, c_mktsegment FROM customer", "SELECT c_custkey, round(CASE WHEN n_regionkey = 2 THEN c_acctbal + 10 ELSE c_acctbal END, 2) AS b, CASE WHEN n_regionkey = 2 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
change("dml_update_from", ["UPDATE supplier SET s_name = n_name FROM nation WHERE s_nationkey = n_nationkey AND n_regionkey <> 0"], "SELECT s_suppkey, s_name FROM supplier", "SELECT s_suppkey, CASE WHEN n_regionkey <> 0 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
change("dml_delete", ["DELETE FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)"], "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND coalesce(c_acctbal >= 0, true)")
change("dml_upsert_nothing", ["INSERT INTO nation SELECT n_nationkey + 20, 'new', 0 FROM nation ON CONFLICT (n_nationkey) DO NOTHING"], "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'new' FROM nation WHERE n_nationkey >= 5")
change("dml_upsert_update", ["INSERT INTO nation SELECT n_nationkey + 20, 'new', 0 FROM nation ON CONFLICT (n_nationkey) DO UPDATE SET n_name = nation.n_name || excluded.n_name"], "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN n_name || 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'new' FROM nation WHERE n_nationkey >= 5")
change("dml_truncate", ["TRUNCATE supplier"], "SELECT count(*) AS n FROM supplier", "SELECT 0::BIGINT AS n")
change("ddl_view", ["CREATE VIEW v AS SELECT n_name AS a, n_regionkey + 1 AS b FROM nation WHERE n_nationkey > 3"], "SELECT b, count(*) AS n FROM v GROUP BY b", "SELECT n_regionkey + 1 AS b, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
change("ddl_matview", ["CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM region", "DELETE FROM region WHERE r_regionkey = 0", "REFRESH MATERIALIZED VIEW m"], "SELECT n FROM m", "SELECT count(*) - 1 AS n FROM region")
change("ddl_alter", ["ALTER TABLE region ADD COLUMN x INT DEFAULT 4", "ALTER TABLE region RENAME COLUMN r_name TO nm", "ALTER TABLE region ALTER COLUMN x TYPE BIGINT"], "SELECT r_regionkey, nm, x FROM region", "SELECT r_regionkey, r_name AS nm, 4::BIGINT AS x FROM region")
change("ddl_partitions", ["CREATE TABLE e (k BIGINT, v TEXT) PARTITION BY LIST (v)", "CREATE TABLE e1 PARTITION OF e FOR VALUES IN ('view', 'click')", "CREATE TABLE e2 PARTITION OF e DEFAULT", "INSERT INTO e SELECT event_id, event_type FROM events"], "SELECT 1 AS p, count(*) AS n FROM e1 UNION ALL SELECT 2, count(*) FROM e2 UNION ALL SELECT 0, count(*) FROM e", "SELECT 1 AS p, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS n FROM events UNION ALL SELECT 2, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) FROM events UNION ALL SELECT 0, count(*) FROM events")
change("dml_partition_move", ["CREATE TABLE e (k BIGINT, v TEXT) PARTITION BY LIST (v)", "CREATE TABLE e1 PARTITION OF e FOR VALUES IN ('view', 'click')", "CREATE TABLE e2 PARTITION OF e DEFAULT", "INSERT INTO e SELECT event_id, event_type FROM events", "UPDATE e SET v = 'moved' WHERE v = 'view' AND k % 3 = 0"], "SELECT 1 AS p, k, v FROM e1 UNION ALL SELECT 2, k, v FROM e2", "SELECT CASE WHEN v IN ('view', 'click') THEN 1 ELSE 2 END AS p, k, v FROM (SELECT event_id AS k, CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'moved' ELSE event_type END AS v FROM events)")
change("dml_partition_upsert", ["CREATE TABLE e (k BIGINT, v TEXT, PRIMARY KEY (k)) PARTITION BY RANGE (k)", "CREATE TABLE e1 PARTITION OF e FOR VALUES FROM (MINVALUE) TO (100)", "CREATE TABLE e2 PARTITION OF e FOR VALUES FROM (100) TO (MAXVALUE)", "INSERT INTO e SELECT c_custkey, c_mktsegment FROM customer", "INSERT INTO e SELECT c_custkey + 50, 'new' FROM customer ON CONFLICT (k) DO UPDATE SET v = e.v || excluded.v"], "SELECT 1 AS p, k, v FROM e1 UNION ALL SELECT 2, k, v FROM e2", "SELECT CASE WHEN coalesce(c.c_custkey, o.c_custkey + 50) < 100 THEN 1 ELSE 2 END AS p, coalesce(c.c_custkey, o.c_custkey + 50) AS k, coalesce(c.c_mktsegment, '') || CASE WHEN o.c_custkey IS NULL THEN '' ELSE 'new' END AS v FROM customer AS c FULL JOIN customer AS o ON c.c_custkey = o.c_custkey + 50")
change("txn_rollback", ["BEGIN", "DELETE FROM region", "SAVEPOINT a", "INSERT INTO region VALUES (7, 'q')", "ROLLBACK"], "SELECT * FROM region", "SELECT * FROM region")
change("security_delete_policy", ["CREATE ROLE ann", "GRANT SELECT, DELETE ON customer TO ann", "ALTER TABLE customer ENABLE ROW LEVEL SECURITY", "CREATE POLICY s ON customer FOR SELECT USING (true)", "CREATE POLICY u ON customer FOR UPDATE USING (true)", "CREATE POLICY d ON customer FOR DELETE USING (c_nationkey < 9)", "SET ROLE ann", "DELETE FROM customer WHERE c_acctbal > 0"], "SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey < 9 AND c_acctbal > 0)")
change("security_update_check", ["CREATE ROLE ann", "GRANT SELECT, UPDATE ON customer TO ann", "ALTER TABLE customer ENABLE ROW LEVEL SECURITY", "CREATE POLICY s ON customer FOR SELECT USING (true)", "CREATE POLICY u ON customer FOR UPDATE USING (c_nationkey < 9) WITH CHECK (c_mktsegment = 'ONE')", "SET ROLE ann", "UPDATE customer SET c_mktsegment = 'ONE'"], "SELECT c_custkey, c_mktsegment FROM customer", "SELECT c_custkey, CASE WHEN c_nationkey < 9 THEN 'ONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
change("security_policy", ["CREATE ROLE ann", "GRANT SELECT ON customer TO ann", "ALTER TABLE customer ENABLE ROW LEVEL SECURITY", "CREATE POLICY p ON customer FOR SELECT TO ann USING (c_nationkey = 3)", "CREATE POLICY q ON customer FOR SELECT USING (c_nationkey = 4)", "CREATE POLICY r ON customer AS RESTRICTIVE USING (c_acctbal > 0)", "SET ROLE ann"], "SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4) AND c_acctbal > 0")
change("prepare_execute", ["PREPARE pq AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2"], "EXECUTE pq(1, 2)", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
change("udf_sql", ["CREATE FUNCTION plus_tax(p FLOAT8, t FLOAT8) RETURNS FLOAT8 AS $$ SELECT p * (1 + t) $$ LANGUAGE sql"], "SELECT l_orderkey, l_linenumber, round(plus_tax(l_extendedprice, l_tax), 4) AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS x FROM lineitem")
change("udtf_sql", ["CREATE FUNCTION of_region(k INT) RETURNS TABLE (a INT, b TEXT) AS $$ SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = k $$ LANGUAGE sql"], "SELECT a, b FROM of_region(2)", "SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_regionkey = 2")


def run_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: Engine(spark, d).sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run_sql(sql) for name, (sql, _) in SQL.items()} | {name: f for name, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle) in (SQL | FRAMES).items() if oracle}


def entry(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return run_sql(SQL["flagship_q1"][0])(spark, d)


@frame("stream_tumbling", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from .streaming import events as s

    configure(spark)
    source = s.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    return s.run(s.windowed(source, "1 hour"), "tumbling", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@frame("window_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), h AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, s")
def window_sessions(spark, d):
    from .streaming import events as s

    configure(spark)
    return s.sessions(table(spark, d, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
