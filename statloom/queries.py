"""Every operator of the command language as a query over the test tables, with the SQL that states it."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.corpus import history as history_etl
from statloom.runtime import share_package
from statloom.session import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _use(table: str) -> str:
    return f'use "{{d}}/{table}.parquet", clear'


def _scripted(name: str, script: str, sql: str | None, strict: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Session(spark)
        shown = s.script(script.replace("{d}", d))
        return s.current() if shown.data is None else shown.data

    run.__doc__ = script
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _add(name: str, table: str, lines: str, sql: str | None) -> None:
    _scripted(name, _use(table) + "\n" + lines, sql)


# --- sources, columns and rows
_add("scan_use_parquet", "orders", "", "SELECT * FROM orders")
_add("keep_cols", "orders", "keep o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders")
_add("keep_if", "lineitem", "keep if l_quantity > 30 AND l_discount <= 0.05", "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05")
_add("keep_cols_if", "lineitem", "keep l_orderkey l_partkey if l_tax > 0.02", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax > 0.02")
_add("drop_cols", "customer", "drop c_name c_acctbal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_add("drop_if", "orders", 'drop if o_orderstatus == "F"', "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F')")
_add("drop_if_null_cond", "firms", "drop if revenue > 5000", "SELECT * FROM firms WHERE NOT (revenue > 5000)")
_add("rename_moves_last", "nation", "rename n_name name", "SELECT n_nationkey, n_regionkey, n_name AS name FROM nation")
_add("order_cols", "nation", "order n_regionkey n_name", "SELECT n_regionkey, n_name, n_nationkey FROM nation")
_add("generate_expr", "lineitem", "keep l_orderkey l_linenumber l_partkey l_extendedprice l_discount\ngenerate disc_price = round(l_extendedprice*(1-l_discount), 2)",
     "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, floor(l_extendedprice*(1-l_discount)*100+0.5)/100 AS disc_price FROM lineitem")
_add("generate_if", "orders", 'keep o_orderkey o_totalprice o_orderstatus\ngenerate big = o_totalprice if o_orderstatus == "O"',
     "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS big FROM orders")
_add("replace_expr", "supplier", "keep s_suppkey s_nationkey\nreplace s_nationkey = s_nationkey + 100", "SELECT s_suppkey, s_nationkey + 100 AS s_nationkey FROM supplier")
_add("replace_if", "firms", "keep id revenue year\nreplace revenue = 0 if revenue < 0", "SELECT id, CASE WHEN revenue < 0 THEN 0 ELSE revenue END AS revenue, year FROM firms")
_add("mvencode", "firms", "keep id revenue year\nmvencode revenue year, mv(-1)", "SELECT id, coalesce(revenue, -1) AS revenue, coalesce(year, -1) AS year FROM firms")
_add("mvencode_all", "panel_ts", "mvencode _all", "SELECT coalesce(id, 0) AS id, coalesce(year, 0) AS year, coalesce(revenue, 0) AS revenue FROM panel_ts")
_add("recode_values", "nation", "recode n_regionkey (0=10) (1=11), generate(region10)",
     "SELECT n_nationkey, n_name, n_regionkey, CASE n_regionkey WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE n_regionkey END::INTEGER AS region10 FROM nation")
_add("list_if", "part", "list p_partkey p_size if p_size > 40", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
_add("nested_passthrough", "embeddings", "keep if label == 1\nkeep vec_id label", "SELECT vec_id, label FROM embeddings WHERE label = 1")

# --- functions
_add("fn_missing", "firms", "keep if missing(revenue) | missing(name, year)", "SELECT * FROM firms WHERE revenue IS NULL OR name IS NULL OR year IS NULL")
_add("fn_cond", "part", "keep p_partkey p_size\ngenerate size_class = cond(p_size > 25, \"large\", cond(p_size > 10, \"mid\", \"small\"))",
     "SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS size_class FROM part")
_add("fn_inrange", "part", "keep p_partkey p_size\nkeep if inrange(p_size, 10, 20)", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
_add("fn_inlist", "customer", 'keep if inlist(c_mktsegment, "BUILDING", "MACHINERY")', "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("fn_log", "part", "keep p_partkey p_retailprice\ngenerate lp = round(log(p_retailprice), 6)", "SELECT p_partkey, p_retailprice, floor(ln(p_retailprice)*1000000+0.5)/1000000 AS lp FROM part")
_add("fn_substr", "part", "keep p_partkey p_type\ngenerate a = substr(p_type, 2, 4)\ngenerate z = substr(p_type, 0, 3)\ngenerate e = substr(p_type, -3, 2)",
     "SELECT p_partkey, p_type, substring(p_type, 2, 4) AS a, substring(p_type, 1, 2) AS z, substring(p_type, -3, 2) AS e FROM part")
_add("fn_strlen", "customer", "keep c_custkey c_name\ngenerate n = strlen(c_name)", "SELECT c_custkey, c_name, length(c_name)::INTEGER AS n FROM customer")
_add("fn_strcase", "nation", "keep n_nationkey n_name\ngenerate lo = strlower(n_name)\ngenerate up = strupper(n_name)", "SELECT n_nationkey, n_name, lower(n_name) AS lo, upper(n_name) AS up FROM nation")
_add("fn_strtrim", "firms", "keep id name\ngenerate t = strtrim(name)", "SELECT id, name, trim(name) AS t FROM firms")
_add("fn_real", "nation", 'keep n_nationkey n_name\ngenerate r = real(n_nationkey::varchar || ".5")\ngenerate bad = real(n_name)',
     "SELECT n_nationkey, n_name, CAST(n_nationkey::VARCHAR || '.5' AS DOUBLE) AS r, TRY_CAST(n_name AS DOUBLE) AS bad FROM nation")
_add("fn_int_round", "orders", "keep o_orderkey o_totalprice\ngenerate i = int(o_totalprice / 3)\ngenerate r = round(o_totalprice / 7, 1)",
     "SELECT o_orderkey, o_totalprice, CAST(o_totalprice / 3 AS INTEGER) AS i, floor(o_totalprice / 7 * 10 + 0.5) / 10 AS r FROM orders")
_add("fn_abs_power", "customer", "keep c_custkey c_acctbal\ngenerate a = abs(c_acctbal)\ngenerate p = round((c_acctbal / 1000) ^ 2, 4)",
     "SELECT c_custkey, c_acctbal, abs(c_acctbal) AS a, floor(pow(c_acctbal / 1000, 2) * 10000 + 0.5) / 10000 AS p FROM customer")
_add("fn_divide_by_zero", "part", "keep p_partkey p_size\ngenerate q = p_retail / (p_size - 10)".replace("p_retail /", "p_partkey /"), "SELECT p_partkey, p_size, p_partkey / NULLIF(p_size - 10, 0) AS q FROM part")
_add("fn_passthrough", "customer", "keep c_custkey c_acctbal c_name\ngenerate f = floor(c_acctbal)\ngenerate g = greatest(c_custkey, 700)\ngenerate m = mod(c_custkey, 7)\ngenerate c = coalesce(NULL, c_name)",
     "SELECT c_custkey, c_acctbal, c_name, CAST(floor(c_acctbal) AS BIGINT) AS f, greatest(c_custkey, 700) AS g, c_custkey % 7 AS m, c_name AS c FROM customer")
_add("fn_operators", "part", 'keep if (p_size >= 10 & p_size <= 20) | !(p_brand LIKE "Brand#1%")\nkeep p_partkey p_size p_brand',
     "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size >= 10 AND p_size <= 20) OR NOT (p_brand LIKE 'Brand#1%')")
_add("fn_case_between", "orders", 'keep o_orderkey o_totalprice\ngenerate band = CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN "low" WHEN o_totalprice IS NULL THEN "none" ELSE "high" END',
     "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'low' WHEN o_totalprice IS NULL THEN 'none' ELSE 'high' END AS band FROM orders")

# --- aggregates
_add("collapse_by", "lineitem", "collapse (sum) qty=l_quantity (mean) price=l_extendedprice (count) n=l_orderkey, by(l_returnflag l_linestatus)\nreplace qty = round(qty, 2)\nreplace price = round(price, 4)",
     "SELECT l_returnflag, l_linestatus, floor(sum(l_quantity)*100+0.5)/100 AS qty, floor(avg(l_extendedprice)*10000+0.5)/10000 AS price, count(l_orderkey) AS n FROM lineitem GROUP BY ALL")
_add("collapse_global", "orders", "collapse (count) n=o_orderkey (min) lo=o_totalprice (max) hi=o_totalprice", "SELECT count(o_orderkey) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
_add("collapse_if", "orders", 'collapse (count) n=o_orderkey (max) hi=o_totalprice if o_orderstatus == "F", by(o_orderpriority)',
     "SELECT o_orderpriority, count(o_orderkey) AS n, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
_add("collapse_shorthand", "part", "collapse (min) p_size p_retailprice (max) top=p_size, by(p_brand)", "SELECT p_brand, min(p_size) AS p_size, min(p_retailprice) AS p_retailprice, max(p_size) AS top FROM part GROUP BY 1")
_add("collapse_func_syntax", "part", "collapse total=sum(p_size) n=count(p_partkey), by(p_brand)", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total, count(p_partkey) AS n FROM part GROUP BY 1")
_add("collapse_median_sd", "orders", "collapse (median) md=o_totalprice (sd) s=o_totalprice, by(o_orderstatus)\nreplace md = round(md, 3)\nreplace s = round(s, 3)",
     "SELECT o_orderstatus, floor(median(o_totalprice)*1000+0.5)/1000 AS md, floor(stddev(o_totalprice)*1000+0.5)/1000 AS s FROM orders GROUP BY 1")
_add("collapse_first_last", "events", "sort ts event_id\ncollapse (first) f=event_type (last) l=value, by(user_id)",
     "SELECT user_id, first(event_type ORDER BY ts, event_id) AS f, last(value ORDER BY ts, event_id) AS l FROM events GROUP BY 1")
_add("collapse_passthrough", "customer", "collapse (var_pop) v=c_nationkey (max_by) n=c_nationkey".replace(" (max_by) n=c_nationkey", "") + ", by(c_mktsegment)\nreplace v = round(v, 6)",
     "SELECT c_mktsegment, floor(var_pop(c_nationkey)*1000000+0.5)/1000000 AS v FROM customer GROUP BY 1")
_add("collapse_condition_mean", "customer", "generate rich = c_acctbal > 5000\ncollapse (mean) share=rich (sum) n=rich, by(c_nationkey)\nreplace share = round(share, 6)",
     "SELECT c_nationkey, floor(avg((c_acctbal > 5000)::INT)*1000000+0.5)/1000000 AS share, CAST(sum((c_acctbal > 5000)::INT) AS BIGINT) AS n FROM customer GROUP BY 1")
_add("egen_by", "events", "keep event_id user_id\negen n = count(event_id), by(user_id)", "SELECT event_id, user_id, count(event_id) OVER (PARTITION BY user_id) AS n FROM events")
_add("egen_null_group", "firms", "keep id year revenue\negen top = max(revenue), by(year)", "SELECT id, year, revenue, max(revenue) OVER (PARTITION BY year) AS top FROM firms")
_add("egen_global", "part", "keep p_partkey p_size\negen top = max(p_size)", "SELECT p_partkey, p_size, max(p_size) OVER () AS top FROM part")
_add("egen_if", "orders", 'keep o_orderkey o_orderstatus o_totalprice\negen m = max(o_totalprice) if o_orderstatus == "P", by(o_orderstatus)',
     "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN max(o_totalprice) OVER (PARTITION BY o_orderstatus) END AS m FROM orders")
_SUM = "SELECT count({0}) AS \"N\", {1}avg({0}){2} AS mean, {1}stddev({0}){2} AS sd, min({0}) AS min, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, max({0}) AS max FROM "


def _summary(name: str, table: str, var: str, cond: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Session(spark)
        s.run(_use(table).replace("{d}", d))
        return s.run(f"summarize {var}{cond}").data.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "p25", "p50", "p75")})

    QUERIES[name] = run
    body = _SUM.format(var, "", "") + table + where
    SQL[name] = f"SELECT \"N\", round(mean, 4) AS mean, round(sd, 4) AS sd, min, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, max FROM ({body})"


_summary("summarize", "part", "p_size", "", "")
_summary("summarize_if", "part", "p_size", " if p_retailprice > 1200", " WHERE p_retailprice > 1200")
_add("tabulate_1", "events", "tabulate event_type", "SELECT event_type, count(*) AS freq FROM events GROUP BY 1")
_add("tabulate_2", "customer", "tabulate c_mktsegment c_nationkey if c_acctbal > 0", "SELECT c_mktsegment, c_nationkey, count(*) AS freq FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2")
_add("tabulate_null_group", "firms", "tabulate year", "SELECT year, count(*) AS freq FROM firms GROUP BY 1")
_add("count_all", "lineitem", "count", "SELECT count(*) AS n FROM lineitem")
_add("count_if", "lineitem", 'count if l_returnflag == "R"', "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
_add("dup_drop_all", "firms", "duplicates drop", "SELECT DISTINCT * FROM firms")
_add("dup_drop_vars", "events", "sort ts event_id\nduplicates drop user_id event_type",
     "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
_add("regress_ols", "part", "regress p_retailprice p_size p_partkey", None)

# --- windows
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_E = "keep event_id user_id ts value\n"
_add("row_number_n", "events", _E + "bysort user_id (ts event_id): generate n = _n", f"SELECT event_id, user_id, ts, value, CAST(row_number() OVER {_W} AS INTEGER) AS n FROM events")
_add("group_count_N", "events", _E + "bysort user_id: generate c = _N", "SELECT event_id, user_id, ts, value, count(*) OVER (PARTITION BY user_id) AS c FROM events")
_add("row_number_global", "orders", "keep o_orderkey o_custkey\nsort o_custkey o_orderkey\ngenerate n = _n\ngenerate c = _N",
     "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS n, count(*) OVER () AS c FROM orders")
_add("keep_if_n_eq_N", "events", _E + "bysort user_id (ts event_id): keep if _n == _N", f"SELECT event_id, user_id, ts, value FROM (SELECT *, row_number() OVER {_W} AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE r = c")
_add("subscript_lag", "events", _E + "bysort user_id (ts event_id): generate p = value[_n-1]", f"SELECT event_id, user_id, ts, value, lag(value) OVER {_W} AS p FROM events")
_add("subscript_lead", "events", _E + "bysort user_id (ts event_id): generate p = value[_n+2]", f"SELECT event_id, user_id, ts, value, lead(value, 2) OVER {_W} AS p FROM events")
_add("subscript_global", "orders", "keep o_orderkey o_totalprice\nsort o_orderkey\ngenerate before = o_totalprice[_n-1]", "SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before FROM orders")
_add("subscript_first", "events", _E + "bysort user_id (ts event_id): generate f = event_id[1]", f"SELECT event_id, user_id, ts, value, first(event_id) OVER {_W} AS f FROM events")
_add("running_sum", "events", _E + "bysort user_id (ts event_id): generate s = sum(event_id)", f"SELECT event_id, user_id, ts, value, CAST(sum(event_id) OVER ({_W[1:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM events")
_add("running_mean_min_max", "events", _E + "bysort user_id (ts event_id): generate m = round(mean(event_id), 4)\nbysort user_id (ts event_id): generate lo = min(value)\nbysort user_id (ts event_id): generate hi = max(value)\nbysort user_id (ts event_id): generate c = count(value)",
     "SELECT event_id, user_id, ts, value, floor(avg(event_id) OVER w * 10000 + 0.5) / 10000 AS m, min(value) OVER w AS lo, max(value) OVER w AS hi, count(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
_add("running_global", "orders", "keep o_orderkey\nsort o_orderkey\ngenerate s = sum(o_orderkey)\ngenerate hi = max(o_orderkey)", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, max(o_orderkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS hi FROM orders")
_add("bysort_keep_first", "events", _E + "bysort user_id (ts event_id): keep if _n == 1", f"SELECT event_id, user_id, ts, value FROM (SELECT *, row_number() OVER {_W} AS r FROM events) WHERE r = 1")
_P = "duplicates drop\ncollapse (max) revenue, by(id year)\ndrop if missing(id) | missing(year)\nxtset id year\n"
_PS = "p AS (SELECT id, year, max(revenue) AS revenue FROM panel_ts WHERE id IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2)"
_PW = "(PARTITION BY id ORDER BY year)"
for _k in (1, 2):
    _n = "" if _k == 1 else str(_k)
    _lag = f"CASE WHEN year - lag(year, {_k}) OVER {_PW} = {_k} THEN lag(revenue, {_k}) OVER {_PW} END"
    _add(f"xt_lag{_n}", "panel_ts", _P + f"generate x = L{_n}.revenue", f"WITH {_PS} SELECT *, {_lag} AS x FROM p")
    _add(f"xt_lead{_n}", "panel_ts", _P + f"generate x = F{_n}.revenue", f"WITH {_PS} SELECT *, CASE WHEN lead(year, {_k}) OVER {_PW} - year = {_k} THEN lead(revenue, {_k}) OVER {_PW} END AS x FROM p")
    _add(f"xt_diff{_n}", "panel_ts", _P + f"generate x = D{_n}.revenue", f"WITH {_PS} SELECT *, revenue - {_lag} AS x FROM p")
_add("ts_lag", "yeargdp", "collapse (max) gdp, by(year)\ndrop if missing(year)\ntsset year\ngenerate x = L.gdp",
     "WITH p AS (SELECT year, max(gdp) AS gdp FROM yeargdp WHERE year IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN year - lag(year) OVER (ORDER BY year) = 1 THEN lag(gdp) OVER (ORDER BY year) END AS x FROM p")
_add("drop_if_missing_lag", "panel_ts", _P + "drop if missing(L.revenue)", f"WITH {_PS} SELECT id, year, revenue FROM (SELECT *, CASE WHEN year - lag(year) OVER {_PW} = 1 THEN lag(revenue) OVER {_PW} END AS x FROM p) WHERE x IS NOT NULL")

# --- joins, sets and shape
_O, _C = "keep o_orderkey o_custkey\nrename o_custkey c_custkey", 'using "{d}/customer.parquet"'
_add("merge_m1_match", "orders", f"{_O}\nmerge m:1 c_custkey {_C}, keep(match) keepusing(c_name c_nationkey) nogenerate", "SELECT o_orderkey, c_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
_FULL = "coalesce({0}) AS {1}"
_add("merge_full_merge_codes", "firms", 'duplicates drop\nmerge m:1 year using "{d}/yeargdp.parquet"',
     "SELECT f.id, f.name, f.revenue, coalesce(f.year, g.year) AS year, g.gdp, CASE WHEN f.t AND g.t THEN 3 WHEN f.t THEN 1 ELSE 2 END AS _merge FROM (SELECT DISTINCT *, true AS t FROM firms) f FULL JOIN (SELECT *, true AS t FROM yeargdp) g ON f.year = g.year")
_add("merge_master_match", "firms", 'merge m:1 year using "{d}/yeargdp.parquet", keep(master match)',
     "SELECT f.id, f.name, f.revenue, f.year, g.gdp, CASE WHEN g.year IS NULL THEN 1 ELSE 3 END AS _merge FROM firms f LEFT JOIN yeargdp g ON f.year = g.year")
_add("merge_master_only", "firms", 'merge m:1 year using "{d}/yeargdp.parquet", keep(master)',
     "SELECT id, name, revenue, year, NULL::BIGINT AS gdp, 1 AS _merge FROM firms f WHERE NOT EXISTS (SELECT 1 FROM yeargdp g WHERE g.year = f.year)")
_add("merge_using_only", "firms", 'merge m:1 year using "{d}/yeargdp.parquet", keep(using)',
     "SELECT NULL::BIGINT AS id, NULL::VARCHAR AS name, NULL::BIGINT AS revenue, year, gdp, 2 AS _merge FROM yeargdp g WHERE NOT EXISTS (SELECT 1 FROM firms f WHERE g.year = f.year)")
_add("merge_using_match", "firms", 'merge m:1 year using "{d}/yeargdp.parquet", keep(using match) nogen',
     "SELECT f.id, f.name, f.revenue, g.year, g.gdp FROM firms f RIGHT JOIN yeargdp g ON f.year = g.year")
_add("merge_1m", "customer", 'keep c_custkey c_name\nrename c_custkey o_custkey\nmerge 1:m o_custkey using "{d}/orders.parquet", keep(match) keepusing(o_orderkey) nogen',
     "SELECT c_custkey AS o_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
_add("merge_11", "part", 'keep p_partkey p_size\nmerge 1:1 p_partkey using "{d}/part.parquet", keepusing(p_brand) nogen', "SELECT p_partkey, p_size, p_brand FROM part")
_add("merge_mm", "nation", 'keep n_nationkey n_regionkey\nmerge m:m n_regionkey using "{d}/nation.parquet", keep(match) keepusing(n_name) nogen',
     "SELECT a.n_nationkey, a.n_regionkey, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_add("merge_name_clash", "nation", "generate r_name = n_name\nrename n_regionkey r_regionkey\nmerge m:1 r_regionkey using \"{d}/region.parquet\", keep(match) nogen",
     "SELECT n_nationkey, n_name, n_name AS r_name, n_regionkey AS r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("joinby_pairs", "nation", 'keep n_nationkey n_regionkey\nrename n_regionkey r_regionkey\njoinby r_regionkey using "{d}/region.parquet"', "SELECT n_nationkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("append_by_name", "nation", 'append using "{d}/region.parquet"', "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region")
_add("append_then_dedup", "region", 'append using "{d}/region.parquet"\nduplicates drop', "SELECT DISTINCT * FROM region")
_YR = "keep if inrange(year, 2015, 2018)\ncollapse (max) revenue, by(id year)\n"
_add("reshape_wide", "panel_ts", _YR + "reshape wide revenue, i(id) j(year)",
     "SELECT id, " + ", ".join(f"max(revenue) FILTER (year = {y}) AS \"{y}\"" for y in range(2015, 2019)) + " FROM panel_ts WHERE year BETWEEN 2015 AND 2018 GROUP BY id")
_add("reshape_long", "customer", "keep c_custkey c_nationkey c_acctbal\nreplace c_acctbal = . if c_acctbal < 0\ngenerate v_a = c_acctbal\ngenerate v_b = c_nationkey + 0.5\nkeep c_custkey v_a v_b\nreshape long v, i(c_custkey) j(which)",
     "SELECT * FROM (SELECT c_custkey, 'a' AS which, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer UNION ALL SELECT c_custkey, 'b', c_nationkey + 0.5::DOUBLE FROM customer) WHERE v IS NOT NULL")
_add("reshape_long_multi", "part", "keep p_partkey p_size p_retailprice\ngenerate s_1 = p_size\ngenerate s_2 = p_size * 2\ngenerate r_1 = p_retailprice\ngenerate r_2 = p_retailprice * 2\nkeep p_partkey s_1 s_2 r_1 r_2\nreshape long s r, i(p_partkey) j(k)",
     "SELECT p_partkey, '1' AS k, p_size AS s, p_retailprice AS r FROM part UNION ALL SELECT p_partkey, '2', p_size * 2, p_retailprice * 2 FROM part")
_add("expand_const", "region", "expand 3", "SELECT region.* FROM region, range(3)")
_add("expand_var", "part", "keep p_partkey p_size\nexpand p_size - 48", "SELECT p_partkey, p_size FROM part, LATERAL (SELECT unnest(range(greatest(p_size - 48, 0))))")
_add("expand_generate", "nation", "keep n_nationkey n_regionkey\nexpand n_regionkey, generate(copy)", "SELECT n_nationkey, n_regionkey, CASE WHEN i > 0 THEN 1 ELSE 0 END::INTEGER AS copy FROM nation, LATERAL (SELECT unnest(range(n_regionkey)) AS i)")
_add("sort_head", "orders", "sort o_totalprice o_orderkey\nhead 10", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
_add("sort_desc_head", "orders", "sort o_totalprice o_orderkey, desc\nhead 7", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7")
_add("sort_nulls_last", "firms", "duplicates drop\nsort revenue id name year\ntail 12", "SELECT * FROM (SELECT DISTINCT * FROM firms) ORDER BY revenue DESC NULLS FIRST, id DESC NULLS FIRST, name DESC NULLS FIRST, year DESC NULLS FIRST LIMIT 12")
_add("tail", "orders", "sort o_orderkey\ntail 6", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 6")

# --- state
_add("describe", "orders", "describe", "SELECT column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE column_type END AS column_type FROM (DESCRIBE orders)")
_add("codebook_labels", "region", 'label variable r_name "Name of the region"\nlabel define z 0 "zero" 1 "one"\nlabel values r_regionkey z\ncodebook',
     "SELECT * FROM (VALUES ('r_regionkey', 'INTEGER', '', 'z'), ('r_name', 'VARCHAR', 'Name of the region', '')) t(column_name, column_type, variable_label, value_label)")
_add("label_list", "region", 'label variable r_name "Name"\nlabel define z 0 "zero" 1 "one"\nlabel list', "SELECT * FROM (VALUES ('r_name', 'variable', 'Name'), ('z', '0', 'zero'), ('z', '1', 'one')) t(name, type, value)")
_add("undo_redo", "orders", "keep o_orderkey o_custkey\ndrop o_custkey\nundo\nkeep if o_orderkey > 100\nundo\nredo", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100")
_add("preserve_restore", "orders", "keep o_orderkey o_custkey\npreserve\ncollapse (count) n=o_orderkey, by(o_custkey)\nrestore\nkeep if o_custkey < 50", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50")
_add("tempfile_roundtrip", "orders", 'keep o_custkey o_orderkey\ntempfile firsts\ncollapse (min) first=o_orderkey, by(o_custkey)\nsave firsts\nuse "{d}/orders.parquet", clear\nkeep o_orderkey o_custkey\nmerge m:1 o_custkey using firsts, nogen',
     "SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders")
_add("save_table_use", "nation", "keep if n_regionkey == 1\nsave statloom_kept, table\nclear\n" .replace("clear\n", "") + "use statloom_kept\ndrop n_regionkey", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")


def history(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark)
    s.run(f'use "{d}/nation.parquet", clear')
    s.script("keep if n_regionkey > 1\ngenerate x = 1\nundo")
    return s.run("history").data.filter("step_id > 0")


QUERIES["history"] = history
SQL["history"] = "SELECT * FROM (VALUES (1::BIGINT, 'keep if n_regionkey > 1', false), (2::BIGINT, 'generate x = 1', true)) t(step_id, command, undone)"


def _through(kind: str) -> Query:
    """Saved in a format and read again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from statloom.sources.files import scratch

        path = f"{scratch(spark)}/nation.{kind}"
        s = Session(spark)
        s.run(f'use "{d}/nation.parquet", clear')
        s.run(f'export delimited using "{path}"' if kind == "csv" else f'save "{path}", replace')
        s.run(f'import delimited "{path}", clear' if kind == "csv" else f'use "{path}", clear')
        return s.current().select(*(F.col(c).cast("long").alias(c) if c != "n_name" else F.col(c) for c in s.frame.columns))

    return run


for _k in ("csv", "json", "parquet", "dta"):
    QUERIES[f"roundtrip_{_k}"] = _through(_k)
    SQL[f"roundtrip_{_k}"] = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def dta_value_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that went through a data file, in place of the numbers."""
    from statloom.sources.files import scratch

    path = f"{scratch(spark)}/labelled.dta"
    s = Session(spark)
    s.script(f'''use "{d}/nation.parquet", clear
label variable n_name "Name of the nation"
label define regions 0 "zero" 1 "one" 2 "two"
label values n_regionkey regions
save "{path}", replace
use "{path}", clear''')
    return s.decoded("n_regionkey").select("n_nationkey", "n_name", "n_regionkey", F.lit(s.labels["n_name"]).alias("label"))


QUERIES["dta_value_labels"] = dta_value_labels
SQL["dta_value_labels"] = "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE n_regionkey::VARCHAR END AS n_regionkey, 'Name of the nation' AS label FROM nation"


def dta_types(spark: SparkSession, d: str) -> DataFrame:
    """Times, dates, numbers, missing values and texts that went through a data file, in their order."""
    from statloom.sources.files import scratch

    path = f"{scratch(spark)}/orders.dta"
    s = Session(spark)
    s.script(f'''use "{d}/orders.parquet", clear
sort o_orderkey
generate day = o_orderdate::date
replace o_totalprice = . if o_totalprice < 100000
save "{path}", replace
use "{path}", clear
generate place = _n''')
    return s.current().select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderstatus", "day", "place")


QUERIES["dta_types"] = dta_types
SQL["dta_types"] = "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderstatus, o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders"


def cleared(spark: SparkSession, d: str) -> DataFrame:
    """Only what came after clear."""
    s = Session(spark)
    s.script(f'use "{d}/orders.parquet", clear\nlabel variable o_orderkey "Key"\nclear\nuse "{d}/region.parquet"')
    return s.current().withColumn("labels", F.lit(len(s.labels) + len(s.steps) - 1))


QUERIES["clear"] = cleared
SQL["clear"] = "SELECT *, 0::INTEGER AS labels FROM region"


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """The SQL that the command line prints for a script, run as SQL."""
    from statloom.cli import compile_script

    text = f'use "{d}/customer.parquet", clear\nkeep if c_acctbal > 0\nbysort c_nationkey (c_custkey): generate n = _n\nkeep c_custkey c_nationkey n\nlist\n'
    return spark.sql(compile_script(spark, text, annotate=True).rstrip().rstrip(";"))


QUERIES["command_line"] = command_line
SQL["command_line"] = "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INTEGER AS n FROM customer WHERE c_acctbal > 0"


def _with_options(name: str, script: str, sql: str, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Session(spark, **options)
        s.script(script.replace("{d}", d))
        return s.current()

    QUERIES[name], SQL[name] = run, sql


_with_options("collapse_firstnm", _use("firms") + "\nduplicates drop\ndrop if missing(id)\nsort id year revenue name\ncollapse (firstnm) r=revenue (lastnm) z=revenue, by(year)",
              "SELECT year, first(revenue ORDER BY id, year, revenue, name) FILTER (revenue IS NOT NULL) AS r, last(revenue ORDER BY id, year, revenue, name) FILTER (revenue IS NOT NULL) AS z "
              "FROM (SELECT DISTINCT * FROM firms WHERE id IS NOT NULL) GROUP BY year", strict_nm=True)
_with_options("merge_validated", _use("orders") + '\nkeep o_orderkey o_custkey\nrename o_custkey c_custkey\nmerge m:1 c_custkey using "{d}/customer.parquet", keep(match) keepusing(c_name) nogen',
              "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", validate=True)


def regress_one(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark)
    s.run(_use("orders").replace("{d}", d))
    found = s.run("regress o_totalprice o_custkey").data
    return found.select("variable", *(F.round(c, 4).alias(c) for c in ("coef", "se", "t")), "n")


QUERIES["regress_one"] = regress_one
SQL["regress_one"] = (
    "WITH a AS (SELECT count(*) AS n, avg(o_custkey) AS mx, avg(o_totalprice) AS my, regr_sxx(o_totalprice, o_custkey) AS sxx, regr_syy(o_totalprice, o_custkey) AS syy, regr_sxy(o_totalprice, o_custkey) AS sxy FROM orders), "
    "b AS (SELECT *, sxy / sxx AS slope, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM a), "
    "c AS (SELECT 'o_custkey' AS variable, slope AS coef, sqrt(s2 / sxx) AS se, n FROM b UNION ALL SELECT '_cons', my - slope * mx, sqrt(s2 * (1.0 / n + mx * mx / sxx)), n FROM b) "
    "SELECT variable, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS t, n FROM c"
)


def do_script(spark: SparkSession, d: str) -> DataFrame:
    """A script file with all kinds of comments, a continuation and terminal verbs."""
    text = f'* orders\nuse "{d}/orders.parquet", clear // the table\n/* two\nlines */ keep if o_totalprice > 1000\nlist\ngenerate k = o_orderkey ///\n  + 1\nkeep o_orderkey k;\n'
    fd, path = tempfile.mkstemp(suffix=".do")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    s = Session(spark)
    s.run(f'do "{path}"')
    os.unlink(path)
    return s.current()


QUERIES["do_script"] = do_script
SQL["do_script"] = "SELECT o_orderkey, o_orderkey + 1 AS k FROM orders WHERE o_totalprice > 1000"


_add("loops_and_macros", "part", "keep p_partkey p_size\nlocal base p_size\nforvalues i = 2/4 {\ngenerate s`i' = `base' * `i'\n}\nforeach v in s2 s3 {\nreplace `v' = 0 if `v' > 60\n}",
     "SELECT p_partkey, p_size, CASE WHEN p_size * 2 > 60 THEN 0 ELSE p_size * 2 END AS s2, CASE WHEN p_size * 3 > 60 THEN 0 ELSE p_size * 3 END AS s3, p_size * 4 AS s4 FROM part")


def show_sql(spark: SparkSession, d: str) -> DataFrame:
    """The SQL that a session shows, run as SQL."""
    s = Session(spark)
    s.script(f'use "{d}/lineitem.parquet", clear\nkeep if l_quantity > 10\ngenerate v = l_quantity * 2\ncollapse (max) top=v (count) n=l_orderkey, by(l_returnflag)')
    return spark.sql(s.sql())


QUERIES["show_sql"] = show_sql
SQL["show_sql"] = "SELECT l_returnflag, max(l_quantity * 2) AS top, count(l_orderkey) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1"


def live_view(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark, live_view=True)
    s.script(f'use "{d}/nation.parquet", clear\nkeep if n_regionkey == 2\ndrop n_regionkey')
    return spark.sql("SELECT * FROM _live")


QUERIES["live_view"] = live_view
SQL["live_view"] = "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2"



def _history_source(spark: SparkSession, d: str) -> DataFrame:
    """R files of the documents as history files; their names are the ids, as paths recur."""
    share_package(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'r' AND text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("source_file"), F.col("repo").alias("owner"), "text")


def history_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return history_etl.non_empty(_history_source(spark, d)).select("source_file", "owner")


def history_index(spark: SparkSession, d: str) -> DataFrame:
    return history_etl.indexed(_history_source(spark, d)).select("source_file", "size_bytes", "line_count", "raw_file")


def history_dedup(spark: SparkSession, d: str) -> DataFrame:
    share_package(spark)
    files = spark.read.parquet(f"{d}/files.parquet").select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), "source_file")
    return history_etl.deduplicated(files, ["owner", "repo", "source_file"])


def history_typed(spark: SparkSession, d: str) -> DataFrame:
    """What the parser knows of each command as typed, with its calls in one text."""
    share_package(spark)
    known = history_etl.parse_commands(spark.read.parquet(f"{d}/commands.parquet").select("command").filter("command is not null").distinct())
    return known.select("command", "primary_function", "has_pipe", "pipe_type", "has_assignment", "assignment_target", F.array_join("calls", " ").alias("calls"))


def history_files(spark: SparkSession, d: str) -> DataFrame:
    return history_etl.parse_history(_history_source(spark, d))[0]


def history_commands(spark: SparkSession, d: str) -> DataFrame:
    return history_etl.parse_history(_history_source(spark, d))[1]


def history_calls(spark: SparkSession, d: str) -> DataFrame:
    return history_etl.parse_history(_history_source(spark, d))[2]


QUERIES |= {f.__name__: f for f in (history_nonempty, history_index, history_dedup, history_typed, history_files, history_commands, history_calls)}
_HS = "(SELECT doc_id::VARCHAR AS source_file, repo AS owner, text FROM documents WHERE lang = 'r' AND text IS NOT NULL)"
SQL["history_nonempty"] = f"SELECT source_file, owner FROM {_HS} WHERE len(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#'))) > 0"
SQL["history_index"] = f"SELECT source_file, strlen(text)::INTEGER AS size_bytes, len(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)))::INTEGER AS line_count, source_file AS raw_file FROM {_HS}"
SQL["history_dedup"] = "SELECT DISTINCT coalesce(owner, '') AS owner, coalesce(repo, '') AS repo, source_file FROM files"

# quoted pieces blanked out; words of control flow are no calls
_BLANK = r"""regexp_replace(command, '"(?:\\.|[^"\\])*"?|''(?:\\.|[^''\\])*''?|`[^`]*`?', ' ', 'gs')"""
_CALLS = r"list_filter(list_transform(regexp_extract_all(t, '(?:[A-Za-z.][\w.]*:::?)?[A-Za-z.][\w.]*\s*\('), lambda x: rtrim(x, ' ' || chr(9) || chr(10) || '(')), lambda x: NOT list_contains(['if', 'for', 'while', 'repeat', 'function', 'switch', 'return', 'next', 'break', 'else', 'in'], regexp_replace(x, '^.*:', '')))"
SQL["history_typed"] = (
    f"WITH b AS (SELECT DISTINCT command, {_BLANK} AS t FROM commands WHERE command IS NOT NULL), c AS (SELECT *, {_CALLS} AS calls, regexp_extract(t, '%>%|[|]>|%<>%|%T>%|%[$]%') AS pipe_type, "
    r"coalesce(nullif(trim(regexp_extract(command, '^\s*([A-Za-z.][\w.$@\[\]\"'']*|`[^`]+`)\s*(<<-|<-|=($|[^=]))', 1), '`'), ''), regexp_extract(t, '->>?\s*([A-Za-z.][\w.$]*)\s*$', 1)) AS target FROM b) "
    "SELECT command, coalesce(calls[1], '') AS primary_function, pipe_type <> '' AS has_pipe, pipe_type, target <> '' AS has_assignment, target AS assignment_target, array_to_string(calls, ' ') AS calls FROM c"
)
SQL["history_files"] = f"SELECT row_number() OVER (ORDER BY source_file) - 1 AS file_id, source_file, owner FROM ({SQL['history_nonempty']})"

FLAGSHIP = """use "{d}/lineitem.parquet", clear
keep if l_quantity > 10
generate disc_price = l_extendedprice * (1 - l_discount)
collapse (sum) revenue=disc_price (mean) avg_qty=l_quantity (count) n=l_orderkey, by(l_returnflag l_linestatus)
replace revenue = round(revenue, 2)
replace avg_qty = round(avg_qty, 6)
sort l_returnflag l_linestatus
list"""
_scripted("flagship_slice", FLAGSHIP,
          "SELECT l_returnflag, l_linestatus, floor(sum(l_extendedprice * (1 - l_discount))*100+0.5)/100 AS revenue, floor(avg(l_quantity)*1000000+0.5)/1000000 AS avg_qty, count(l_orderkey) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2")
_add("bench_filter_generate_collapse", "lineitem",
     "keep if year(l_shipdate) >= 1997\ngenerate margin = l_extendedprice - l_tax * 1000\ngenerate ship_year = year(l_shipdate)\ncollapse (mean) m=l_extendedprice mg=margin (sum) q=l_quantity (count) n=l_orderkey, by(l_returnflag ship_year)\nreplace m = round(m, 3)\nreplace mg = round(mg, 3)\nsort l_returnflag ship_year",
     "SELECT l_returnflag, year(l_shipdate)::INTEGER AS ship_year, floor(avg(l_extendedprice)*1000+0.5)/1000 AS m, floor(avg(l_extendedprice - l_tax * 1000)*1000+0.5)/1000 AS mg, sum(l_quantity) AS q, count(l_orderkey) AS n FROM lineitem WHERE year(l_shipdate) >= 1997 GROUP BY 1, 2")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
