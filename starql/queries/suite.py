"""Named queries.  An entry is dialect text; where DuckDB spells something differently, its text follows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..operators.rewrites import ALL
from .views import SQL, catalog

_LO = "FROM lineorder AS lo JOIN date_dim AS d ON lo.lo_orderdate = d.d_datekey"
_C = "JOIN customer_dim AS c ON lo.lo_custkey = c.c_custkey"
_S = "JOIN supplier_dim AS s ON lo.lo_suppkey = s.s_suppkey"
_P = "JOIN part_dim AS p ON lo.lo_partkey = p.p_partkey"

#: name: (dialect text, DuckDB text if different, engine options)
SUITE: dict[str, tuple[str, str | None, dict]] = {}


def _q(name: str, sql: str, duck: str | None = None, **options: object) -> None:
    SUITE[name] = (sql, duck, options)


# sources, projection, filter
_q("scan_projection", "SELECT n.n_nationkey AS k, n.n_name AS name FROM t_nation n")
_q("select_star", "SELECT * FROM t_region")
_q("select_table_star", "SELECT n.*, r.r_name AS region FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey")
_q("no_from", "SELECT 1 + 2 AS three, 'it''s' AS s")
_q("filter_eq", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_brand = 'Brand#7'")
_q("filter_ne", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_size <> 10 AND p.p_size != 11")
_q("filter_range", "SELECT p.p_partkey AS k, p.p_size AS s FROM t_part p WHERE p.p_size > 10 AND p.p_size <= 20 AND p.p_retailprice >= 0 AND p.p_retailprice < 95000")
_q("filter_string_cmp", "SELECT c.c_custkey AS k FROM t_customer c WHERE c.c_mktsegment >= 'BUILDING' AND c.c_mktsegment < 'G' AND c.c_name > 'Customer#000000100'")
_q("filter_and_or_not", "SELECT h.l_orderkey AS k, h.x AS x, h.y AS y FROM holes h WHERE NOT (h.x > 2 AND h.y < 5) OR (h.x = 1 AND NOT h.y = 2)")
_q("filter_between", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_size BETWEEN 5 AND 9 AND p.p_brand BETWEEN 'Brand#11' AND 'Brand#19'")
_q("filter_not_between", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_size NOT BETWEEN 5 AND 45 AND p.p_brand NOT BETWEEN 'Brand#11' AND 'Brand#19'")
_q("filter_in", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_size IN (1, 2, 3) OR p.p_brand IN ('Brand#3', 'Brand#4')")
_q("filter_not_in", "SELECT p.p_partkey AS k FROM t_part p WHERE p.p_size NOT IN (1, 2, 3, 4, 5) AND p.p_brand NOT IN ('Brand#3', 'Brand#4')")
_q("filter_in_null", "SELECT h.l_orderkey AS k, h.x AS x, h.x IN (1, NULL) AS a, h.x NOT IN (1, NULL) AS b, h.x IN (1, 2) AS c FROM holes h WHERE h.l_quantity < 5")
_q("filter_in_columns", "SELECT h.l_orderkey AS k FROM holes h WHERE h.l_quantity IN (h.x, h.y, h.x + h.y)")
_q("filter_is_null", "SELECT h.l_orderkey AS k FROM holes h WHERE h.x IS NULL")
_q("filter_is_not_null", "SELECT h.l_orderkey AS k, h.f AS f FROM holes h WHERE h.f IS NOT NULL AND h.y IS NOT NULL")
_q("filter_isnull_postfix", "SELECT h.l_orderkey AS k, h.x ISNULL AS a, h.y NOTNULL AS b FROM holes h WHERE h.x ISNULL OR h.y NOTNULL")
_q("filter_is_true", "SELECT h.l_orderkey AS k, h.x AS x FROM holes h WHERE (h.x > 2) IS TRUE OR (h.y > 2) IS FALSE", "SELECT h.l_orderkey AS k, h.x AS x FROM holes h WHERE coalesce(h.x > 2, FALSE) OR NOT coalesce(h.y > 2, TRUE)")
_q("filter_is_not_true", "SELECT h.l_orderkey AS k, h.x AS x FROM holes h WHERE (h.x > 2) IS NOT TRUE AND (h.y > 1) IS NOT FALSE", "SELECT h.l_orderkey AS k, h.x AS x FROM holes h WHERE NOT coalesce(h.x > 2, FALSE) AND coalesce(h.y > 1, TRUE)")
_q("filter_is_unknown", "SELECT h.l_orderkey AS k, (h.x > 2) IS UNKNOWN AS a, (h.y > 2) IS NOT UNKNOWN AS b FROM holes h", "SELECT h.l_orderkey AS k, (h.x > 2) IS NULL AS a, (h.y > 2) IS NOT NULL AS b FROM holes h")
# scalars
_q("arith_add_sub_mul", "SELECT l.l_orderkey AS k, l.l_quantity + 3 * l.l_linenumber - 7 AS v, (l.l_quantity - 1) * (l.l_discount + 2) AS w FROM t_lineitem l")
_q("arith_int_div", "SELECT l.l_orderkey AS k, l.l_extendedprice / 7 AS a, (-l.l_extendedprice) / 7 AS b, l.l_quantity / (-3) AS c FROM t_lineitem l", "SELECT l.l_orderkey AS k, l.l_extendedprice // 7 AS a, (-l.l_extendedprice) // 7 AS b, l.l_quantity // (-3) AS c FROM t_lineitem l")
_q("arith_mod", "SELECT l.l_orderkey AS k, l.l_quantity % 7 AS a, (-l.l_quantity) % 7 AS b, l.l_quantity % (-7) AS c FROM t_lineitem l")
_q("arith_pow", "SELECT n.n_nationkey AS k, n.n_nationkey ^ 2 AS a, 2 ^ n.n_nationkey AS b, -2 ^ 2 AS c FROM t_nation n", "SELECT n.n_nationkey AS k, CAST(pow(n.n_nationkey, 2) AS BIGINT) AS a, CAST(pow(2, n.n_nationkey) AS BIGINT) AS b, CAST(4 AS BIGINT) AS c FROM t_nation n")
_q("arith_neg", "SELECT n.n_nationkey AS k, -n.n_nationkey AS a, - - n.n_nationkey AS b, +n.n_nationkey AS c FROM t_nation n", "SELECT n.n_nationkey AS k, -n.n_nationkey AS a, n.n_nationkey AS b, n.n_nationkey AS c FROM t_nation n")
_q("null_arithmetic", "SELECT h.l_orderkey AS k, h.x + 1 AS a, h.x * h.y AS b, h.x = h.y AS c, h.x > 2 AND h.y > 2 AS d, h.x > 2 OR h.y > 2 AS e, NOT h.x > 2 AS g FROM holes h")
_q("literals", "SELECT r.r_regionkey AS k, 42 AS i, 'a''b' AS s, TRUE AS t, FALSE AS f, NULL AS n FROM t_region r", "SELECT r.r_regionkey AS k, CAST(42 AS BIGINT) AS i, 'a''b' AS s, TRUE AS t, FALSE AS f, CAST(NULL AS BOOLEAN) AS n FROM t_region r")
_q("parentheses_precedence", "SELECT l.l_orderkey AS k, (l.l_quantity + 1) * 2 - l.l_linenumber % 3 * 2 AS v FROM t_lineitem l WHERE l.l_quantity = 1 OR l.l_quantity = 2 AND NOT l.l_linenumber > 3")
# nesting
_q("derived_table", "SELECT k, v FROM (SELECT n.n_nationkey AS k, n.n_nationkey * 2 AS v FROM t_nation n WHERE n.n_nationkey > 3) WHERE v < 40")
_q("derived_table_alias", "SELECT q.k AS k, r.r_name AS r FROM (SELECT n.n_regionkey AS k, COUNT(*) AS c FROM t_nation n GROUP BY n.n_regionkey) AS q JOIN t_region r ON r.r_regionkey = q.k WHERE q.c = 5")
_q("parenthesised_select", "((SELECT n.n_name AS name FROM t_nation n WHERE n.n_nationkey < 5))")
_q("parenthesised_join", "SELECT n.n_name AS n, r.r_name AS r, s.s_name AS s FROM (t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey) JOIN t_supplier s ON s.s_nationkey = n.n_nationkey")
# joins
_q("join_inner_equi", "SELECT n.n_name AS n, r.r_name AS r FROM t_nation n INNER JOIN t_region r ON n.n_regionkey = r.r_regionkey")
_q("join_multi_key", "SELECT a.l_orderkey AS k, a.l_linenumber AS n, b.l_quantity AS q FROM t_lineitem a JOIN t_lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_partkey < b.l_partkey")
_q("join_chain", "SELECT o.o_orderkey AS k, c.c_name AS c, n.n_name AS n, r.r_name AS r FROM t_orders o JOIN t_customer c ON o.o_custkey = c.c_custkey JOIN t_nation n ON c.c_nationkey = n.n_nationkey JOIN t_region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
_q("join_left", "SELECT o.o_orderkey AS k, l.l_linenumber AS n FROM t_orders o LEFT JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 40")
_q("join_right", "SELECT o.o_orderkey AS k, l.l_linenumber AS n FROM t_lineitem l RIGHT OUTER JOIN t_orders o ON o.o_orderkey = l.l_orderkey")
_q("join_full", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p.p_partkey AS p_partkey FROM t_part p WHERE p.p_size < 20) AS a FULL JOIN (SELECT p.p_partkey AS p_partkey FROM t_part p WHERE p.p_size > 10) AS b ON a.p_partkey = b.p_partkey")
_q("join_theta", "SELECT n.n_name AS n, r.r_name AS r FROM t_nation n JOIN t_region r ON n.n_regionkey > r.r_regionkey")
_q("join_left_theta", "SELECT r.r_name AS r, n.n_name AS n FROM t_region r LEFT JOIN t_nation n ON n.n_nationkey < r.r_regionkey")
_q("join_full_theta", "SELECT r.r_name AS r, n.n_name AS n FROM t_region r FULL JOIN t_nation n ON n.n_nationkey < r.r_regionkey")
_q("join_range", "SELECT a.n_nationkey AS a, b.p_partkey AS b FROM t_nation a JOIN t_part b ON b.p_size BETWEEN a.n_nationkey AND a.n_nationkey + 1")
_q("join_cross", "SELECT r.r_name AS r, n.n_name AS n FROM t_region r CROSS JOIN t_nation n")
_q("join_comma_where", "SELECT n.n_name AS n, r.r_name AS r FROM t_nation n, t_region r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3")
_q("join_self_alias", "SELECT a.n_name AS a, b.n_name AS b FROM t_nation a JOIN t_nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
# The order key bounds the fan-out.
_WHOLE = "holes a {} JOIN holes b ON a.x = b.y AND a.l_orderkey = b.l_orderkey"
_q("join_null_keys", f"SELECT a.l_orderkey AS a, b.l_orderkey AS b, a.x AS x FROM {_WHOLE.format('INNER')}")
_q("join_null_keys_full", f"SELECT a.l_orderkey AS a, b.l_orderkey AS b, a.x AS x FROM {_WHOLE.format('FULL')}")
_q("join_string_key", "SELECT a.c_custkey AS c, b.s_suppkey AS s FROM customer_dim a JOIN supplier_dim b ON a.c_city = b.s_city")
for _hint in ("broadcast", "merge", "shuffle_hash"):
    _q(f"join_hint_{_hint}", "SELECT o.o_orderkey AS k, SUM(l.l_quantity) AS q FROM t_orders o JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey", join_hint=_hint)
_q("outer_to_inner", "SELECT o.o_orderkey AS k, l.l_quantity AS q FROM t_orders o LEFT JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45")
_q("outer_not_and", "SELECT o.o_orderkey AS k, l.l_linenumber AS n FROM t_orders o LEFT JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey WHERE NOT (l.l_linenumber = 1 AND o.o_orderstatus = 'F')")
# aggregation
_q("agg_scalar", "SELECT COUNT(*) AS n, COUNT(h.x) AS nx, SUM(h.x) AS sx, SUM(h.x * h.y) AS sxy FROM holes h")
_q("agg_scalar_empty", "SELECT SUM(h.x) AS s, COUNT(h.x) AS c, COUNT(*) AS n FROM holes h WHERE h.l_quantity < 0")
_q("agg_group", "SELECT l.l_returnflag AS f, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM t_lineitem l GROUP BY l.l_returnflag")
_q("agg_group_multi", "SELECT l.l_returnflag AS f, l.l_linestatus AS s, SUM(l.l_extendedprice) AS p, SUM(l.l_extendedprice * (100 - l.l_discount)) AS d, COUNT(*) AS n FROM t_lineitem l WHERE l.l_shipdate <= 19980902 GROUP BY l.l_returnflag, l.l_linestatus ORDER BY l.l_returnflag, l.l_linestatus")
_q("agg_group_null_key", "SELECT h.x AS x, h.f AS f, COUNT(*) AS n, COUNT(h.y) AS c FROM holes h GROUP BY h.x, h.f")
_q("agg_group_only", "SELECT c.c_mktsegment AS m, c.c_nationkey AS n FROM t_customer c GROUP BY c.c_mktsegment, c.c_nationkey")
_q("agg_group_expr", "SELECT l.l_quantity / 10 AS b, COUNT(*) AS n FROM t_lineitem l GROUP BY l.l_quantity / 10", "SELECT l.l_quantity // 10 AS b, COUNT(*) AS n FROM t_lineitem l GROUP BY l.l_quantity // 10")
_q("agg_expr", "SELECT l.l_linenumber AS k, SUM(l.l_quantity * l.l_discount + 1) AS s FROM t_lineitem l GROUP BY l.l_linenumber")
_q("agg_over_expr", "SELECT l.l_linenumber AS k, SUM(l.l_quantity) - SUM(l.l_discount) * 2 AS d, SUM(l.l_quantity) / COUNT(*) AS m FROM t_lineitem l GROUP BY l.l_linenumber", "SELECT l.l_linenumber AS k, SUM(l.l_quantity) - SUM(l.l_discount) * 2 AS d, SUM(l.l_quantity) // COUNT(*) AS m FROM t_lineitem l GROUP BY l.l_linenumber")
_q("agg_sort_based", "SELECT o.o_orderkey AS k, COUNT(*) AS n FROM t_orders o JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey", join_hint="merge", sort_aggregate=True)
_PUSH = "SELECT r.r_name AS r, SUM(n.n_nationkey) AS s, COUNT(n.n_name) AS c, COUNT(*) AS n FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 2 AND r.r_regionkey < 4 GROUP BY r.r_name"
_q("agg_pushdown", _PUSH, rewrites=ALL)
_q("agg_pushdown_off", _PUSH, rewrites=())
_q("agg_pushdown_duplicates", "SELECT o.o_orderpriority AS p, SUM(o.o_totalprice) AS s, COUNT(*) AS n FROM t_orders o JOIN t_lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority", rewrites=ALL)
_q("agg_pushdown_count_empty", "SELECT COUNT(*) AS n, SUM(n.n_nationkey) AS s FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey > 99", rewrites=ALL)
_q("agg_transpose", "SELECT l.l_orderkey AS k, SUM(l.l_quantity) AS q, COUNT(*) AS n FROM t_lineitem l JOIN t_orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY l.l_orderkey")
_q("agg_transpose_off", "SELECT l.l_orderkey AS k, SUM(l.l_quantity) AS q, COUNT(*) AS n FROM t_lineitem l JOIN t_orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY l.l_orderkey", rewrites=())
# order
_q("order_by_multi", "SELECT n.n_regionkey AS r, n.n_name AS n FROM t_nation n ORDER BY n.n_regionkey DESC, n.n_name ASC")
_q("order_by_alias", "SELECT l.l_linenumber AS k, SUM(l.l_quantity) AS q FROM t_lineitem l GROUP BY l.l_linenumber ORDER BY q DESC")
_q("order_by_unprojected", "SELECT n.n_name AS n FROM t_nation n ORDER BY n.n_regionkey, n.n_nationkey DESC")
_q("order_by_nulls", "SELECT h.x AS x, h.l_orderkey AS k FROM holes h ORDER BY h.x DESC, h.l_orderkey")
# index seek
_q("index_seek_eq", "SELECT o.o_orderkey AS k, o.o_custkey AS c FROM s_orders o WHERE o.o_orderkey = 777")
_q("index_seek_range", "SELECT o.o_orderkey AS k, o.o_custkey AS c FROM s_orders o WHERE o.o_orderkey >= 1000 AND o.o_orderkey < 1100 AND o.o_orderstatus = 'F' ORDER BY k")
# star schema
_REV = "SELECT SUM(lo.lo_extendedprice * lo.lo_discount) AS revenue"
_q("ssb_q1_1", f"{_REV} {_LO} WHERE d.d_year = 1996 AND lo.lo_discount BETWEEN 1 AND 3 AND lo.lo_quantity < 25")
_q("ssb_q1_2", f"{_REV} {_LO} WHERE d.d_yearmonthnum = 199601 AND lo.lo_discount BETWEEN 4 AND 6 AND lo.lo_quantity BETWEEN 26 AND 35")
_q("ssb_q1_3", f"{_REV} {_LO} WHERE d.d_weeknuminyear = 6 AND d.d_year = 1996 AND lo.lo_discount BETWEEN 5 AND 7 AND lo.lo_quantity BETWEEN 26 AND 35")
_SUM2 = f"SELECT SUM(lo.lo_revenue) AS lo_revenue, d.d_year AS d_year, p.p_brand AS p_brand {_LO} {_P} {_S} WHERE"
_BY2 = "GROUP BY d.d_year, p.p_brand ORDER BY d.d_year, p.p_brand"
_q("ssb_q2_1", f"{_SUM2} p.p_category = 'MFGR#12' AND s.s_region = 'AMERICA' {_BY2}")
_q("ssb_q2_2", f"{_SUM2} p.p_brand BETWEEN 'Brand#21' AND 'Brand#24' AND s.s_region = 'ASIA' {_BY2}")
_q("ssb_q2_3", f"{_SUM2} p.p_brand = 'Brand#21' AND s.s_region = 'EUROPE' {_BY2}")
_BY3 = "ORDER BY d.d_year, lo_revenue DESC"
_q("ssb_q3_1", f"SELECT c.c_nation AS c_nation, s.s_nation AS s_nation, d.d_year AS d_year, SUM(lo.lo_revenue) AS lo_revenue {_LO} {_C} {_S} WHERE c.c_region = 'ASIA' AND s.s_region = 'ASIA' AND d.d_year BETWEEN 1995 AND 2000 GROUP BY c.c_nation, s.s_nation, d.d_year {_BY3}")
_CITY = f"SELECT c.c_city AS c_city, s.s_city AS s_city, d.d_year AS d_year, SUM(lo.lo_revenue) AS lo_revenue {_LO} {_C} {_S} WHERE"
_BYC = f"GROUP BY c.c_city, s.s_city, d.d_year {_BY3}"
_q("ssb_q3_2", f"{_CITY} c.c_nation = 'NATION_9' AND s.s_nation = 'NATION_9' AND d.d_year BETWEEN 1995 AND 2000 {_BYC}")
_q("ssb_q3_3", f"{_CITY} c.c_city IN ('NATION_9#1', 'NATION_9#5') AND s.s_city IN ('NATION_9#1', 'NATION_9#5', 'NATION_8#3') AND d.d_year BETWEEN 1995 AND 2000 {_BYC}")
_q("ssb_q3_4", f"{_CITY} c.c_city IN ('NATION_9#1', 'NATION_9#5') AND s.s_city IN ('NATION_9#1', 'NATION_9#5', 'NATION_8#3') AND d.d_yearmonthnum BETWEEN 199707 AND 199712 {_BYC}")
_PROFIT = f"SUM(lo.lo_revenue - lo.lo_supplycost) AS profit {_LO} {_C} {_S} {_P} WHERE"
_q("ssb_q4_1", f"SELECT d.d_year AS d_year, c.c_nation AS c_nation, {_PROFIT} c.c_region = 'AMERICA' AND s.s_region = 'AMERICA' AND p.p_mfgr IN ('MFGR#1', 'MFGR#2') GROUP BY d.d_year, c.c_nation ORDER BY d.d_year, c.c_nation")
_q("ssb_q4_2", f"SELECT d.d_year AS d_year, s.s_nation AS s_nation, p.p_category AS p_category, {_PROFIT} c.c_region = 'AMERICA' AND s.s_region = 'AMERICA' AND d.d_year IN (1997, 1998) AND p.p_mfgr IN ('MFGR#1', 'MFGR#2') GROUP BY d.d_year, s.s_nation, p.p_category ORDER BY d.d_year, s.s_nation, p.p_category")
_q("ssb_q4_3", f"SELECT d.d_year AS d_year, s.s_city AS s_city, p.p_brand AS p_brand, {_PROFIT} s.s_nation = 'NATION_9' AND d.d_year IN (1997, 1998) AND p.p_category = 'MFGR#14' GROUP BY d.d_year, s.s_city, p.p_brand ORDER BY d.d_year, s.s_city, p.p_brand")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql, _, options = SUITE[name]
    options = dict(options)
    engine = Engine(catalog(spark, sf_dir))
    by_sort = options.pop("sort_aggregate", False)
    for k, v in options.items():
        setattr(engine, k, v)
    if not by_sort:
        return engine.sql(sql)
    # The strategy is chosen when the plan is made, so it is made while the setting holds.
    old = spark.conf.get("spark.sql.execution.replaceHashWithSortAgg")
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    try:
        df = engine.sql(sql)
        df._jdf.queryExecution().executedPlan()
        return df
    finally:
        spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", old)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in SUITE}


def duck_text(sql: str) -> str:
    """Dialect text for DuckDB: whole sums are 64-bit, and used views are defined in front."""
    out, at = "", 0
    for m in re.finditer(r"\b(SUM|COUNT)\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : m.start()] + f"CAST({sql[m.start() : end]} AS BIGINT)"
        at = end
    out += sql[at:]
    out = re.sub(r"\b(1 \+ 2)\b", r"CAST(\1 AS BIGINT)", out)
    used = [v for v in SQL if re.search(rf"\b{v}\b", out)]
    return ("WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in used) + " " if used else "") + out


def oracle_sql() -> dict[str, str]:
    return {name: duck_text(duck or sql) for name, (sql, duck, _) in SUITE.items()}
