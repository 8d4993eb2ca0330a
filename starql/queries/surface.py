"""Queries over the rest of the surface: text sources and sinks, plan texts, plan tools, random queries, command line.

Each has DuckDB text with the same result.  Tools whose result does not depend on the data (syntax trees, plan search,
errors) come as small tables of what they say, beside the expected values."""

from __future__ import annotations

import io
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import main as command_line
from ..engine import Engine
from ..errors import QueryError
from ..frontend.ast import to_dot, to_sexpr
from ..frontend.parser import parse
from ..plans.measure import cost_and_time
from ..plans.physical import deserialize, from_plan, serialize
from ..plans.physical import to_dot as plan_to_dot
from ..plans.predicates import equivalent
from ..plans.search import optimize, reach
from ..querygen import DUCKDB, QueryGenerator, TableSpec, to_sql
from ..sources import Catalog, csv_catalog, read_typed_csv, write_typed_csv
from ..sources.pipe_tables import SSB_SCHEMA, convert_tbl, read_tbl
from ..sources.sinks import fixed_width_lines, tab_separated_lines
from ..sources.stored import stored
from .views import catalog

SURFACE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _q(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        SURFACE[name] = (f, sql)
        return f

    return register


# --- typed CSV and pipe-separated sources -------------------------------------------------------------------------


def csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Parts (with commas and quotes in a note) and line items with NULLs as a folder of typed CSV tables."""

    def write(path: str) -> None:
        views = catalog(spark, sf_dir)
        note = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
        write_typed_csv(views.table("t_part").select("p_partkey", note.alias("note"), F.lit("").alias("blank"), "p_size"), f"{path}/parts.csv")
        write_typed_csv(views.table("holes"), f"{path}/gaps.csv")
        lines = spark.createDataFrame([("# keys of the folder",), ("unique parts p_partkey",)], "line string")
        lines.coalesce(1).write.text(f"{path}/constraints.meta")
        spark.createDataFrame([("parts p_partkey sorted parts.idx",)], "line string").coalesce(1).write.text(f"{path}/indexes.meta")

    return stored(spark, f"{sf_dir} csv folder", write)


def _csv(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(csv_catalog(spark, csv_folder(spark, sf_dir))).sql(sql)


_PARTS = "SELECT p_partkey, concat(p_name, ', \"', p_brand, '\"') AS note, '' AS blank, CAST(p_size AS BIGINT) AS p_size FROM part"
_GAPS = "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(NULLIF(l_linenumber, 3) AS BIGINT) AS x, CAST(NULLIF(l_linenumber, 5) AS BIGINT) AS y, NULLIF(l_returnflag, 'R') AS f FROM lineitem"
_q("csv_scan", f"SELECT p_partkey AS k, note, blank, p_size AS s FROM ({_PARTS}) WHERE p_size > 10")(_csv("SELECT p.p_partkey AS k, p.note AS note, p.blank AS blank, p.p_size AS s FROM parts p WHERE p.p_size > 10"))
_q("csv_nulls", f"SELECT x, f, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS s FROM ({_GAPS}) GROUP BY x, f")(_csv("SELECT g.x AS x, g.f AS f, COUNT(*) AS n, SUM(g.y) AS s FROM gaps g GROUP BY g.x, g.f"))
_q("csv_join", f"SELECT g.l_orderkey AS k, p.note FROM ({_GAPS}) g JOIN ({_PARTS}) p ON g.l_orderkey = p.p_partkey")(_csv("SELECT g.l_orderkey AS k, p.note AS note FROM gaps g JOIN parts p ON g.l_orderkey = p.p_partkey"))


def tbl_file(spark: SparkSession, sf_dir: str) -> str:
    """The supplier dimension as generator output: fields and a separator at the end of each line."""

    def write(path: str) -> None:
        s = catalog(spark, sf_dir).table("supplier_dim").join(catalog(spark, sf_dir).table("t_supplier"), "s_suppkey")
        s.select(F.concat(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.lit(""), "s_city", "s_nation", "s_region", F.lit("12-34")), F.lit("|"))).write.text(path)

    return stored(spark, f"{sf_dir} supplier.tbl", write)


_SUPPLIERS = "SELECT s_suppkey, s_name, '' AS s_address, concat(n_name, '#', CAST(s_suppkey % 10 AS VARCHAR)) AS s_city, n_name AS s_nation, r_name AS s_region, '12-34' AS s_phone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@_q("tbl_scan", f"SELECT s_region AS r, s_nation AS n, CAST(count(*) AS BIGINT) AS c, CAST(sum(s_suppkey) AS BIGINT) AS k FROM ({_SUPPLIERS}) GROUP BY ALL")
def tbl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark).add("suppliers", read_tbl(spark, tbl_file(spark, sf_dir), SSB_SCHEMA["supplier"]))
    return Engine(cat).sql("SELECT s.s_region AS r, s.s_nation AS n, COUNT(*) AS c, SUM(s.s_suppkey) AS k FROM suppliers s GROUP BY s.s_region, s.s_nation")


@_q("tbl_convert", _SUPPLIERS)
def tbl_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark, f"{sf_dir} supplier.csv", lambda p: convert_tbl(spark, tbl_file(spark, sf_dir), p, SSB_SCHEMA["supplier"]))
    return read_typed_csv(spark, path)


@_q("memory_scan", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL), (NULL, 'c')) AS t(k, s)")
def memory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark).add("m", spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k long, s string"))
    return Engine(cat).sql("SELECT * FROM m")


# --- sinks --------------------------------------------------------------------------------------------------------

_SUNK = "SELECT h.l_orderkey AS k, h.x AS x, h.x > 2 AS b, h.f AS f FROM holes h"


@_q("sink_tab_separated", f"SELECT concat_ws(chr(9), CAST(l_orderkey AS VARCHAR), coalesce(CAST(x AS VARCHAR), 'NULL'), coalesce(CAST(CAST(x > 2 AS INT) AS VARCHAR), 'NULL'), coalesce(f, 'NULL')) AS line FROM ({_GAPS})")
def sink_tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab_separated_lines(Engine(catalog(spark, sf_dir)).relation(_SUNK))


_PAD = "concat({0}, repeat(' ', greatest(0, 8 - CAST(length({0}) AS BIGINT))))"


@_q("sink_fixed_width", f"SELECT concat({_PAD.format('CAST(l_orderkey AS VARCHAR)')}, {_PAD.format("coalesce(CAST(x AS VARCHAR), 'NULL')")}, CASE WHEN x > 2 THEN 'TRUE     ' WHEN x <= 2 THEN 'FALSE    ' ELSE 'NULL    ' END, {_PAD.format("coalesce(f, 'NULL')")}) AS line FROM ({_GAPS})")
def sink_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_width_lines(Engine(catalog(spark, sf_dir)).relation(_SUNK))


@_q("command_line", f"SELECT line FROM (SELECT 0 AS i, 0 AS n, 'parts.p_partkey:int' || chr(9) || 'parts.note:string' AS line UNION ALL SELECT 1, p_partkey, p_partkey || chr(9) || note FROM ({_PARTS}) WHERE p_size = 7)")
def command_line_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    code = command_line(["--data-dir", csv_folder(spark, sf_dir)], "SELECT parts.p_partkey, parts.note FROM parts WHERE parts.p_size = 7 ORDER BY parts.p_partkey", spark, out, io.StringIO())
    if code:
        raise RuntimeError(f"exit code {code}")
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


# --- plans from text ----------------------------------------------------------------------------------------------


def _plan(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rel = from_plan(deserialize(serialize(deserialize(text))), catalog(spark, sf_dir))
        return rel.df.select(*[rel.df[c.ref].alias(c.name) for c in rel.cols])

    return run


_q("plan_text_hash_join", "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > 5")(
    _plan('(PhysicalProjection (exprs (attr c c_custkey) (attr n n_name)) (aliases "k" "nation") (HashJoin Inner (= (attr c c_nationkey) (attr n n_nationkey)) (PhysicalFilter (> (attr c c_custkey) 5) (SeqScan t_customer c)) (SeqScan t_nation n)))')
)
_q("plan_text_merge_join", "SELECT n_name, s_name AS supplier FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")(
    _plan('(Sort (keys n.n_name Asc) (PhysicalProjection (exprs (attr n n_name) (attr s s_name)) (aliases - "supplier") (MergeJoin Left (= (attr n n_nationkey) (attr s s_nationkey)) (SeqScan t_nation n) (SeqScan t_supplier s))))')
)
_q("plan_text_aggregate", "SELECT f, CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS s FROM (" + _GAPS + ") GROUP BY f")(
    _plan('(PhysicalProjection (exprs (attr h f) (attr "" __agg0) (attr "" __agg1)) (aliases "f" "n" "s") (HashAggregate (group_by (attr h f)) (aggs (COUNT *) (SUM (attr h x))) (SeqScan holes h)))')
)
_q("plan_text_seek", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 120")(
    _plan('(PhysicalProjection (exprs (attr o o_orderkey)) (aliases "k") (IndexSeek (and (>= (attr o o_orderkey) 100) (< (attr o o_orderkey) 120)) s_orders o))')
)


# --- tools --------------------------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _said(name: str, expected: list[tuple[str, str]], say: Callable[[str], str]) -> None:
    """A table (given, said): what a tool says about each text, beside what it should."""
    rows = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in expected)
    _q(name, f"SELECT * FROM (VALUES {rows}) AS t(given, said)")(lambda spark, sf_dir: spark.createDataFrame([(a, say(a)) for a, _ in expected], "given string, said string"))


def _declared() -> Catalog:
    c = Catalog(None)
    c._schemas = {"users": ["id", "age"], "orders": ["id", "user_id"]}
    c.rows = {"users": 1000, "orders": 1000}
    return c


def _refusal(sql: str) -> str:
    try:
        parse(sql)
    except QueryError as e:
        return e.kind
    return "none"


def _pred(text: str):
    return parse(f"SELECT t.a FROM t WHERE {text}").op.source.pred


def _costs(sql: str) -> str:
    chosen, naive = optimize(parse(sql), _declared()), optimize(parse(sql), _declared(), naive=True)
    return f"{serialize(chosen.plan)} {'cheaper' if chosen.cost < naive.cost else 'equal' if chosen.cost == naive.cost else 'dearer'} {'CrossJoinToJoin' in chosen.rules or 'plain'}"


def _reached(case: str) -> str:
    sql, plan = case.split(" => ")
    found = reach(deserialize(plan), parse(sql), _declared())
    return f"{found.reachable} {found.distance} {found.mismatch}".strip()


_said(
    "tool_syntax_tree",
    [
        ("SELECT * FROM t", "(Table t)"),
        ("SELECT a.x AS k FROM a WHERE a.x > 1", "(Projection a.x AS k (Filter (a.x > 1) (Table a)))"),
        ("SELECT * FROM a LEFT JOIN b ON a.x = b.x, c", "(CrossJoin (Join Left (a.x = b.x) (Table a) (Table b)) (Table c))"),
    ],
    lambda sql: to_sexpr(parse(sql).op),
)
_said("tool_syntax_graph", [("SELECT * FROM t", "digraph 0"), ("SELECT a.x FROM a JOIN b ON a.x = b.x WHERE a.x > 1", "digraph 4")], lambda sql: f"{(t := to_dot(parse(sql).op)).split()[0]} {t.count('->')}")
_said("tool_plan_graph", [("(SeqScan t)", "digraph 0"), ("(HashJoin Inner (= (attr a id) (attr b id)) (SeqScan a) (PhysicalFilter (> (attr b id) 1) (SeqScan b)))", "digraph 3")], lambda plan: f"{(t := plan_to_dot(deserialize(plan))).split()[0]} {t.count('->')}")
_said("tool_plan_text", [(p, p) for p in ("(SeqScan users u)", '(PhysicalProjection (exprs (attr t a) (uminus 5)) (aliases "k" -) (SeqScan t))', "(Sort (keys a.x Asc y Desc) (MergeJoin Full (= (attr a x) (attr b x)) (SeqScan a) (SeqScan b)))")], lambda p: serialize(deserialize(p)))
_said(
    "tool_predicates",
    [("t.a IN (1, 2) :: t.a = 2 OR t.a = 1", "True"), ("t.a NOT BETWEEN 1 AND 3 :: t.a < 1 OR t.a > 3", "True"), ("t.a < 1 :: t.a <= 1", "False")],
    lambda case: str(equivalent(*map(_pred, case.split(" :: ")))),
)
_said(
    "tool_optimizer",
    [
        ("SELECT users.id FROM users", "(PhysicalProjection (exprs (attr users id)) (SeqScan users)) equal plain"),
        ("SELECT * FROM users, orders WHERE users.id = orders.user_id", "(HashJoin Inner (= (attr users id) (attr orders user_id)) (SeqScan users) (SeqScan orders)) cheaper True"),
    ],
    _costs,
)
_said("tool_refusals", [("SELECT DISTINCT a FROM t", "not_supported"), ("SELECT a FROM t LIMIT 3", "not_supported"), ("SELECT 9223372036854775808", "conversion"), ("SELEC a", "syntax"), ("SELECT a FROM t", "none")], _refusal)
_said(
    "tool_reachability",
    [
        ("SELECT * FROM users WHERE users.id IN (1, 2) => (PhysicalFilter (or (= (attr users id) 1) (= (attr users id) 2)) (SeqScan users))", "True 0"),
        ("SELECT * FROM users JOIN orders ON users.id = orders.user_id => (HashJoin Inner (= (attr orders user_id) (attr users id)) (SeqScan orders) (SeqScan users))", "True 0"),
        ("SELECT * FROM users WHERE users.age > 3 => (PhysicalFilter (> (attr users age) 4) (SeqScan users))", "False 1 predicate"),
    ],
    _reached,
)


#: Random queries over small tables: number of rows, and of values that are not NULL, of each.
_SPECS = [
    TableSpec("t_nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, {"n_nationkey": [1, 5, 17], "n_name": ["NATION_3", "NATION_9"], "n_regionkey": [0, 2, 4]}),
    TableSpec("t_region", {"r_regionkey": "int", "r_name": "string"}, {"r_regionkey": [0, 1, 3], "r_name": ["ASIA", "EUROPE"]}),
]
_SEEDS = range(16)


def _random_queries() -> list:
    return [QueryGenerator(_SPECS, seed).query() for seed in _SEEDS]


_NATIONS = "t_nation AS (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation), t_region AS (SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region)"


@_q("random_queries", f"WITH {_NATIONS} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS seed, CAST(count(*) AS BIGINT) AS n, CAST(count(c0) AS BIGINT) AS c FROM ({to_sql(q, dialect=DUCKDB)})" for k, q in zip(_SEEDS, _random_queries(), strict=True)))
def random_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, out = Engine(catalog(spark, sf_dir)), None
    for seed, q in zip(_SEEDS, _random_queries(), strict=True):
        one = engine.sql(to_sql(q)).agg(F.lit(seed).cast("long").alias("seed"), F.count(F.lit(1)).alias("n"), F.count("c0").alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


_TIMED = ["SELECT n.n_name FROM t_nation n WHERE n.n_regionkey = 2", "SELECT n.n_name, r.r_name FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey"]


@_q("cost_against_time", f"SELECT {_text(_TIMED[0])} AS query, CAST(count(*) AS BIGINT) AS n, TRUE AS no_dearer FROM nation WHERE n_regionkey = 2 UNION ALL SELECT {_text(_TIMED[1])}, count(*), TRUE FROM nation JOIN region ON n_regionkey = r_regionkey")
def cost_against_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cost_and_time(Engine(catalog(spark, sf_dir)), _TIMED)
    return spark.createDataFrame([(m.sql, m.rows, m.plan_cost <= m.naive_plan_cost) for m in found], "query string, n long, no_dearer boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(f) for name, (f, _) in SURFACE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SURFACE.items()}
