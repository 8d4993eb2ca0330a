"""Every registered relational query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from starql.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(repr, want.fetchall()))


def test_results_come_in_the_order_asked_for(spark, duck):
    for name in ("order_by_multi", "order_by_alias", "order_by_unprojected", "order_by_nulls"):
        got = [tuple(r) for r in queries()[name](spark, SF).collect()]
        sql = oracle_sql()[name].replace(" DESC", " DESC NULLS LAST")
        assert got == duck.execute(sql).fetchall(), name


def test_nulls_are_joined_and_ordered_over_whole_tables(spark, duck):
    rows, orders = duck.execute("SELECT count(*), count(DISTINCT l_orderkey) FROM lineitem").fetchone()
    full = queries()["join_null_keys_full"](spark, SF).collect()
    assert len({r.a for r in full} - {None}) == len({r.b for r in full} - {None}) == orders
    got = [tuple(r) for r in queries()["order_by_nulls"](spark, SF).collect()]
    assert len(got) == rows
    assert got == duck.execute(oracle_sql()["order_by_nulls"].replace(" DESC", " DESC NULLS LAST")).fetchall()


def _scan_rows(df):
    """Rows that each scan of a collected plan has put out, and what was pushed to it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return [(leaves.apply(k).metrics().apply("numOutputRows").value(), leaves.apply(k).toString()) for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numOutputRows")]


def test_a_seek_reads_a_part_of_the_sorted_table(spark):
    df = queries()["index_seek_eq"](spark, SF)
    ((rows, scan),) = _scan_rows(df)
    total = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "EqualTo(o_orderkey,777)" in scan and rows <= total / 2


def test_ranges_of_the_star_queries_are_pushed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries()["ssb_q1_1"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lo_discount,1)" in plan and "LessThanOrEqual(lo_discount,3)" in plan and "LessThan(lo_quantity,25)" in plan
    for name in ("ssb_q1_1", "ssb_q4_1"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "orders.parquet" not in plan and plan.count("FileScan") == len({"lineorder", "date_dim"}) + 3 * (name == "ssb_q4_1")


def test_sort_based_aggregation_is_what_runs(spark):
    df = queries()["agg_sort_based"](spark, SF)
    df.collect()
    assert "SortAggregate" in df._jdf.queryExecution().executedPlan().toString()
