import duckdb
import pytest

from starql.engine import Engine
from starql.errors import NameProblem, TypeMismatch
from starql.operators.rewrites import ALL
from starql.querygen import OWN, POSTGRES, TRANSACT, QueryGenerator, TableSpec, to_sql
from starql.sources import Catalog, csv_catalog, read_typed_csv, write_typed_csv
from starql.sources.pipe_tables import SSB_SCHEMA, read_tbl
from starql.sources.sinks import fixed_width, tab_separated

from .fixtures import write_files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("csv"))


@pytest.fixture(scope="module")
def catalog(spark, folder):
    return csv_catalog(spark, folder)


@pytest.fixture(scope="module")
def run(catalog):
    def go(sql, **options):
        return [tuple(r) for r in Engine(catalog, **options).sql(sql).collect()]

    return go


def test_scan_filter(run):
    assert len(run("SELECT users.id FROM users")) == 17
    assert sorted(run("SELECT users.id FROM users WHERE users.age < 10")) == [(5,), (6,)]
    assert len(run("SELECT users.id FROM users WHERE users.age > 10")) == 15
    assert len(run("SELECT * FROM users, books WHERE users.age < 10")) == 6
    assert sorted(run("SELECT users.id FROM users WHERE users.age BETWEEN 5 AND 11")) == [(4,), (6,)]


def test_joins(run):
    on = "ON employees.department_id = departments.id"
    assert sorted(run(f"SELECT * FROM employees JOIN departments {on}")) == [(1, 3, 3), (5, 1, 1), (6, 5, 5)]
    left = run(f"SELECT * FROM employees LEFT JOIN departments {on}")
    assert len(left) == 11 and sum(r[2] is None for r in left) == 8
    right = run(f"SELECT * FROM employees RIGHT JOIN departments {on}")
    assert sorted(r[2] for r in right if r[0] is None) == [2, 4]
    got = run(f"SELECT departments.id*2, employees.id+1 FROM employees RIGHT JOIN departments {on} AND departments.id > 3 AND departments.id*2*2/2 < 30")
    assert sorted(got, key=str) == sorted([(10, 7), (2, None), (4, None), (6, None), (8, None)], key=str)
    assert run("SELECT COUNT(*) FROM employees JOIN departments_4000 ON employees.id > 0") == [(44000,)]


@pytest.mark.parametrize("hint", [None, "merge", "broadcast", "shuffle_hash"])
def test_null_keys_and_duplicates(run, hint):
    full = run("SELECT * FROM a FULL JOIN b ON a.id = b.id", join_hint=hint)
    assert len(full) == 8 and sum(r[0] == 1 == r[2] for r in full) == 4
    assert run("SELECT lhs.name, lhs.v, rhs.w FROM lhs JOIN rhs ON lhs.name = rhs.name", join_hint=hint) == [("alpha", 1, 10)]


def test_a_broadcast_is_bounded(spark, tmp_path):
    spark.range(2_000_000).selectExpr("id div 1000 AS id").repartitionByRange(1, "id").write.parquet(str(tmp_path / "packed"))
    spark.range(3).selectExpr("id", "'x' AS s").write.parquet(str(tmp_path / "few"))
    spark.range(50).selectExpr("id", "repeat('x', 2000000) AS s").write.parquet(str(tmp_path / "wide"))
    c = Catalog(spark)
    for name in ("packed", "few", "wide"):
        c.add_parquet(name, str(tmp_path / name))
    c.add("listed", spark.range(2_000_000).toDF("id"))
    for name, n in {"few": 3, "packed": 3000, "wide": 3, "listed": 3}.items():
        df = Engine(c, join_hint="broadcast").sql(f"SELECT r.* FROM few JOIN {name} r ON few.id = r.id")
        assert len(df.collect()) == n, name
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == (name == "few"), name


def test_strings(run):
    assert run("SELECT m.id, m.note FROM markets AS m WHERE m.region = 'AMERICA'") == [(1, "North, South")]
    assert run("SELECT m.note FROM markets m WHERE m.id = 3") == [("",)]
    assert sorted(run("SELECT m.id FROM markets m WHERE m.region IN ('AMERICA', 'ASIA')")) == [(1,), (3,)]
    assert run("SELECT m.id FROM markets m WHERE m.region NOT IN ('AMERICA', 'ASIA')") == [(2,)]
    assert len(run("SELECT m.id FROM markets m WHERE m.region >= 'AMERICA'")) == 3
    assert run("SELECT 'MFGR#2223' BETWEEN 'MFGR#2221' AND 'MFGR#2228'") == [(True,)]


def test_three_valued_logic(run):
    assert run("SELECT 2 IN (1, NULL), 2 NOT IN (1, NULL), 2 IN (2, NULL), NULL IN (1, 2)") == [(None, None, True, None)]
    assert run("SELECT NULL AND FALSE, NULL OR TRUE, NOT NULL, NULL IS NULL, (NULL = 1) IS UNKNOWN, NULL IS TRUE") == [(False, True, None, True, True, False)]


def test_aggregates(run):
    assert run("SELECT COUNT(*), SUM(users.age) FROM users") == [(17, 1182)]
    groups = run("SELECT users.age, COUNT(*) FROM users GROUP BY users.age")
    assert len(groups) == 11 and sum(r[1] for r in groups) == 17
    assert run("SELECT COUNT(*), COUNT(users.id), SUM(users.id) FROM users WHERE users.id > 99") == [(0, 0, None)]
    assert sorted(run("SELECT users.age FROM users GROUP BY users.age"))[0] == (1,)


def test_order(run):
    assert run("SELECT a.id FROM a ORDER BY a.id DESC")[-1] == (None,)
    assert run("SELECT a.id FROM a ORDER BY a.id")[-1] == (None,)
    assert [r[0] for r in run("SELECT users.id AS k FROM users ORDER BY users.age DESC, k")][:2] == [15, 3]
    # an alias wins over an input column of the same name
    assert run("SELECT 0 - books.id AS id FROM books ORDER BY id") == [(-3,), (-2,), (-1,)]


def test_names(run, catalog):
    assert Engine(catalog).sql("SELECT * FROM a JOIN b ON a.id = b.id").columns == ["a_id", "v", "b_id", "w"]
    with pytest.raises(NameProblem):
        run("SELECT id FROM a JOIN b ON a.id = b.id")
    with pytest.raises(NameProblem):
        run("SELECT users.nope FROM users")
    with pytest.raises(NameProblem):
        run("SELECT users.id, COUNT(*) FROM users GROUP BY users.age")
    assert run("SELECT age FROM users WHERE id = 3") == [(123,)]


@pytest.mark.parametrize("e", ["users.id = 'x'", "users.id AND TRUE", "users.id + TRUE = 1", "NOT users.id", "users.id IN ('a')", "users.id"])
def test_type_errors(run, e):
    with pytest.raises(TypeMismatch):
        run(f"SELECT users.id FROM users WHERE {e}")


def test_sum_of_strings_is_refused(run):
    with pytest.raises(TypeMismatch):
        run("SELECT SUM(markets.region) FROM markets")


@pytest.mark.parametrize("e", ["1 / 0", "1 % 0", "9223372036854775807 + 1"])
def test_arithmetic_errors(run, e):
    with pytest.raises(Exception, match="ZERO|OVERFLOW"):
        run(f"SELECT {e}")


def test_aggregation_moves_below_joins(catalog):
    sql = "SELECT employees.department_id, COUNT(*), SUM(employees.id) FROM employees JOIN departments ON employees.department_id = departments.id GROUP BY employees.department_id"
    moved, off = Engine(catalog, rewrites=("aggregate_before_join",)), Engine(catalog, rewrites=())
    assert moved.plan(sql)[1] == {"aggregate_before_join": 1}
    plan = moved.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert sorted(map(tuple, moved.sql(sql).collect())) == sorted(map(tuple, off.sql(sql).collect()))
    eager = Engine(catalog, rewrites=("eager_aggregation",))
    assert eager.plan(sql)[1] == {"eager_aggregation": 1}
    assert sorted(map(tuple, eager.sql(sql).collect())) == sorted(map(tuple, off.sql(sql).collect()))
    empty = "SELECT COUNT(*), SUM(employees.id) FROM employees JOIN departments ON employees.department_id = departments.id WHERE departments.id > 50"
    assert [tuple(r) for r in eager.sql(empty).collect()] == [(0, None)]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "'x' AS s").sort("id").write.parquet(str(tmp_path / "t"))
    cat = Catalog(spark).add_parquet("t", str(tmp_path / "t"))
    plan = Engine(cat).sql("SELECT t.k FROM t WHERE t.id >= 10 AND t.id < 20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "LessThan(id,20)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan


def test_csv_round_trip_and_errors(spark, tmp_path, folder):
    df = read_typed_csv(spark, f"{folder}/markets.csv")
    write_typed_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_typed_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "short.csv").write_text("a:int,b:int\n1\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_typed_csv(spark, str(tmp_path / "short.csv")).collect()
    (tmp_path / "bad.csv").write_text("a:float\n1\n")
    with pytest.raises(TypeMismatch):
        read_typed_csv(spark, str(tmp_path / "bad.csv"))


def test_pipe_tables(spark, tmp_path):
    (tmp_path / "supplier.tbl").write_text("1|S1|addr|CITY 1|NATION|ASIA|12-34|\n2|S2||CITY 2|NATION|EUROPE|56-78|\n")
    got = read_tbl(spark, str(tmp_path / "supplier.tbl"), SSB_SCHEMA["supplier"]).collect()
    assert [r.s_suppkey for r in got] == [1, 2] and got[1].s_address == ""
    (tmp_path / "bad.tbl").write_text("1|S1|\n")
    with pytest.raises(Exception, match="expected 7 fields"):
        read_tbl(spark, str(tmp_path / "bad.tbl"), SSB_SCHEMA["supplier"]).collect()


def test_constraints(catalog, spark):
    assert catalog.is_unique("departments", "id") and catalog.validate() == ["foreign_key employees department_id departments id"]
    assert catalog.size("users") == 17 and catalog.size("nowhere") == 10


def test_sinks(catalog):
    rel = Engine(catalog).relation("SELECT a.id, a.id = 1 AS one FROM a ORDER BY a.id, a.v")
    assert tab_separated(rel, True).splitlines() == ["a.id:int\t.one:bool", "1\t1", "1\t1", "2\t0", "NULL\tNULL"]
    assert fixed_width(rel).splitlines()[0] == "1       TRUE     "


def assert_ordered(q, rows):
    """Rows follow the keys of ORDER BY as far as these are in the result; NULLs come last."""
    at = []
    for key in q.order:
        if key.attr not in q.op.exprs:
            break
        at.append((q.op.exprs.index(key.attr), key.descending))
    for a, b in zip(rows, rows[1:]):
        for k, down in at:
            if a[k] != b[k]:
                assert b[k] is None or a[k] is not None and (a[k] > b[k]) == down, (to_sql(q), a, b)
                break


def test_dialects():
    specs = [TableSpec("p", {"k": "int", "s": "string"}, {"k": [1, 2], "s": ["<>", "it's"]}), TableSpec("q", {"k": "int"}, {"k": [3]})]
    texts = [QueryGenerator(specs, seed).query() for seed in range(200)]
    own, server, plain = ([to_sql(q, dialect=d) for q in texts] for d in (OWN, TRANSACT, POSTGRES))
    assert any("FULL JOIN q" in t for t in own) and any("FULL OUTER JOIN dbo.q" in t for t in server) and all("dbo.p" in t or "dbo.q" in t for t in server)
    assert any(" != " in t for t in plain) and not any(" <> " in t for t in plain) and any("'<>'" in t for t in plain)


def test_random_queries_agree_with_duckdb(spark):
    rows = {"p": [(k % 5 if k % 7 else None, k % 3, "abc"[k % 3]) for k in range(30)], "q": [(k % 4, k if k % 5 else None, "bcd"[k % 3] if k % 4 else None) for k in range(20)]}
    con, cat = duckdb.connect(), Catalog(spark)
    for name, data in rows.items():
        cat.add(name, spark.createDataFrame(data, "k long, v long, s string"))
        con.execute(f"CREATE TABLE {name} (k BIGINT, v BIGINT, s VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", data)
    specs = [TableSpec(n, {"k": "int", "v": "int", "s": "string"}, {"k": [0, 1, 2, 3], "v": [0, 1, 2, 9], "s": ["a", "b", "c"]}) for n in rows]
    for seed in range(40):
        q = QueryGenerator(specs, seed).query()
        want = sorted(map(repr, con.execute(to_sql(q, duckdb=True)).fetchall()))
        for options in ({}, {"rewrites": ALL}):
            rows = Engine(cat, **options).sql(to_sql(q)).collect()
            assert sorted(repr(tuple(r)) for r in rows) == want, to_sql(q)
            assert_ordered(q, rows)


def test_sorted_table_skips_files(spark, tmp_path):
    from starql.sources.sorted_table import add_sorted, write_sorted

    df = spark.range(4000).selectExpr("(id * 7919) % 4000 AS id", "id AS v")
    write_sorted(df, str(tmp_path / "t"), "id", files=4)
    cat = add_sorted(Catalog(spark), "t", str(tmp_path / "t"), "id")
    out = Engine(cat).sql("SELECT t.id, t.v FROM t WHERE t.id >= 8 AND t.id < 12 AND t.v <> 5 ORDER BY t.id")
    assert [r.id for r in out.collect()] == [8, 9, 10, 11]
    assert "PushedFilters: [IsNotNull(id), IsNotNull(v), GreaterThanOrEqual(id,8), LessThan(id,12)" in out._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(str(tmp_path / "t")).selectExpr("input_file_name() AS f", "id").groupBy("f").agg({"id": "count"}).count()
    assert files == 4
    assert ("t", "id") in cat.sorted_indexes
