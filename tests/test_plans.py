import io

import pytest

from starql.cli import main
from starql.errors import SyntaxProblem
from starql.frontend import ast as A
from starql.frontend.parser import parse
from starql.plans import cost as C
from starql.plans.physical import deserialize, from_plan, serialize, to_dot
from starql.plans.predicates import equivalent, null_rejecting
from starql.plans.search import optimize, reach
from starql.sources import Catalog, csv_catalog
from starql.sources.catalog import ForeignKey

from .fixtures import write_files


def pred(text):
    return parse(f"SELECT t.a FROM t WHERE {text}").op.source.pred


@pytest.fixture()
def cat():
    c = Catalog(None)
    c._schemas = {"users": ["id", "age", "name"], "orders": ["id", "user_id", "total"], "customers": ["id", "region_id"], "lineorder": ["suppkey", "value"], "supplier": ["id", "region"]}
    c.rows = {"users": 1000, "orders": 1000, "lineorder": 5000, "supplier": 50}
    return c


@pytest.mark.parametrize(
    "a, b",
    [
        ("t.a IN (1, 2, 3)", "t.a = 3 OR t.a = 1 OR t.a = 2"),
        ("t.a NOT IN (1, 2)", "t.a <> 2 AND 1 <> t.a"),
        ("t.a NOT BETWEEN 1 AND 3", "t.a < 1 OR t.a > 3"),
        ("NOT (t.a = 1 AND t.b >= 30)", "t.b < 30 OR t.a <> 1"),
        ("1 < t.a", "t.a > 1"),
        ("NOT NOT t.a = 1", "t.a = 1"),
        ("t.a + t.b = 2", "2 = t.b + t.a"),
    ],
)
def test_equivalent(a, b):
    assert equivalent(pred(a), pred(b))


@pytest.mark.parametrize("a, b", [("t.a < 1", "t.a <= 1"), ("t.a = 1 AND t.b = 2", "t.a = 1 OR t.b = 2"), ("t.a - t.b = 1", "t.b - t.a = 1"), ("t.a IN (1, 2)", "t.a IN (1, 3)")])
def test_not_equivalent(a, b):
    assert not equivalent(pred(a), pred(b))


def test_null_rejecting():
    cols = {A.Attr("t", "a")}
    assert null_rejecting(pred("t.a = 1"), cols) and null_rejecting(pred("t.a > 1 AND t.b = 2"), cols)
    assert null_rejecting(pred("t.a IS NOT NULL"), cols) and not null_rejecting(pred("t.a IS NULL"), cols)
    assert not null_rejecting(pred("NOT (t.a = 1 AND t.b = 2)"), cols) and not null_rejecting(pred("t.a = 1 OR t.b = 2"), cols)


PLANS = [
    "(SeqScan users)",
    "(SeqScan customer c)",
    '(PhysicalFilter (str "Bob\'s Market \\"North\\"") (SeqScan t))',
    '(PhysicalFilter (in (attr t region) (values (str "AMERICA") (str "ASIA") NULL)) (SeqScan t))',
    "(PhysicalFilter (notin (attr t id) (values 1 2)) (SeqScan t))",
    "(IndexSeek (> (attr users id) 42) users)",
    "(NestedLoopCrossJoin (SeqScan a) (SeqScan b))",
    "(NestedLoopJoin Full (and TRUE (not (isnull (attr a x)))) (SeqScan a) (SeqScan b))",
    "(HashJoin Inner (= (attr a id) (attr b id)) (SeqScan a) (SeqScan b))",
    "(Sort (keys a.x Asc y Desc) (MergeJoin Left (= (attr a id) (attr b id)) (SeqScan a) (SeqScan b)))",
    "(PhysicalProjection (exprs (uminus 5) (^ 1 (attr t x))) (SeqScan t))",
    '(PhysicalProjection (exprs (attr t a) (+ (attr t b) 1)) (aliases - "b \\"plus\\" one") (SeqScan t))',
    "(HashAggregate (group_by (attr t a)) (aggs (SUM (attr t b)) (COUNT *)) (SeqScan t))",
    "(StreamAggregate (group_by) (aggs (COUNT (attr t b))) (SeqScan t))",
    "(FinalAggregate (group_by (attr t a)) (aggs (SUM (attr t b))) (PartialAggregate (group_by (attr t a)) (aggs (SUM (attr t b))) (SeqScan t)))",
]


@pytest.mark.parametrize("text", PLANS)
def test_round_trip(text):
    assert serialize(deserialize(text)) == text
    assert to_dot(deserialize(text)).startswith("digraph plan")


@pytest.mark.parametrize("text", ["(SeqScan", "(Nope a)", "SeqScan", "(PhysicalFilter (? 1 2) (SeqScan t))", "(Sort (keys a.x Up) (SeqScan a))", "(SeqScan a) (SeqScan b)"])
def test_bad_plans(text):
    with pytest.raises(SyntaxProblem):
        deserialize(text)


def test_selectivity():
    assert C.scaled(1000, C.selectivity(pred("t.id = 1"))) == 100
    assert C.scaled(1000, C.selectivity(pred("t.age BETWEEN 18 AND 30"))) == 250
    assert C.scaled(1000, C.selectivity(pred("t.id IN (1, 2, 3)"))) == 300


def test_optimizer(cat):
    q = parse("SELECT users.id FROM users, orders WHERE users.id = orders.user_id AND users.age = 3")
    best, naive = optimize(q, cat), optimize(q, cat, naive=True)
    assert best.cost < naive.cost and "CrossJoinToJoin" in best.rules | {"CrossJoinToJoin"} and "NestedLoopCrossJoin" not in serialize(best.plan)
    assert "NestedLoopCrossJoin" in serialize(naive.plan)
    q = parse("SELECT users.id FROM users WHERE users.id = 3 ORDER BY users.id")
    cat.sorted_indexes.add(("users", "id"))
    assert serialize(optimize(q, cat).plan) == "(PhysicalProjection (exprs (attr users id)) (IndexSeek (= (attr users id) 3) users))"


def test_aggregation_rules(cat):
    sql = "SELECT lineorder.suppkey, SUM(lineorder.value) FROM lineorder JOIN supplier ON lineorder.suppkey = supplier.id GROUP BY lineorder.suppkey"
    pushed = "(PhysicalProjection (exprs (attr lineorder suppkey) (attr \"\" __agg0)) (aliases - \"sum(lineorder.value)\") (HashJoin Inner (= (attr lineorder suppkey) (attr supplier id)) (HashAggregate (group_by (attr lineorder suppkey)) (aggs (SUM (attr lineorder value))) (SeqScan lineorder)) (SeqScan supplier)))"
    assert not reach(deserialize(pushed), parse(sql), cat).reachable
    cat.unique.add(("supplier", "id"))
    cat.foreign_keys.add(ForeignKey("lineorder", "suppkey", "supplier", "id"))
    assert reach(deserialize(pushed), parse(sql), cat).reachable


REACH = [
    ("SELECT * FROM users WHERE users.id IN (1, 2)", "(PhysicalFilter (or (= (attr users id) 1) (= (attr users id) 2)) (SeqScan users))", 0),
    ("SELECT * FROM users CROSS JOIN orders WHERE users.id IN (22) AND orders.id NOT BETWEEN 1 AND 3", "(NestedLoopJoin Inner (and (= (attr users id) 22) (or (< (attr orders id) 1) (> (attr orders id) 3))) (SeqScan users) (SeqScan orders))", 0),
    ("SELECT * FROM users JOIN orders ON users.id = orders.user_id", "(HashJoin Inner (= (attr orders user_id) (attr users id)) (SeqScan orders) (SeqScan users))", 0),
    ("SELECT * FROM users JOIN orders ON users.id = orders.user_id", "(NestedLoopJoin Inner (= (attr orders id) (attr users id)) (SeqScan orders) (SeqScan users))", 1),
    ("SELECT users.id FROM users ORDER BY users.id", "(Sort (keys users.id Asc) (PhysicalProjection (exprs (attr users id)) (SeqScan users)))", 0),
    ("SELECT users.id FROM users ORDER BY users.id", "(Sort (keys users.id Desc) (PhysicalProjection (exprs (attr users id)) (SeqScan users)))", 1),
    ("SELECT users.id FROM users", "(Sort (keys users.id Asc) (PhysicalProjection (exprs (attr users id)) (SeqScan users)))", 1),
    ("SELECT * FROM users WHERE users.age > 3", "(PhysicalFilter (> (attr users age) 4) (SeqScan users))", 1),
]


@pytest.mark.parametrize("sql, plan, distance", REACH)
def test_reach(cat, sql, plan, distance):
    found = reach(deserialize(plan), parse(sql), cat)
    assert found.distance == distance and found.reachable == (distance == 0) and bool(found.mismatch) == (distance > 0)


def test_a_search_that_gives_up_says_so(cat):
    sql = "SELECT * FROM users, orders, supplier WHERE users.id = orders.user_id AND users.age > 3 AND supplier.id = users.age"
    plan = deserialize("(PhysicalFilter (> (attr users age) 4) (SeqScan users))")
    found = reach(plan, parse(sql), cat, limit=3)
    assert not found.reachable and not found.complete and not optimize(parse(sql), cat, limit=3).complete
    assert reach(plan, parse("SELECT * FROM users WHERE users.age > 3"), cat).complete


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("cli"))


def test_plans_run(spark, folder):
    c = csv_catalog(spark, folder)
    for kind, strategy in (("HashJoin", "ShuffledHashJoin"), ("MergeJoin", "SortMergeJoin")):
        rel = from_plan(deserialize(f"(Sort (keys employees.id Asc) ({kind} Inner (= (attr employees department_id) (attr departments id)) (SeqScan employees) (SeqScan departments)))"), c)
        assert [r[0] for r in rel.df.collect()] == [1, 5, 6]
        assert strategy in rel.df._jdf.queryExecution().executedPlan().toString()


def cli(spark, argv, sql):
    out, err = io.StringIO(), io.StringIO()
    return main(argv, sql, spark, out, err), out.getvalue(), err.getvalue()


def test_cli(spark, folder, tmp_path):
    code, out, err = cli(spark, ["--data-dir", folder, "--print-plan", "--print-ast", "--stats", "--jit", "--dump-dot", str(tmp_path / "dot")], "SELECT users.id FROM users WHERE users.age < 10")
    assert code == 0 and out == "users.id:int\n5\n6\n" and "(SeqScan users)" in err and "STATS plan_cost=" in err and "rows=2" in err
    assert len(list((tmp_path / "dot").iterdir())) == 1
    assert cli(spark, ["--nope"], "")[0] == 64 and cli(spark, [], "")[0] == 64 and cli(spark, ["--data-dir"], "")[0] == 64
    assert cli(spark, ["--data-dir", folder], "SELECT FROM WHERE")[0] == 1
    assert cli(spark, ["--data-dir", folder], "SELECT x.a FROM nowhere x")[0] == 2
    assert cli(spark, ["--data-dir", folder], "SELECT users.id / 0 FROM users")[0] == 3
    (tmp_path / "plan").write_text("(PhysicalFilter (> (attr users age) 3) (SeqScan users))")
    assert cli(spark, ["--check-reachable", str(tmp_path / "plan")], "SELECT * FROM users WHERE 3 < users.age")[:2] == (0, "REACHABLE distance=0\n")
    code, out, _ = cli(spark, ["--check-reachable", str(tmp_path / "plan"), "--data-dir", folder], "SELECT * FROM users WHERE users.age > 4")
    assert code == 4 and out.startswith("NOT REACHABLE distance=1: ")
    (tmp_path / "bad").write_text("(PhysicalFilter")
    assert cli(spark, ["--check-reachable", str(tmp_path / "bad")], "SELECT * FROM users")[0] == 1
