import pytest

from starql.errors import ConversionError, NotSupported, SyntaxProblem
from starql.frontend import ast as A
from starql.frontend.parser import parse


def where(text: str) -> str:
    return A.show(parse(f"SELECT t.a FROM t WHERE {text}").op.source.pred)


@pytest.mark.parametrize(
    "text, shown",
    [
        ("t.a + 2 * 3 = 7", "((t.a + (2 * 3)) = 7)"),
        ("-2 ^ 2 = 4", "(((- 2) ^ 2) = 4)"),
        ("NOT t.a IN (1) AND t.b OR t.c", "(((NOT (t.a IN (1))) AND t.b) OR t.c)"),
        ("t.a NOT BETWEEN 1 AND 3", "(NOT ((t.a >= 1) AND (t.a <= 3)))"),
        ("t.a ISNULL OR t.b NOTNULL", "((t.a IS NULL) OR (NOT (t.b IS NULL)))"),
        ("t.a != 1 AND t.b <> 2", "((t.a <> 1) AND (t.b <> 2))"),
        ("(t.a = 1) IS NOT UNKNOWN", "(NOT ((t.a = 1) IS UNKNOWN))"),
        ("t.s = 'it''s' /* c */ -- end", "(t.s = 'it''s')"),
        ("t.a NOT IN (1, NULL)", "(t.a NOT IN (1, NULL))"),
    ],
)
def test_expressions(text, shown):
    assert where(text) == shown


def test_tree_and_rendering():
    q = parse("SELECT a.x AS k, SUM(b.y) - SUM(b.z) d FROM a LEFT JOIN b ON a.x = b.x, c WHERE a.x > 1 GROUP BY a.x ORDER BY a.x DESC, d;")
    assert A.to_sexpr(q.op) == (
        "(Projection a.x AS k (__agg0 - __agg1) AS d (Aggregation (GroupBy a.x) (Aggregates SUM(b.y) SUM(b.z)) "
        "(Filter (a.x > 1) (CrossJoin (Join Left (a.x = b.x) (Table a) (Table b)) (Table c)))))"
    )
    assert [(A.show(k.attr), k.descending) for k in q.order] == [("a.x", True), ("d", False)]
    dot = A.to_dot(q.op)
    assert dot.startswith("digraph") and dot.count("->") == 7


def test_star_nesting_and_empty():
    assert parse("SELECT * FROM t").op == A.Table("t")
    assert parse("((SELECT * FROM t AS u))").op == A.Table("t", "u")
    assert parse("SELECT * FROM (a JOIN b ON a.x = b.x) CROSS JOIN c").op == A.Cross(A.Join("inner", A.Table("a"), A.Table("b"), A.Bin("=", A.Attr("a", "x"), A.Attr("b", "x"))), A.Table("c"))
    assert parse("").op == A.Empty() and parse(";").op == A.Empty()


@pytest.mark.parametrize(
    "sql",
    """SELECT DISTINCT a FROM t|SELECT a FROM t HAVING a > 1|SELECT a FROM t LIMIT 3|SELECT a FROM t OFFSET 1|SELECT a FROM t FETCH FIRST 1 ROW ONLY
    |SELECT a FROM t UNION SELECT b FROM u|SELECT a FROM t EXCEPT SELECT a FROM u|SELECT a FROM t INTERSECT SELECT a FROM u|WITH x AS (SELECT 1) SELECT * FROM x
    |SELECT a FROM t; SELECT b FROM t|INSERT INTO t VALUES (1)|VALUES (1)|SELECT SUM(a) OVER (PARTITION BY b) FROM t|SELECT COUNT(DISTINCT a) FROM t|SELECT SUM(*) FROM t
    |SELECT SUM(SUM(a)) FROM t|SELECT upper(a) FROM t|SELECT CASE WHEN a THEN 1 END FROM t|SELECT CAST(a AS int) FROM t|SELECT a::int FROM t|SELECT 1.5 FROM t|SELECT 0x1F FROM t
    |SELECT a FROM t WHERE a LIKE 'x'|SELECT a FROM t WHERE a IN (SELECT b FROM u)|SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u)|SELECT a FROM t WHERE a = ANY (SELECT 1)
    |SELECT a FROM t NATURAL JOIN u|SELECT a FROM t JOIN u USING (a)|SELECT a FROM s.t|SELECT a FROM f(1)|SELECT a FROM LATERAL (SELECT 1) x|SELECT a FROM t TABLESAMPLE system (1)
    |SELECT a FROM t GROUP BY ROLLUP (a)|SELECT a FROM t GROUP BY 1|SELECT a FROM t ORDER BY 1|SELECT a FROM t ORDER BY a + 1|SELECT a FROM t ORDER BY a NULLS FIRST
    |SELECT a FROM t WHERE a BETWEEN SYMMETRIC 1 AND 2|SELECT a FROM t WHERE a IS DISTINCT FROM 2|SELECT a << 2 FROM t|SELECT a FROM t x (b)|SELECT E'x' FROM t|SELECT (SELECT 1) FROM t
    |SELECT a FROM t FOR UPDATE|SELECT SUM(a) FILTER (WHERE a > 1) FROM t|SELECT a FROM t WINDOW w AS ()|SELECT a FROM t WHERE SUM(a) > 1|SELECT (1, 2) FROM t""".replace("\n", "").split("|"),
)
def test_refused_by_name(sql):
    with pytest.raises(NotSupported):
        parse(sql.strip())


@pytest.mark.parametrize("sql", ["SELEC a", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t WHERE a = 1 = 2", "SELECT (a FROM t", "SELECT a FROM t JOIN u", "SELECT 'a FROM t", "SELECT a b c FROM t"])
def test_syntax_errors(sql):
    with pytest.raises(SyntaxProblem):
        parse(sql)


def test_integers():
    assert where("t.a = 9223372036854775807").endswith("9223372036854775807)")
    assert where("t.a = -9223372036854775808").endswith("-9223372036854775808)")
    with pytest.raises(ConversionError):
        parse("SELECT 9223372036854775808")
