import pytest

from starql.errors import NotSupported, SyntaxProblem
from starql.frontend.parser import parse
from starql.plans.physical import serialize
from starql.plans.search import reach
from starql.plans.showplan import NAMESPACE, from_showplan
from starql.sources import Catalog


def column(table, name, alias=""):
    return f'<ColumnReference Table="[{table}]" Column="{name}"' + (f' Alias="[{alias}]"' if alias else "") + "/>"


def value(table, name):
    return f"<ScalarOperator><Identifier>{column(table, name)}</Identifier></ScalarOperator>"


def const(text):
    return f'<ScalarOperator><Const ConstValue="{text}"/></ScalarOperator>'


def compare(op, a, b):
    return f'<ScalarOperator><Compare CompareOp="{op}">{a}{b}</Compare></ScalarOperator>'


def rel(physical, body, logical=""):
    return f'<RelOp PhysicalOp="{physical}" LogicalOp="{logical}">{body}</RelOp>'


def scan(table, pred="", alias=""):
    own = f'<Object Table="[{table}]"' + (f' Alias="[{alias}]"' if alias else "") + "/>"
    return rel("Table Scan", f"<TableScan>{own}{f'<Predicate>{pred}</Predicate>' if pred else ''}</TableScan>")


def plan(body):
    return f'<ShowPlanXML xmlns="{NAMESPACE[1:-1]}"><BatchSequence>{body}</BatchSequence></ShowPlanXML>'


SEEK = f'<IndexScan><SeekPredicates><SeekPredicateNew><SeekKeys><StartRange ScanType="GE"><RangeColumns>{column("t", "id")}</RangeColumns><RangeExpressions>{const("(5)")}</RangeExpressions></StartRange><EndRange ScanType="LT"><RangeColumns>{column("t", "id")}</RangeColumns><RangeExpressions>{const("(9)")}</RangeExpressions></EndRange></SeekKeys></SeekPredicateNew></SeekPredicates><Object Table="[t]"/></IndexScan>'
GROUPED = f'<GroupBy>{column("t", "k")}</GroupBy><DefinedValues><DefinedValue><ScalarOperator><Aggregate AggType="countstar"/></ScalarOperator></DefinedValue><DefinedValue><ScalarOperator><Aggregate AggType="SUM">{value("t", "v")}</Aggregate></ScalarOperator></DefinedValue></DefinedValues>'
ORDER = f'<OrderBy><OrderByColumn Ascending="false">{column("t", "k")}</OrderByColumn></OrderBy>'
CASES = [
    (scan("t"), "(SeqScan t)"),
    (scan("t", compare("GT", value("u", "v"), const("(3)")), "u"), "(PhysicalFilter (> (attr u v) 3) (SeqScan t u))"),
    (scan("t", compare("EQ", value("t", "s"), const("N'it''s'"))), '(PhysicalFilter (= (attr t s) (str "it\'s")) (SeqScan t))'),
    (scan("t", compare("IS NOT", value("t", "v"), const("NULL"))), "(PhysicalFilter (not (isnull (attr t v))) (SeqScan t))"),
    (rel("Clustered Index Seek", SEEK), "(IndexSeek (and (>= (attr t id) 5) (< (attr t id) 9)) t)"),
    (rel("Sort", f"<Sort>{ORDER}{scan('t')}</Sort>"), "(Sort (keys t.k Desc) (SeqScan t))"),
    (rel("Compute Scalar", f"<ComputeScalar>{scan('t')}</ComputeScalar>"), "(SeqScan t)"),
    (rel("Stream Aggregate", f"<StreamAggregate>{GROUPED}{rel('Sort', f'<Sort>{ORDER}{scan("t")}</Sort>')}</StreamAggregate>", "Aggregate"), "(HashAggregate (group_by (attr t k)) (aggs (COUNT *) (SUM (attr t v))) (SeqScan t))"),
    (rel("Hash Match", f"<Hash><HashKeysBuild>{column('a', 'x')}</HashKeysBuild><HashKeysProbe>{column('b', 'x')}</HashKeysProbe>{scan('a')}{scan('b')}</Hash>", "Left Outer Join"), "(HashJoin Left (= (attr a x) (attr b x)) (SeqScan a) (SeqScan b))"),
    (rel("Merge Join", f"<Merge><Residual>{compare('EQ', value('a', 'x'), value('b', 'x'))}</Residual>{scan('a')}{scan('b')}</Merge>", "Full Outer Join"), "(MergeJoin Full (= (attr a x) (attr b x)) (SeqScan a) (SeqScan b))"),
    (rel("Nested Loops", f"<NestedLoops>{scan('a')}{scan('b')}</NestedLoops>", "Inner Join"), "(NestedLoopCrossJoin (SeqScan a) (SeqScan b))"),
    (rel("Nested Loops", f"<NestedLoops><Predicate>{compare('LT', value('a', 'x'), value('b', 'x'))}</Predicate>{scan('a')}{scan('b')}</NestedLoops>", "Inner Join"), "(NestedLoopJoin Inner (< (attr a x) (attr b x)) (SeqScan a) (SeqScan b))"),
    (scan("t", f'<ScalarOperator><Logical Operation="OR">{compare("EQ", value("t", "a"), const("(1)"))}{compare("EQ", value("t", "a"), const("(2)"))}{compare("EQ", value("t", "a"), const("(3)"))}</Logical></ScalarOperator>'), "(PhysicalFilter (or (or (= (attr t a) 1) (= (attr t a) 2)) (= (attr t a) 3)) (SeqScan t))"),
]


@pytest.mark.parametrize("xml, text", CASES)
def test_operators(xml, text):
    assert serialize(from_showplan(plan(xml))) == text


@pytest.mark.parametrize(
    "xml, error",
    [
        ("<a", SyntaxProblem),
        (plan(""), SyntaxProblem),
        (plan(rel("Parallelism", "")), NotSupported),
        (plan(rel("Merge Join", f"<Merge>{scan('a')}{scan('b')}</Merge>", "Inner Join")), NotSupported),
        (plan(rel("Nested Loops", f"<NestedLoops><OuterReferences>{column('a', 'x')}</OuterReferences>{scan('a')}{rel('Index Seek', SEEK)}</NestedLoops>", "Inner Join")), NotSupported),
        (plan(scan("t", compare("GT", value("t", "v"), f'<ScalarOperator><Identifier><ColumnReference Column="@p"/></Identifier></ScalarOperator>'))), NotSupported),
        (plan(rel("Hash Match", f"<Hash>{scan('a')}{scan('b')}</Hash>", "Inner Join")), SyntaxProblem),
    ],
)
def test_refusals(xml, error):
    with pytest.raises(error):
        from_showplan(xml)


def test_a_converted_plan_can_be_reached():
    cat = Catalog(None)
    cat._schemas = {"users": ["id", "age"]}
    target = from_showplan(plan(scan("users", compare("GT", value("users", "age"), const("(3)")))))
    assert reach(target, parse("SELECT * FROM users WHERE 3 < users.age"), cat).reachable
