"""Physical plans as values: s-expressions both ways, Graphviz, and execution with the strategies they name."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import NotSupported, SyntaxProblem
from ..frontend import ast as A
from ..operators.compile import Compiler, Rel
from ..sources.catalog import Catalog

# Node names of the plan format.
KINDS = ("SeqScan", "IndexSeek", "PhysicalFilter", "PhysicalProjection", "NestedLoopCrossJoin", "NestedLoopJoin", "HashJoin", "MergeJoin", "Sort", "HashAggregate", "StreamAggregate", "PartialAggregate", "FinalAggregate")
JOINS = ("NestedLoopJoin", "HashJoin", "MergeJoin")
AGGREGATES = ("HashAggregate", "StreamAggregate", "PartialAggregate", "FinalAggregate")
_HINT = {"HashJoin": "shuffle_hash", "MergeJoin": "merge", "NestedLoopJoin": None}


@dataclass(frozen=True)
class Node:
    """One operator.  ``args`` by kind: scan (table, alias); seek (predicate, table, alias); filter (predicate,);
    projection (expressions, aliases); join (type, condition); sort (keys,); aggregate (groups, aggregates, names)."""

    kind: str
    args: tuple = ()
    inputs: tuple[Node, ...] = ()
    rows: int | None = None
    cost: int | None = None

    def bare(self) -> Node:
        """Without estimates, for comparison."""
        return Node(self.kind, self.args, tuple(x.bare() for x in self.inputs))

    def size(self) -> int:
        return 1 + sum(x.size() for x in self.inputs)


# --- s-expressions ------------------------------------------------------------------------------------------------


def expr_text(e: A.Expr) -> str:
    match e:
        case A.Attr(t, n):
            return f"(attr {_word(t)} {_word(n)})"
        case A.Int(v):
            return str(v)
        case A.Str(v):
            return f"(str {_quoted(v)})"
        case A.Lit(v):
            return v
        case A.Bin(op, a, b):
            return f"({op} {expr_text(a)} {expr_text(b)})"
        case A.Un(op, x):
            return f"({ {'-': 'uminus'}.get(op, op)} {expr_text(x)})"
        case A.Is(x, what):
            return f"(is {what} {expr_text(x)})"
        case A.In(x, vs, neg):
            return f"({'notin' if neg else 'in'} {expr_text(x)} (values {' '.join(map(expr_text, vs))}))"
        case A.Agg(fn, x):
            return f"({fn} {'*' if x is None else expr_text(x)})"
    raise NotSupported(f"{A.show(e)} in a plan")


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _word(s: str) -> str:
    return s if re.fullmatch(r"[^\s()\"]+", s) else _quoted(s)


def serialize(p: Node) -> str:
    kids = "".join(" " + serialize(x) for x in p.inputs)
    match p.kind:
        case "SeqScan":
            body = " ".join(_word(x) for x in p.args if x)
        case "IndexSeek":
            body = f"{expr_text(p.args[0])} " + " ".join(_word(x) for x in p.args[1:] if x)
        case "PhysicalFilter":
            body = expr_text(p.args[0])
        case "PhysicalProjection":
            body = f"(exprs{''.join(' ' + expr_text(e) for e in p.args[0])})"
            if any(p.args[1]):
                body += f" (aliases{''.join(' ' + (_quoted(a) if a else '-') for a in p.args[1])})"
        case "NestedLoopCrossJoin":
            body = ""
        case "Sort":
            body = f"(keys{''.join(f' {_word(k.attr.table + '.' + k.attr.name if k.attr.table else k.attr.name)} {'Desc' if k.descending else 'Asc'}' for k in p.args[0])})"
        case k if k in JOINS:
            body = f"{p.args[0].capitalize()} {expr_text(p.args[1])}"
        case k if k in AGGREGATES:
            body = f"(group_by{''.join(' ' + expr_text(g) for g in p.args[0])}) (aggs{''.join(' ' + expr_text(a) for a in p.args[1])})"
        case _:
            raise NotSupported(p.kind)
    return f"({p.kind}{' ' + body if body else ''}{kids})"


_TOKEN = re.compile(r'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')


def _read(text: str):
    stack: list[list] = [[]]
    at = 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"plan: unexpected text at {at}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise SyntaxProblem("plan: too many )")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(m[4] if m[4] is not None else ("str", re.sub(r"\\(.)", r"\1", m[3])))
    if len(stack) != 1 or len(stack[0]) != 1:
        raise SyntaxProblem("plan: one expression in balanced parentheses is needed")
    return stack[0][0]


def _name(x) -> str:
    if isinstance(x, list):
        raise SyntaxProblem(f"plan: a name is needed, found {x}")
    return x[1] if isinstance(x, tuple) else x


def _expr(x) -> A.Expr:
    if isinstance(x, str):
        if re.fullmatch(r"-?\d+", x):
            return A.Int(int(x))
        if x in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
            return A.Lit(x)
        raise SyntaxProblem(f"plan: unknown expression {x}")
    match x:
        case ["str", ("str", v)]:
            return A.Str(v)
        case ["attr", t, n]:
            return A.Attr(_name(t), _name(n))
        case [("in" | "notin") as op, a, ["values", *vs]]:
            return A.In(_expr(a), tuple(map(_expr, vs)), op == "notin")
        case ["is", str(what), a]:
            return A.Is(_expr(a), what)
        case [("not" | "isnull" | "uminus") as op, a]:
            return A.Un({"uminus": "-"}.get(op, op), _expr(a))
        case [("SUM" | "COUNT" | "SUM0") as fn, a]:
            return A.Agg(fn, None if a == "*" else _expr(a))
        case [str(op), a, b] if op in (*A.COMPARISONS, *A.ARITHMETIC, "and", "or"):
            return A.Bin(op, _expr(a), _expr(b))
    raise SyntaxProblem(f"plan: unknown expression {x}")


def deserialize(text: str) -> Node:
    return _node(_read(text))


def _node(x) -> Node:
    match x:
        case ["SeqScan", t, *alias] if len(alias) < 2:
            return Node("SeqScan", (_name(t), _name(alias[0]) if alias else None))
        case ["IndexSeek", e, t, *alias] if len(alias) < 2:
            return Node("IndexSeek", (_expr(e), _name(t), _name(alias[0]) if alias else None))
        case ["PhysicalFilter", e, s]:
            return Node("PhysicalFilter", (_expr(e),), (_node(s),))
        case ["PhysicalProjection", ["exprs", *es], s]:
            return Node("PhysicalProjection", (tuple(map(_expr, es)), (None,) * len(es)), (_node(s),))
        case ["PhysicalProjection", ["exprs", *es], ["aliases", *names], s] if len(es) == len(names):
            return Node("PhysicalProjection", (tuple(map(_expr, es)), tuple(None if a == "-" else _name(a) for a in names)), (_node(s),))
        case ["NestedLoopCrossJoin", a, b]:
            return Node("NestedLoopCrossJoin", (), (_node(a), _node(b)))
        case [str(k), ("Inner" | "Left" | "Right" | "Full") as kind, e, a, b] if k in JOINS:
            return Node(k, (kind.lower(), _expr(e)), (_node(a), _node(b)))
        case ["Sort", ["keys", *ks], s] if len(ks) % 2 == 0:
            keys = []
            for col, way in zip(ks[::2], ks[1::2], strict=True):
                if way not in ("Asc", "Desc"):
                    raise SyntaxProblem(f"plan: Asc or Desc is needed, found {way}")
                table, _, name = _name(col).rpartition(".")
                keys.append(A.SortKey(A.Attr(table, name), way == "Desc"))
            return Node("Sort", (tuple(keys),), (_node(s),))
        case [str(k), ["group_by", *gs], ["aggs", *ags], s] if k in AGGREGATES:
            return Node(k, (tuple(map(_expr, gs)), tuple(map(_expr, ags)), tuple(f"__agg{i}" for i in range(len(ags)))), (_node(s),))
    raise SyntaxProblem(f"plan: unknown node {x[0] if isinstance(x, list) and x else x}")


def to_dot(p: Node) -> str:
    lines: list[str] = []

    def visit(n: Node) -> int:
        me = len(lines)
        own = serialize(replace(n, inputs=())) if n.kind != "NestedLoopCrossJoin" else "(NestedLoopCrossJoin)"
        text = own.strip("()") + (f"\\nrows={n.rows} cost={n.cost}" if n.rows is not None else "")
        lines.append(f'  n{me} [shape=box, label="{text.replace(chr(34), chr(92) + chr(34))}"];')
        for x in n.inputs:
            lines.append(f"  n{me} -> n{visit(x)};")
        return me

    visit(p)
    return "digraph plan {\n" + "\n".join(lines) + "\n}\n"


# --- execution ----------------------------------------------------------------------------------------------------


def to_query(p: Node) -> A.Query:
    """The plan as a syntax tree whose joins carry hints for the strategies that the plan names."""
    if p.kind == "Sort":
        return A.Query(_op(p.inputs[0]), p.args[0])
    return A.Query(_op(p))


def _op(p: Node) -> A.Op:
    kids = [_op(x) for x in p.inputs]
    match p.kind:
        case "SeqScan":
            return A.Table(*p.args)
        case "IndexSeek":
            return A.Filter(A.Table(*p.args[1:]), p.args[0])
        case "PhysicalFilter":
            return A.Filter(kids[0], p.args[0])
        case "PhysicalProjection":
            return A.Project(kids[0], *p.args)
        case "NestedLoopCrossJoin":
            return A.Cross(*kids)
        case "Sort":
            return kids[0]  # below the top, order is Spark's affair
        case k if k in JOINS:
            return A.Join(p.args[0], kids[0], kids[1], p.args[1], _HINT[k])
    return A.Aggregate(kids[0], *p.args)


def from_plan(p: Node, catalog: Catalog) -> Rel:
    return Compiler(catalog).query(to_query(p))
