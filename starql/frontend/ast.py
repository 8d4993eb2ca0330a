"""Abstract syntax: scalar expressions and relational operators, as immutable values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

# --- scalar expressions -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Attr:
    table: str
    name: str


@dataclass(frozen=True)
class Int:
    value: int


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Lit:
    """TRUE, FALSE, NULL or UNKNOWN."""

    value: str


@dataclass(frozen=True)
class Bin:
    """``op`` is one of = != < <= > >= and or + - * / % ^."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un:
    """``op`` is one of not, -, isnull."""

    op: str
    arg: Expr


@dataclass(frozen=True)
class Is:
    """``arg IS what`` with what TRUE, FALSE or UNKNOWN; never NULL."""

    arg: Expr
    what: str


@dataclass(frozen=True)
class In:
    arg: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    """SUM, COUNT, or SUM0 (SUM that is 0 where SUM would be NULL; made by rewrites only).  ``arg`` None: COUNT(*)."""

    fn: str
    arg: Expr | None


@dataclass(frozen=True)
class Star:
    table: str = ""


Expr = Attr | Int | Str | Lit | Bin | Un | Is | In | Agg | Star

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
ARITHMETIC = ("+", "-", "*", "/", "%", "^")
MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Bin(_, a, b):
            return a, b
        case Un(_, a) | Is(a, _):
            return (a,)
        case In(a, vs, _):
            return a, *vs
        case Agg(_, a):
            return (a,) if a is not None else ()
    return ()


def rebuild(e: Expr, parts: tuple[Expr, ...]) -> Expr:
    match e:
        case Bin(op, _, _):
            return Bin(op, *parts)
        case Un() | Is() | Agg() if parts:
            return replace(e, arg=parts[0])
        case In():
            return replace(e, arg=parts[0], values=parts[1:])
    return e


def transform(e: Expr, f: Callable[[Expr], Expr | None]) -> Expr:
    """Top-down: where ``f`` gives an expression it takes the place of the node, else the node's parts are visited."""
    got = f(e)
    if got is not None:
        return got
    return rebuild(e, tuple(transform(c, f) for c in children(e)))


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def attrs(e: Expr) -> set[Attr]:
    return {x for x in walk(e) if isinstance(x, Attr)}


def conjuncts(e: Expr) -> list[Expr]:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Bin) and e.op == "and" else [e]


def conjoin(parts: list[Expr]) -> Expr:
    out = parts[0]
    for p in parts[1:]:
        out = Bin("and", out, p)
    return out


# --- relational operators -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Empty:
    """One row without columns: a query without FROM."""


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def visible(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Derived:
    """A derived table under an alias."""

    source: Op
    alias: str


@dataclass(frozen=True)
class Filter:
    source: Op
    pred: Expr


@dataclass(frozen=True)
class Project:
    source: Op
    exprs: tuple[Expr, ...]
    aliases: tuple[str | None, ...]


@dataclass(frozen=True)
class Aggregate:
    """Outputs the group expressions (attributes keep their names) and, for each aggregate, ``names``."""

    source: Op
    groups: tuple[Expr, ...]
    aggs: tuple[Agg, ...]
    names: tuple[str, ...]


@dataclass(frozen=True)
class Cross:
    left: Op
    right: Op


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full; hint: a Spark join hint
    left: Op
    right: Op
    cond: Expr
    hint: str | None = None


Op = Empty | Table | Derived | Filter | Project | Aggregate | Cross | Join


@dataclass(frozen=True)
class SortKey:
    attr: Attr
    descending: bool = False


@dataclass(frozen=True)
class Query:
    op: Op
    order: tuple[SortKey, ...] = ()


def inputs(op: Op) -> tuple[Op, ...]:
    match op:
        case Cross(a, b) | Join(_, a, b):
            return a, b
        case Filter() | Project() | Aggregate() | Derived():
            return (op.source,)
    return ()


def with_inputs(op: Op, new: tuple[Op, ...]) -> Op:
    match op:
        case Cross() | Join():
            return replace(op, left=new[0], right=new[1])
        case Filter() | Project() | Aggregate() | Derived():
            return replace(op, source=new[0])
    return op


def scans(op: Op) -> Iterator[Table]:
    if isinstance(op, Table):
        yield op
    for x in inputs(op):
        yield from scans(x)


# --- rendering ----------------------------------------------------------------------------------------------------

_SQL_OP = {"and": "AND", "or": "OR", "not": "NOT", "!=": "<>"}


def show(e: Expr) -> str:
    """Infix text of an expression, fully parenthesised."""
    match e:
        case Attr("", n):
            return n
        case Attr(t, n):
            return f"{t}.{n}"
        case Int(v):
            return str(v)
        case Str(v):
            return "'" + v.replace("'", "''") + "'"
        case Lit(v):
            return v
        case Bin(op, a, b):
            return f"({show(a)} {_SQL_OP.get(op, op)} {show(b)})"
        case Un("isnull", a):
            return f"({show(a)} IS NULL)"
        case Un(op, a):
            return f"({_SQL_OP.get(op, op)} {show(a)})"
        case Is(a, w):
            return f"({show(a)} IS {w})"
        case In(a, vs, neg):
            return f"({show(a)} {'NOT ' * neg}IN ({', '.join(map(show, vs))}))"
        case Agg(fn, a):
            return f"{fn}({'*' if a is None else show(a)})"
        case Star(t):
            return f"{t}.*" if t else "*"
    raise TypeError(e)


def to_sexpr(op: Op) -> str:
    """The operator tree as an s-expression."""
    match op:
        case Empty():
            return "(Empty)"
        case Table(n, None):
            return f"(Table {n})"
        case Table(n, a):
            return f"(Table {n} AS {a})"
        case Derived(s, a):
            return f"(Derived {a} {to_sexpr(s)})"
        case Filter(s, p):
            return f"(Filter {show(p)} {to_sexpr(s)})"
        case Project(s, es, als):
            body = " ".join(show(e) + (f" AS {a}" if a else "") for e, a in zip(es, als, strict=True))
            return f"(Projection {body} {to_sexpr(s)})"
        case Aggregate(s, gs, ags, _):
            return f"(Aggregation (GroupBy{''.join(' ' + show(g) for g in gs)}) (Aggregates{''.join(' ' + show(a) for a in ags)}) {to_sexpr(s)})"
        case Cross(a, b):
            return f"(CrossJoin {to_sexpr(a)} {to_sexpr(b)})"
        case Join(k, a, b, c):
            return f"(Join {k.capitalize()} {show(c)} {to_sexpr(a)} {to_sexpr(b)})"
    raise TypeError(op)


def to_dot(op: Op) -> str:
    """The operator tree as a Graphviz digraph."""
    lines: list[str] = []

    def label(o: Op) -> str:
        match o:
            case Empty():
                return "empty"
            case Table(n, a):
                return n if a is None else f"{n} AS {a}"
            case Derived(_, a):
                return f"AS {a}"
            case Filter(_, p):
                return f"σ {show(p)}"
            case Project(_, es, als):
                return "π " + ", ".join(show(e) + (f" AS {a}" if a else "") for e, a in zip(es, als, strict=True))
            case Aggregate(_, gs, ags, _):
                return f"γ {', '.join(map(show, gs))}; {', '.join(map(show, ags))}"
            case Cross():
                return "×"
            case Join(k, _, _, c):
                return f"{k} ⋈ {show(c)}"
        raise TypeError(o)

    def visit(o: Op) -> int:
        me = len(lines)
        text = label(o).replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  n{me} [label="{text}"];')
        for x in inputs(o):
            lines.append(f"  n{me} -> n{visit(x)};")
        return me

    visit(op)
    return "digraph query {\n" + "\n".join(lines) + "\n}\n"
