"""Rewrites of the syntax tree that Spark's optimizer does not make: aggregation below joins.

``eager_aggregation``: SUM and COUNT over an inner equi-join whose arguments come from one side are computed in part
below the join, by that side's group columns and the join key, and finished above it.  The shuffle for the join then
moves groups instead of rows.

``aggregate_before_join``: if the join key is a group key, the other side's key is declared unique and a foreign key
leads to it, the whole aggregation moves below the join.

Both need filters out of the way; ``push_filters`` moves conjuncts down to the side they speak of (Catalyst would do the
same later, but must not be waited for)."""

from __future__ import annotations

from ..frontend import ast as A
from ..sources.catalog import Catalog

ALL = ("eager_aggregation", "aggregate_before_join")
#: Eager aggregation pays only where groups are few against rows, which is not known here, so it is asked for by name.
DEFAULT = ("aggregate_before_join",)


def visible_columns(op: A.Op, catalog: Catalog) -> list[A.Attr]:
    """Output attributes of an operator, in order; unnamed expressions have an empty name."""
    match op:
        case A.Table():
            return [A.Attr(op.visible, c) for c in catalog.columns(op.name)]
        case A.Derived(s, alias):
            return [A.Attr(alias, c.name) for c in visible_columns(s, catalog)]
        case A.Filter(s, _):
            return visible_columns(s, catalog)
        case A.Project(s, exprs, aliases):
            out = []
            for e, a in zip(exprs, aliases, strict=True):
                if isinstance(e, A.Star):
                    out += [c for c in visible_columns(s, catalog) if not e.table or c.table == e.table]
                else:
                    out.append(A.Attr("", a) if a else e if isinstance(e, A.Attr) else A.Attr("", ""))
            return out
        case A.Aggregate(_, groups, _, names):
            return [g if isinstance(g, A.Attr) else A.Attr("", f"__group{k}") for k, g in enumerate(groups)] + [A.Attr("", n) for n in names]
        case A.Cross(a, b) | A.Join(_, a, b, _):
            return visible_columns(a, catalog) + visible_columns(b, catalog)
    return []


def covers(columns: list[A.Attr], e: A.Expr) -> bool:
    """Whether every attribute of ``e`` is one of ``columns`` (an unqualified one may match by name)."""
    return all(any(c.name == a.name and a.table in ("", c.table) for c in columns) for a in A.attrs(e))


def push_filters(op: A.Op, catalog: Catalog) -> A.Op:
    """Conjuncts of filters over inner and cross joins go to the side that has their columns, others into the join."""
    op = A.with_inputs(op, tuple(push_filters(x, catalog) for x in A.inputs(op)))
    if not isinstance(op, A.Filter):
        return op
    parts, source = A.conjuncts(op.pred), op.source
    while isinstance(source, A.Filter):
        parts, source = A.conjuncts(source.pred) + parts, source.source
    if not (isinstance(source, A.Cross) or isinstance(source, A.Join) and source.kind == "inner"):
        return A.Filter(source, A.conjoin(parts))
    left, right, both = [], [], A.conjuncts(source.cond) if isinstance(source, A.Join) else []
    lc, rc = visible_columns(source.left, catalog), visible_columns(source.right, catalog)
    for p in parts:
        in_left, in_right = covers(lc, p), covers(rc, p)
        (left if in_left and not in_right else right if in_right and not in_left else both).append(p)
    a = push_filters(A.Filter(source.left, A.conjoin(left)), catalog) if left else source.left
    b = push_filters(A.Filter(source.right, A.conjoin(right)), catalog) if right else source.right
    return A.Join("inner", a, b, A.conjoin(both)) if both else A.Cross(a, b)


def _single_equality(join: A.Join, catalog: Catalog) -> tuple[A.Attr, A.Attr] | None:
    """Left and right key of a join on exactly one equality of columns."""
    c = join.cond
    if join.kind != "inner" or not (isinstance(c, A.Bin) and c.op == "=" and isinstance(c.left, A.Attr) and isinstance(c.right, A.Attr)):
        return None
    lc, rc = visible_columns(join.left, catalog), visible_columns(join.right, catalog)
    for a, b in ((c.left, c.right), (c.right, c.left)):
        if covers(lc, a) and covers(rc, b) and not covers(rc, a) and not covers(lc, b):
            return a, b
    return None


def _sides(agg: A.Aggregate, catalog: Catalog):
    """(side with the arguments, other side, its key, the other's key, rebuild) for both ways round."""
    join = agg.source
    if not isinstance(join, A.Join) or not (keys := _single_equality(join, catalog)):
        return
    yield join.left, join.right, *keys, lambda x: A.Join("inner", x, join.right, join.cond)
    yield join.right, join.left, *keys[::-1], lambda x: A.Join("inner", join.left, x, join.cond)


def eager_aggregation(agg: A.Aggregate, catalog: Catalog) -> A.Aggregate | None:
    if not agg.aggs or not all(isinstance(g, A.Attr) for g in agg.groups):
        return None
    for side, _, key, _, rejoin in _sides(agg, catalog):
        cols = visible_columns(side, catalog)
        if not all(covers(cols, a.arg) for a in agg.aggs if a.arg is not None):
            continue
        own = tuple(dict.fromkeys([g for g in agg.groups if covers(cols, g)] + [key]))
        partial = tuple(f"__part_{n}" for n in agg.names)
        below = A.Aggregate(side, own, agg.aggs, partial)
        above = tuple(A.Agg("SUM0" if a.fn in ("COUNT", "SUM0") else "SUM", A.Attr("", p)) for a, p in zip(agg.aggs, partial, strict=True))
        return A.Aggregate(rejoin(below), agg.groups, above, agg.names)
    return None


def base_column(op: A.Op, a: A.Attr) -> tuple[str, str] | None:
    """Stored table and column behind an attribute, through filters, joins and aggregations."""
    for t in A.scans(op):
        if t.visible == a.table:
            return t.name, a.name
    return None


def _keeps_unique(op: A.Op) -> bool:
    """Whether the operator gives each row of its table at most once."""
    while isinstance(op, A.Filter):
        op = op.source
    return isinstance(op, A.Table)


def aggregate_before_join(agg: A.Aggregate, catalog: Catalog) -> A.Join | None:
    if not all(isinstance(g, A.Attr) for g in agg.groups):
        return None
    for side, other, key, other_key, rejoin in _sides(agg, catalog):
        cols = visible_columns(side, catalog)
        here, there = base_column(side, key), base_column(other, other_key)
        if key not in agg.groups or here is None or there is None or not _keeps_unique(other):
            continue
        if not catalog.is_unique(*there) or not catalog.has_foreign_key(*here, *there):
            continue
        if all(covers(cols, x) for x in [*agg.groups, *[a.arg for a in agg.aggs if a.arg is not None]]):
            return rejoin(A.Aggregate(side, agg.groups, agg.aggs, agg.names))
    return None


def apply_rewrites(op: A.Op, catalog: Catalog, names: tuple[str, ...] = ALL) -> tuple[A.Op, dict[str, int]]:
    """The rewritten tree and how often each rewrite was used.  Output columns stay what they were: a rewrite that
    leaves more of them is kept below a projection only."""
    used: dict[str, int] = {}
    if not names:
        return op, used

    def visit(o: A.Op, projected: bool) -> A.Op:
        if isinstance(o, A.Aggregate):
            pushed = A.Aggregate(push_filters(o.source, catalog), o.groups, o.aggs, o.names)
            for name, rule in (("aggregate_before_join", aggregate_before_join), ("eager_aggregation", eager_aggregation)):
                if name in names and (projected or name == "eager_aggregation") and (new := rule(pushed, catalog)) is not None:
                    used[name] = used.get(name, 0) + 1
                    return new
        return A.with_inputs(o, tuple(visit(x, isinstance(o, A.Project)) for x in A.inputs(o)))

    return visit(op, False), used
