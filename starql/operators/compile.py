"""Syntax trees to DataFrames.

Every column gets a unique internal name when it is scanned or made, so no reference is ambiguous whatever is joined;
visible names come back in the top projection.  Only the DataFrame and Column API are used: Catalyst prunes columns,
pushes filters into scans and chooses join strategies."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NameProblem, TypeMismatch
from ..frontend import ast as A
from ..functions.scalar import BOOL, INT, NULL, OTHER, compile_agg, compile_expr, type_of
from ..sources.catalog import Catalog
from ..sources.sizes import can_broadcast


@dataclass(frozen=True)
class Col:
    """A visible column: qualifier, name, type, and the internal name it has in the DataFrame."""

    table: str
    name: str
    type: str
    ref: str


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    cols: tuple[Col, ...]

    def find(self, a: A.Attr) -> Col:
        for same in (lambda x, y: x == y, lambda x, y: x.lower() == y.lower()):
            hits = [c for c in self.cols if same(c.name, a.name) and (not a.table or same(c.table, a.table))]
            exact = [c for c in hits if c.table == a.table]
            if len(exact) == 1:
                return exact[0]
            if len(hits) == 1:
                return hits[0]
            if hits:
                raise NameProblem(f"ambiguous: {A.show(a)}")
        raise NameProblem(f"no such attribute: {A.show(a)}")

    def resolve(self, a: A.Attr) -> tuple[str, Column]:
        c = self.find(a)
        return c.type, F.col(c.ref)


JOIN_HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")


class Compiler:
    def __init__(self, catalog: Catalog, join_hint: str | None = None):
        if join_hint is not None and join_hint not in JOIN_HINTS:
            raise ValueError(f"join_hint: one of {', '.join(JOIN_HINTS)}")
        self.catalog, self.hint, self.serial = catalog, join_hint, count()
        self.wanted: dict[int, set[str] | None] = {}

    def fresh(self, name: str) -> str:
        return f"_{next(self.serial)}_" + "".join(ch if ch.isalnum() else "_" for ch in name)

    def rel(self, op: A.Op) -> Rel:
        match op:
            case A.Empty():
                return Rel(self.catalog.spark.range(1).select(), ())
            case A.Table():
                return self.scan(op)
            case A.Derived(source, alias):
                inner = self.rel(source)
                return Rel(inner.df, tuple(Col(alias, c.name, c.type, c.ref) for c in inner.cols))
            case A.Filter(source, pred):
                inner = self.rel(source)
                return Rel(inner.df.where(self.predicate(pred, inner)), inner.cols)
            case A.Project():
                return self.project(op, self.rel(op.source), ())[0]
            case A.Aggregate():
                return self.aggregate(op)
            case A.Cross(left, right):
                a, b = self.rel(left), self.rel(right)
                return Rel(a.df.crossJoin(b.df), a.cols + b.cols)
            case A.Join(kind, left, right, cond, own):
                a, b = self.rel(left), self.rel(right)
                both = Rel(a.df, a.cols + b.cols)
                hint = own or self.hint
                if hint == "broadcast" and not can_broadcast(b.df):
                    hint = "merge"  # without a hint, Catalyst might broadcast it by its estimate
                other = b.df.hint(hint) if hint else b.df
                return Rel(a.df.join(other, self.predicate(cond, both), kind), both.cols)
        raise TypeError(op)

    def scan(self, t: A.Table) -> Rel:
        df, wanted = self.catalog.table(t.name), self.wanted.get(id(t))
        fields = [f for f in df.schema.fields if wanted is None or f.name.lower() in wanted]
        cols = tuple(Col(t.visible, f.name, type_of(f.dataType), self.fresh(f.name)) for f in fields)
        picked = [(F.col(f"`{c.name}`").cast("long") if c.type == INT else F.col(f"`{c.name}`")).alias(c.ref) for c in cols]
        return Rel(df.select(*picked), cols)

    @staticmethod
    def predicate(e: A.Expr, rel: Rel) -> Column:
        t, c = compile_expr(e, rel.resolve)
        if t not in (BOOL, NULL):
            raise TypeMismatch(f"{A.show(e)}: expected bool, found {t}")
        return c

    def project(self, op: A.Project, source: Rel, extra: tuple[Col, ...]) -> tuple[Rel, tuple[Col, ...]]:
        """The projection, and the columns of ``extra`` carried along for sorting."""
        cols, made = [], []
        for e, alias in zip(op.exprs, op.aliases, strict=True):
            if isinstance(e, A.Star):
                own = [c for c in source.cols if not e.table or c.table == e.table]
                if e.table and not own:
                    raise NameProblem(f"no such table: {e.table}")
                cols += own
                made += [F.col(c.ref) for c in own]
                continue
            if isinstance(e, A.Attr):
                c = source.find(e)
                visible = Col("" if alias else c.table, alias or c.name, c.type, self.fresh(alias or c.name))
                made.append(F.col(c.ref).alias(visible.ref))
            else:
                t, col = compile_expr(e, source.resolve)
                visible = Col("", alias or "", t, self.fresh(alias or "expr"))
                made.append(col.alias(visible.ref))
            cols.append(visible)
        have = {c.ref for c in cols}
        carried = [F.col(c.ref) for c in extra if c.ref not in have]
        return Rel(source.df.select(*made, *carried), tuple(cols)), extra

    def aggregate(self, op: A.Aggregate) -> Rel:
        source = self.rel(op.source)
        groups, cols = [], []
        for k, g in enumerate(op.groups):
            t, c = compile_expr(g, source.resolve)
            base = source.find(g) if isinstance(g, A.Attr) else None
            visible = Col(base.table if base else "", base.name if base else f"__group{k}", t, self.fresh(base.name if base else "group"))
            groups.append(c.alias(visible.ref))
            cols.append(visible)
        made = []
        for a, name in zip(op.aggs, op.names, strict=True):
            t, c = compile_agg(a, source.resolve)
            visible = Col("", name, t, self.fresh(name))
            made.append(c.alias(visible.ref))
            cols.append(visible)
        if not made:
            return Rel(source.df.select(*groups).distinct(), tuple(cols))
        return Rel(source.df.groupBy(*groups).agg(*made) if groups else source.df.agg(*made), tuple(cols))

    def query(self, q: A.Query) -> Rel:
        """The relation in the order asked for; sort keys may be output aliases or columns below the projection."""
        op = q.op
        self.wanted = wanted_columns(op, {k.attr.name.lower() for k in q.order})
        if not q.order:
            return self.rel(op)
        if not isinstance(op, A.Project):
            rel = self.rel(op)
            return Rel(rel.df.orderBy(*[_sort(F.col(rel.find(k.attr).ref), k) for k in q.order]), rel.cols)
        source = self.rel(op.source)
        names = {(a or "") for a in op.aliases}
        hidden: list[Col] = []
        plan: list[tuple[bool, A.SortKey]] = []
        for k in q.order:
            visible = not k.attr.table and k.attr.name in names
            plan.append((visible, k))
            if not visible:
                hidden.append(source.find(k.attr))
        rel, carried = self.project(op, source, tuple(dict.fromkeys(hidden)))
        below = iter(hidden)
        keys = [_sort(F.col(rel.find(k.attr).ref if visible else next(below).ref), k) for visible, k in plan]
        return Rel(rel.df.orderBy(*keys).select(*[c.ref for c in rel.cols]), rel.cols)


def wanted_columns(op: A.Op, always: set[str]) -> dict[int, set[str] | None]:
    """For each scan, the names its columns must have to be of use (None: all).  Catalyst would drop the others too;
    leaving them out keeps the plans that it has to analyse small."""
    out: dict[int, set[str] | None] = {}

    def names(*exprs: A.Expr) -> set[str]:
        return {a.name.lower() for e in exprs for a in A.attrs(e)} | always

    def visit(o: A.Op, need: set[str] | None) -> None:
        match o:
            case A.Table():
                out[id(o)] = None if need is None or out.get(id(o), need) is None else need | out.get(id(o), set())
                return
            case A.Project(_, exprs, _):
                need = None if any(isinstance(e, A.Star) for e in exprs) else names(*exprs)
            case A.Aggregate(_, groups, aggs, _):
                need = names(*groups, *aggs)
            case A.Filter(_, e) | A.Join(_, _, _, e):
                need = None if need is None else need | names(e)
        for x in A.inputs(o):
            visit(x, need)

    visit(op, None)
    return out


def _sort(c: Column, k: A.SortKey) -> Column:
    """NULLs come last in either direction."""
    return c.desc_nulls_last() if k.descending else c.asc_nulls_last()


def rewrite_group_exprs(op: A.Op) -> A.Op:
    """References to group expressions in the select list become references to the aggregate's output; any other
    column there is an error."""
    op = A.with_inputs(op, tuple(rewrite_group_exprs(x) for x in A.inputs(op)))
    if isinstance(op, A.Project) and isinstance(op.source, A.Aggregate):
        agg = op.source
        place: dict[A.Expr, A.Expr] = {g: (g if isinstance(g, A.Attr) else A.Attr("", f"__group{k}")) for k, g in enumerate(agg.groups)}
        made = set(agg.names)
        by_name = {g.name for g in agg.groups if isinstance(g, A.Attr)}

        def swap(e: A.Expr) -> A.Expr | None:
            if e in place:
                return place[e]
            if isinstance(e, A.Attr) and not (not e.table and e.name in made) and e.name not in by_name:
                raise NameProblem(f"{A.show(e)} is neither grouped nor aggregated")
            return None

        aliases = tuple(a or (None if isinstance(e, A.Attr) or e not in place else A.show(e)) for e, a in zip(op.exprs, op.aliases, strict=True))
        op = A.Project(agg, tuple(A.transform(e, swap) for e in op.exprs), aliases)
    return op


def output_names(cols: tuple[Col, ...]) -> list[str]:
    """Names of the result columns: the plain name where it is unique, else with its table, else numbered."""
    plain = [c.name or f"column{k + 1}" for k, c in enumerate(cols)]
    times = Counter(n.lower() for n in plain)
    out: list[str] = []
    for n, c in zip(plain, cols, strict=True):
        full = f"{c.table}_{n}" if times[n.lower()] > 1 and c.table else n
        k, got = 2, full
        while got.lower() in {x.lower() for x in out}:
            got, k = f"{full}_{k}", k + 1
        out.append(got)
    return out


__all__ = ["Col", "Compiler", "JOIN_HINTS", "OTHER", "Rel", "output_names", "rewrite_group_exprs"]
