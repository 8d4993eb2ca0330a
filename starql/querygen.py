"""Seeded random queries of the dialect, with renderers for this engine and for DuckDB.

One to three tables joined on equally named columns or crossed; comparisons, BETWEEN, IN and NULL tests under AND,
OR and NOT; about a third aggregated; some ordered."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from .frontend import ast as A


@dataclass(frozen=True)
class TableSpec:
    """A table's columns with their types (int or string) and values to compare with."""

    name: str
    columns: dict[str, str]
    samples: dict[str, list]


class QueryGenerator:
    def __init__(self, tables: list[TableSpec], seed: int):
        self.tables, self.rng = tables, random.Random(seed)

    def query(self) -> A.Query:
        r = self.rng
        op, bound = self._from()
        cols = [(A.Attr(v, c), t, s) for v, t in bound.items() for c, s in t.columns.items()]
        if r.random() < 0.6:
            op = A.Filter(op, self._predicate(cols, 0))
        if r.random() < 0.3:
            return self._aggregated(op, cols)
        chosen = r.sample(cols, r.randint(1, min(4, len(cols))))
        exprs = [a for a, _, _ in chosen]
        numbers = [a for a, _, s in cols if s == "int"]
        if numbers and r.random() < 0.3:
            exprs.append(A.Bin(r.choice(["+", "-", "*"]), r.choice(numbers), A.Int(r.randint(1, 9))))
        op = A.Project(op, tuple(exprs), tuple(f"c{k}" for k in range(len(exprs))))
        return A.Query(op, self._order([a for a, _, _ in chosen]))

    def _from(self) -> tuple[A.Op, dict[str, TableSpec]]:
        r = self.rng
        op: A.Op | None = None
        bound: dict[str, TableSpec] = {}
        for k in range(r.choice([1, 1, 2, 2, 3])):
            spec = r.choice(self.tables)
            visible = f"t{k}"
            scan = A.Table(spec.name, visible)
            if op is None:
                op = scan
            else:
                shared = [(v, c) for v, t in bound.items() for c in t.columns if spec.columns.get(c) == t.columns[c]]
                if shared and r.random() < 0.8:
                    v, c = r.choice(shared)
                    op = A.Join(r.choice(["inner", "inner", "left", "right", "full"]), op, scan, A.Bin("=", A.Attr(v, c), A.Attr(visible, c)))
                else:
                    op = A.Cross(op, scan)
            bound[visible] = spec
        return op, bound

    def _aggregated(self, op: A.Op, cols: list) -> A.Query:
        r = self.rng
        groups = tuple(a for a, _, _ in r.sample(cols, r.randint(0, min(2, len(cols)))))
        numbers = [a for a, _, s in cols if s == "int"]
        aggs = list(dict.fromkeys(r.choice([A.Agg("COUNT", None), A.Agg("COUNT", r.choice(cols)[0]), *([A.Agg("SUM", r.choice(numbers))] if numbers else [])]) for _ in range(r.randint(1, 2))))
        names = tuple(f"__agg{k}" for k in range(len(aggs)))
        exprs = groups + tuple(A.Attr("", n) for n in names)
        return A.Query(A.Project(A.Aggregate(op, groups, tuple(aggs), names), exprs, tuple(f"c{k}" for k in range(len(exprs)))), self._order(list(groups)))

    def _order(self, keys: list[A.Attr]) -> tuple[A.SortKey, ...]:
        r = self.rng
        if not keys or r.random() > 0.3:
            return ()
        return tuple(A.SortKey(k, r.random() < 0.5) for k in r.sample(keys, r.randint(1, len(keys))))

    def _predicate(self, cols: list, depth: int) -> A.Expr:
        r = self.rng
        if depth < 2 and r.random() < 0.5:
            e: A.Expr = A.Bin(r.choice(["and", "or"]), self._predicate(cols, depth + 1), self._predicate(cols, depth + 1))
            return A.Un("not", e) if r.random() < 0.2 else e
        a, spec, kind = r.choice(cols)
        lit = lambda: A.Int(r.choice(spec.samples[a.name])) if kind == "int" else A.Str(r.choice(spec.samples[a.name]))
        roll = r.random()
        if roll < 0.12:
            e = A.Un("isnull", a)
            return A.Un("not", e) if r.random() < 0.5 else e
        if roll < 0.3:
            values = [lit() for _ in range(r.randint(1, 4))] + [A.Lit("NULL")] * (r.random() < 0.15)
            return A.In(a, tuple(values), r.random() < 0.4)
        if roll < 0.42:
            lo, hi = sorted((lit(), lit()), key=lambda x: x.value)
            e = A.Bin("and", A.Bin(">=", a, lo), A.Bin("<=", a, hi))
            return A.Un("not", e) if r.random() < 0.3 else e
        return A.Bin(r.choice(A.COMPARISONS), a, lit())


@dataclass(frozen=True)
class Dialect:
    """How a SQL dialect writes what dialects write differently."""

    wide_sums: str = ""
    null_order: str = ""
    not_equal: str = "<>"
    prefix: str = ""
    joins: tuple[str, str, str, str] = ("INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN")

    def join(self, kind: str) -> str:
        return self.joins[("inner", "left", "right", "full").index(kind)]

    def expr(self, e: A.Expr) -> str:
        """Text of an expression; only the comparison is spelled differently, so string literals are kept as they are."""
        parts = re.split(r"('(?:[^']|'')*')", A.show(e))
        return "".join(p if p.startswith("'") else p.replace("<>", self.not_equal) for p in parts)


OWN = Dialect()
#: Whole sums and counts are 64-bit, and NULLs sort last.
DUCKDB = Dialect("BIGINT", " NULLS LAST")
POSTGRES = Dialect("BIGINT", "", "!=")
#: Tables have a schema in front, and outer joins say so.
TRANSACT = Dialect("BIGINT", "", "<>", "dbo.", ("INNER JOIN", "LEFT OUTER JOIN", "RIGHT OUTER JOIN", "FULL OUTER JOIN"))


def to_sql(q: A.Query, duckdb: bool = False, dialect: Dialect | None = None) -> str:
    """Text of a generated query in a dialect."""
    d = dialect or (DUCKDB if duckdb else OWN)
    op, where, agg = q.op, "", None
    assert isinstance(op, A.Project)
    exprs, aliases, op = op.exprs, op.aliases, op.source
    if isinstance(op, A.Aggregate):
        agg, op = op, op.source
    if isinstance(op, A.Filter):
        where, op = f" WHERE {d.expr(op.pred)}", op.source

    def item(e: A.Expr) -> str:
        if agg and isinstance(e, A.Attr) and e.name in agg.names and not e.table:
            text = A.show(agg.aggs[agg.names.index(e.name)])
            return f"CAST({text} AS {d.wide_sums})" if d.wide_sums else text
        return A.show(e)

    def table(o: A.Op) -> str:
        match o:
            case A.Table(n, a):
                return f"{d.prefix}{n} AS {a}" if a else d.prefix + n
            case A.Cross(a, b):
                return f"{table(a)} CROSS JOIN {table(b)}"
            case A.Join(k, a, b, c):
                return f"{table(a)} {d.join(k)} {table(b)} ON {d.expr(c)}"
        raise TypeError(o)

    text = "SELECT " + ", ".join(f"{item(e)} AS {a}" for e, a in zip(exprs, aliases, strict=True)) + f" FROM {table(op)}{where}"
    if agg and agg.groups:
        text += " GROUP BY " + ", ".join(map(A.show, agg.groups))
    if q.order:
        text += " ORDER BY " + ", ".join(A.show(k.attr) + (" DESC" if k.descending else "") + d.null_order for k in q.order)
    return text
