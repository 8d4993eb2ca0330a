"""The engine: SQL text over a catalog to a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .frontend import ast as A
from .frontend.parser import parse
from .operators.compile import Compiler, Rel, output_names, rewrite_group_exprs
from .operators.rewrites import DEFAULT, apply_rewrites
from .sources.catalog import Catalog


@dataclass
class Engine:
    """``rewrites`` names the tree rewrites to use; () leaves all optimisation to Catalyst.  ``join_hint`` names the
    strategy of all joins; a broadcast that is asked for becomes a merge join where the right side is too large."""

    catalog: Catalog
    rewrites: tuple[str, ...] = DEFAULT
    join_hint: str | None = None

    def plan(self, sql: str | A.Query) -> tuple[A.Query, dict[str, int]]:
        """The tree that is compiled and the use of each rewrite."""
        q = parse(sql) if isinstance(sql, str) else sql
        op, used = apply_rewrites(rewrite_group_exprs(q.op), self.catalog, self.rewrites)
        return A.Query(op, q.order), used

    def relation(self, sql: str | A.Query) -> Rel:
        return Compiler(self.catalog, self.join_hint).query(self.plan(sql)[0])

    def sql(self, sql: str | A.Query) -> DataFrame:
        """The result with visible column names; nothing runs yet, but for measuring what is asked to be broadcast."""
        rel = self.relation(sql)
        names = output_names(rel.cols)
        return rel.df.select(*[rel.df[c.ref].alias(n) for c, n in zip(rel.cols, names, strict=True)])
