"""Estimated cost against measured time, to see how far the cost model orders plans as the clock does."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from ..engine import Engine
from ..frontend.parser import parse
from .search import optimize


@dataclass(frozen=True)
class Measured:
    sql: str
    plan_cost: int
    naive_plan_cost: int
    seconds: float
    rows: int


def cost_and_time(engine: Engine, texts: Iterable[str]) -> list[Measured]:
    """Each query is run once; its whole result is counted on the executors."""
    out = []
    for sql in texts:
        query = parse(sql)
        chosen, naive = optimize(query, engine.catalog), optimize(query, engine.catalog, naive=True)
        began = time.time()
        rows = engine.relation(query).df.count()
        out.append(Measured(sql, chosen.cost, naive.cost, time.time() - began, rows))
    return out
