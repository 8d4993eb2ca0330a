"""The query suite: every operator of the dialect over the driver's tables, each with its DuckDB counterpart."""

from . import suite, surface


def queries() -> dict:
    return suite.queries() | surface.queries()


def oracle_sql() -> dict[str, str]:
    return suite.oracle_sql() | surface.oracle_sql()


__all__ = ["oracle_sql", "queries"]
