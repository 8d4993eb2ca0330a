"""Text renderings of a result: tab-separated with a typed header, and fixed width.

``tab_separated_lines`` and ``fixed_width_lines`` are DataFrames of lines and can be written at any size; the functions
that return a text collect it to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compile import Rel


def _columns(rel: Rel) -> list[tuple[Column, str]]:
    return [(F.col(f"`{name}`"), kind) for name, kind in rel.df.dtypes]


def tab_separated_header(rel: Rel) -> str:
    """``table.column:type`` for each column."""
    return "\t".join((f"{c.table}.{c.name}" if c.table or c.name else "") + f":{'bool' if c.type == 'null' else c.type}" for c in rel.cols)


def tab_separated_lines(rel: Rel) -> DataFrame:
    """One column ``line``: NULL for null, 1 and 0 for truth values."""
    cells = [F.coalesce((c.cast("int") if kind == "boolean" else c).cast("string"), F.lit("NULL")) for c, kind in _columns(rel)]
    return rel.df.select(F.concat_ws("\t", *cells).alias("line"))


def tab_separated(rel: Rel, keep_order: bool) -> str:
    """Header and rows; rows in text order unless ``keep_order``."""
    rows = [r.line for r in tab_separated_lines(rel).collect()]
    return "\n".join([tab_separated_header(rel), *(rows if keep_order else sorted(rows))]) + "\n"


def fixed_width_lines(rel: Rel) -> DataFrame:
    """One column ``line``: cells of 8 characters, truth values with one more space."""

    def cell(c: Column, kind: str) -> Column:
        text = F.coalesce(F.upper(c.cast("string")) if kind == "boolean" else c.cast("string"), F.lit("NULL"))
        padded = F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), 8 - F.length(text))))
        return F.concat(padded, F.when(c.isNull(), "").otherwise(" ")) if kind == "boolean" else padded

    return rel.df.select(F.concat(*[cell(*x) for x in _columns(rel)]).alias("line"))


def fixed_width(rel: Rel) -> str:
    return "".join(r.line + "\n" for r in fixed_width_lines(rel).collect())
