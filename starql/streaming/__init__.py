"""Continuous queries: the same dialect over folders that grow.

A catalog may mix growing and fixed tables.  Filters, projections and joins with fixed tables are stateless and run in
``append`` mode; aggregations keep their groups as state and need ``complete`` or ``update`` mode.  The dialect has no time
type, so there are no watermarks; state grows with the number of groups, and two growing tables can't be outer-joined."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.catalog import Catalog
from ..sources.typed_csv import OPTIONS, raw_schema, typed_columns


def add_growing_csv(catalog: Catalog, name: str, folder: str, columns: list[tuple[str, str]]) -> Catalog:
    """A table of all typed CSV files that are or will be in ``folder``; ``columns`` are (name, ``int`` or ``string``)."""

    def read():
        stream = catalog.spark.readStream.schema(raw_schema(columns)).options(**OPTIONS).csv(folder)
        return stream.select(*typed_columns(columns))

    return catalog.add(name, read)


def add_growing_parquet(catalog: Catalog, name: str, folder: str, schema: str) -> Catalog:
    return catalog.add(name, lambda: catalog.spark.readStream.schema(schema).parquet(folder))


def start(engine: Engine, sql: str, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs ``sql`` continuously into Parquet files (``append``) or a named in-memory table (other modes)."""
    out = engine.sql(sql).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        return out.format("parquet").option("path", target).start()
    return out.format("memory").queryName(target).start()


__all__ = ["add_growing_csv", "add_growing_parquet", "start"]
