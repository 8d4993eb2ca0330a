"""Sorted tables: what an index on one column is in Parquet.

Rows are dealt to files by key range and sorted inside them, so the footers' minima and maxima tell which files and
row groups can hold a key; a comparison with a constant is pushed down to them by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalog import Catalog


def write_sorted(df: DataFrame, path: str, key: str, files: int = 8, row_group_bytes: int = 16 << 20) -> None:
    """NULL keys come first and are found by no seek.  ``files`` should grow with the table (about 256 MB each)."""
    dealt = df.repartitionByRange(files, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def add_sorted(catalog: Catalog, name: str, path: str, key: str) -> Catalog:
    """A table written by ``write_sorted``; planning may seek on its key."""
    catalog.sorted_indexes.add((name, key))
    return catalog.add_parquet(name, path)
