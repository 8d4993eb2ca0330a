"""Where tables come from: typed-header CSV folders, Parquet views, pipe-separated tables, DataFrames."""

from .catalog import Catalog, ForeignKey
from .typed_csv import csv_catalog, read_typed_csv, write_typed_csv

__all__ = ["Catalog", "ForeignKey", "csv_catalog", "read_typed_csv", "write_typed_csv"]
