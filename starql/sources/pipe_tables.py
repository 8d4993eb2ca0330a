"""Pipe-separated generator output (``.tbl``, each line ends with a separator) to typed CSV or DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConversionError
from .typed_csv import write_typed_csv


def read_tbl(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Checked read: a line of another width, or a field that is no integer where one is declared, is an error."""
    line = spark.read.text(path).select(F.split("value", r"\|", -1).alias("f"))
    n = len(columns)
    wide = (F.size("f") == n) | ((F.size("f") == n + 1) & (F.element_at("f", n + 1) == ""))
    line = line.where(F.when(wide, True).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.array_join("f", "|"))).cast("boolean")))
    cols = []
    for k, (name, kind) in enumerate(columns):
        if kind not in ("int", "string"):
            raise ConversionError(f"{name}: unknown type {kind}")
        field = F.col("f")[k]
        cols.append((field.cast("long") if kind == "int" else field).alias(name))
    return line.select(*cols)


def convert_tbl(spark: SparkSession, source: str, target: str, columns: Sequence[tuple[str, str]]) -> None:
    write_typed_csv(read_tbl(spark, source, columns), target)


# The star-schema tables and their column types.
SSB_SCHEMA = {
    "lineorder": [
        ("lo_orderkey", "int"), ("lo_linenumber", "int"), ("lo_custkey", "int"), ("lo_partkey", "int"),
        ("lo_suppkey", "int"), ("lo_orderdate", "int"), ("lo_orderpriority", "string"), ("lo_shippriority", "string"),
        ("lo_quantity", "int"), ("lo_extendedprice", "int"), ("lo_ordtotalprice", "int"), ("lo_discount", "int"),
        ("lo_revenue", "int"), ("lo_supplycost", "int"), ("lo_tax", "int"), ("lo_commitdate", "int"),
        ("lo_shipmode", "string"),
    ],
    "customer": [
        ("c_custkey", "int"), ("c_name", "string"), ("c_address", "string"), ("c_city", "string"),
        ("c_nation", "string"), ("c_region", "string"), ("c_phone", "string"), ("c_mktsegment", "string"),
    ],
    "supplier": [
        ("s_suppkey", "int"), ("s_name", "string"), ("s_address", "string"), ("s_city", "string"),
        ("s_nation", "string"), ("s_region", "string"), ("s_phone", "string"),
    ],
    "part": [
        ("p_partkey", "int"), ("p_name", "string"), ("p_mfgr", "string"), ("p_category", "string"),
        ("p_brand", "string"), ("p_color", "string"), ("p_type", "string"), ("p_size", "int"),
        ("p_container", "string"),
    ],
    "date": [
        ("d_datekey", "int"), ("d_date", "string"), ("d_dayofweek", "string"), ("d_month", "string"),
        ("d_year", "int"), ("d_yearmonthnum", "int"), ("d_yearmonth", "string"), ("d_daynuminweek", "int"),
        ("d_daynuminmonth", "int"), ("d_daynuminyear", "int"), ("d_monthnuminyear", "int"), ("d_weeknuminyear", "int"),
        ("d_sellingseason", "string"), ("d_lastdayinweekfl", "int"), ("d_lastdayinmonthfl", "int"), ("d_holidayfl", "int"),
        ("d_weekdayfl", "int"),
    ],
}
