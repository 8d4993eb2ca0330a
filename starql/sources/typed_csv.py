"""CSV files whose first line declares ``name:type`` for each column (types ``int`` and ``string``).

``NULL``, quoted or not, is null; an empty field is the empty string; quotes are doubled inside quotes; a row of the
wrong width is an error.  Files are read by Spark's reader, so any path that Spark can open will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConversionError, TypeMismatch
from .catalog import Catalog

_TYPES = {"int": T.LongType(), "string": T.StringType()}
_HIDDEN = re.compile(r"_\d+$")


def read_header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Column names and types from the first line."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ConversionError(f"{path}: no header")
    out = []
    for cell in first[0].value.rstrip("\r").split(","):
        name, _, kind = cell.strip().strip('"').rpartition(":")
        if not name or kind not in _TYPES:
            raise TypeMismatch(f"{path}: header cell {cell!r} is not name:int or name:string")
        out.append((name, kind))
    return out


#: No text can equal the null marker, so the reader makes no nulls of its own from NULL or empty fields.
OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": "\x01", "emptyValue": "", "mode": "FAILFAST", "enforceSchema": True}


def raw_schema(header: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(header))])


def typed_columns(header: list[tuple[str, str]]) -> list[Column]:
    """Typed columns from the all-text columns of ``raw_schema``."""
    cols = []
    for k, (name, kind) in enumerate(header):
        text = F.coalesce(F.col(f"c{k}"), F.lit(""))
        value = F.when(text == "NULL", F.lit(None).cast("string")).otherwise(text)
        cols.append((value.cast("long") if kind == "int" else value).alias(name))
    return cols


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    header = read_header(spark, path)
    return spark.read.schema(raw_schema(header)).options(**OPTIONS).csv(path).select(*typed_columns(header))


def write_typed_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files that ``read_typed_csv`` reads back (integers and strings only)."""
    names = []
    for f in df.schema.fields:
        kind = "string" if isinstance(f.dataType, T.StringType) else "int" if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType)) else None
        if kind is None:
            raise TypeMismatch(f"{f.name}: only integers and strings can be written")
        names.append(f"{f.name}:{kind}")
    text = df.select(*[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("NULL")).alias(n) for f, n in zip(df.schema.fields, names, strict=True)])
    text.write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode="overwrite")


def list_csv(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table names and paths of a folder, through Hadoop's file system (so any store works)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(conf).listStatus(path)
    out = {}
    for s in found:
        name = s.getPath().getName()
        if name.endswith(".csv"):
            out[name[:-4]] = s.getPath().toString()
    return out


def csv_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The tables of a folder with its ``constraints.meta`` and ``indexes.meta``, if there.

    Names that end in ``_<digits>`` can be queried, but count as unknown to planning."""
    cat = Catalog(spark)
    for name, path in sorted(list_csv(spark, folder).items()):
        cat.add(name, lambda p=path: read_typed_csv(spark, p))
    cat.count_rows = lambda name: 10 if _HIDDEN.search(name) else cat.table(name).count()
    for file, use in (("constraints.meta", cat.declare), ("indexes.meta", cat.declare_indexes)):
        p = spark._jvm.org.apache.hadoop.fs.Path(folder, file)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            use(r.value for r in spark.read.text(p.toString()).collect())
    return cat
