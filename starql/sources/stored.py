"""Tables written once for a session, as a load step would: sorted Parquet, typed CSV, pipe-separated text.

They go to the folder that all executors share: ``spark.checkpoint.dir``, else the warehouse; only in local mode, where
the driver is the only executor, to a temporary folder that goes when the process ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sizes import stored_bytes

FILE_BYTES = 256 << 20
_roots: dict[str, str] = {}
_paths: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" and not root:
            folder = tempfile.mkdtemp(prefix="starql-tables-")
            atexit.register(shutil.rmtree, folder, True)
            root = "file://" + folder
        _roots[app] = (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return _roots[app]


def stored(spark: SparkSession, label: str, write: Callable[[str], None]) -> str:
    """The path that ``write`` has filled; it is called once for each session and label."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _paths:
        path = f"{shared_root(spark)}/starql-table-{uuid.uuid4().hex}"
        write(path)
        _paths[key] = path
    return _paths[key]


def files_for(spark: SparkSession, *bases: DataFrame) -> int:
    """Files of about ``FILE_BYTES``, and as many as the cluster has cores where the table is small."""
    return max(spark.sparkContext.defaultParallelism, sum(map(stored_bytes, bases)) // FILE_BYTES + 1)


def stored_sorted(df: DataFrame, label: str, key: str, files: int) -> DataFrame:
    """``df`` from a stored table that is dealt to files by ranges of ``key`` and sorted, so that footers prune."""
    from .sorted_table import write_sorted

    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(stored(spark, label, lambda path: write_sorted(df, path, key, files)))


def stored_small(df: DataFrame, label: str) -> DataFrame:
    """``df``, a dimension, from a stored table: its size is known to the planner, and no query derives it again."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(stored(spark, label, lambda path: df.write.parquet(path)))
