"""Helpers shared by the text operators: durable intermediate tables, bounded samples, id handling."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 1 << 20
#: Bytes at which an Arrow batch to a Python worker ends, at the row that reaches them.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode,
    where all tasks see it, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="starql-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders that ``materialise`` has written, by application.
_written: dict[str, list[str]] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation.  ``release`` removes the folders of results no longer needed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/starql-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Sequence[str]) -> None:
    """Removes intermediate folders; DataFrames that read them can't be used afterwards."""
    conf, known = spark._jsc.hadoopConfiguration(), _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in known:
            known.remove(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session end at ``BATCH_BYTES`` from now on, or sooner where that is set.

    Spark's own bound is 64 MB: as a rule a task's whole texts in one batch, which is built by doubling in memory beside
    the JVM's heap and then held again by the worker, for each task of an executor.  The bound is read when a job runs,
    which may be after an operator has returned, so it stays.  Rows are never cut, and groups stay whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def is_held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, strata: Column, per_stratum: int, buckets: int = 32) -> DataFrame:
    """At most about ``per_stratum`` distinct ids for each value of ``strata``: those with the lowest hash.

    Only ids and strata are shuffled, and each stratum is split over ``buckets`` windows, so a stratum that
    holds most rows is not gathered in one task (Spark's window group limit keeps the lowest of each task first).
    Returns the columns ``(id_col, stratum)``."""
    from pyspark.sql import Window

    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    slim = df.select(F.col(id_col), strata.alias("stratum"), h.alias("_h")).where(F.col(id_col).isNotNull() & F.col("stratum").isNotNull())
    slim = slim.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    w = Window.partitionBy("stratum", "_b").orderBy("_h", id_col)
    keep = -(-per_stratum // buckets)
    return slim.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(id_col, "stratum").distinct()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that do not clash with those of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        got = name
        while got.lower() in taken:
            got = "_" + got
        taken.add(got.lower())
        out.append(got)
    return out


def sent_text(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``df`` and the column to take the text from in its Arrow batches, where null counts as empty: the text column
    itself, so that no text is sent twice, or an added one if ``text_col`` is more than the name of a string column."""
    if [t for c, t in df.dtypes if c == text_col] == ["string"]:
        return df, text_col
    (text,) = fresh(df, "_text")
    return df.withColumn(text, F.col(text_col)), text


def text_of(col: str) -> Column:
    """Whole text with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
