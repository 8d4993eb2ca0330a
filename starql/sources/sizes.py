"""Stored sizes, and sizes in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Right sides of up to this many bytes in memory are sent to every executor when a broadcast is asked for.
BROADCAST_BYTES = 64 << 20
#: What a row of a hash table takes besides its values.
ROW_BYTES = 40
_FIXED = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def stored_bytes(df: DataFrame) -> int:
    """Spark's estimate of a DataFrame's size; for a plain scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def can_broadcast(df: DataFrame) -> bool:
    """Whether a table fits into ``BROADCAST_BYTES``.  What is stored or estimated larger does not; anything else is
    measured by a job of its own, since files may be many times smaller than their rows.  The size of a stream's
    batches is left to the stream's own settings."""
    if df.isStreaming:
        return True
    if stored_bytes(df) > BROADCAST_BYTES:
        return False
    size = F.lit(ROW_BYTES + 8 * len(df.columns)).cast("long")
    for c, kind in df.dtypes:
        if kind not in _FIXED:
            size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
