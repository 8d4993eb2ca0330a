"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Every text is normalised and hashed; ``(id, digest)`` is written to the shared folder.  ``dedup_report`` decides on
   these alone; ``exact_dedup``, which returns whole rows, hashes them again on the way out.
2. A Misra-Gries frequent-items summary over the digests (Spark's ``approx_top_k_accumulate`` per group of
   input partitions, then ``approx_top_k_combine``) names every digest that holds more than about ``4/tracked``
   of the rows, the error bound of the summary, and most of the less frequent ones.  It has a fixed size.
3. The candidates are verified by exact counts on the full digest, with map-side partial aggregation; the
   winner of each verified group (smallest id) is broadcast: at most ``tracked`` rows.
4. Rows with a verified digest get their answer map-side.  All other digests are shuffled by digest; no such
   group can hold more than the error bound's share of the rows.

Defined results: null text counts as empty; equal ids with equal text (repeated rows) keep exactly one row;
a null id sorts after all others, so it is kept only where the whole group has null ids; an empty table gives
an empty result; extra columns pass through, and result columns replace input columns of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Counters of the frequent-items summary; also the bound of the broadcast rows.
TRACKED = 4096
#: Groups of input partitions that summarise on their own before the summaries are combined.
SUMMARY_GROUPS = 32


def normalised(text: Column) -> Column:
    """Each run of the six ASCII white-space characters becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent_digests(keys: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One column ``_key``: 64-bit key of each digest that may be frequent (no frequent one is missing)."""
    part = keys.select(F.xxhash64("_digest").alias("_key"), F.pmod(F.spark_partition_id(), F.lit(SUMMARY_GROUPS)).alias("_g"))
    summaries = part.groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("_s"))
    # A grouped aggregate: the global one fails in tasks without rows (its empty buffer can't be serialised).
    merged = summaries.groupBy((F.col("_g") * 0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {tracked}), {tracked // 2})").alias("_t"))
    return merged.select(F.explode("_t").alias("_t")).where("_t.count > 1").select(F.col("_t.item").alias("_key"))


def verified_winners(keys: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Exact size and winner of each frequent group; at most ``tracked`` rows."""
    near = keys.withColumn("_key", F.xxhash64("_digest")).join(F.broadcast(frequent_digests(keys, tracked)), "_key", "left_semi")
    found = near.groupBy("_digest").agg(F.count(F.lit(1)).alias("_hot_size"), F.min("_id").alias("_hot_keep"))
    rows = keys.agg(F.count(F.lit(1)).alias("_n"))
    return found.crossJoin(F.broadcast(rows)).where(F.col("_hot_size") > F.greatest(F.lit(8), F.col("_n") / tracked)).drop("_n")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """Every row of ``df`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``."""
    results = ["text_sha256", "keep_id", "group_size", "kept"]
    base = df.drop(*[c for c in df.columns if c.lower() in results and c not in (id_col, text_col)])
    (digest,) = fresh(base, "_digest")
    keys = digests(base, id_col, text_col)
    return _decided(base.withColumn(digest, _sha(text_col)), digest, id_col, keys, tracked)


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """``(id_col, text_sha256, keep_id, group_size, kept)`` for every row of ``df``, from ids and digests alone: each
    text is read and hashed once, and never shuffled."""
    keys = digests(df, id_col, text_col)
    base = keys.withColumnRenamed("_id", id_col)
    return _decided(base, "_digest", id_col, keys, tracked)


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text_col)), 256))


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialise(df.select(F.col(id_col).alias("_id"), _sha(text_col).alias("_digest")), "digests")


def _decided(base: DataFrame, digest: str, id_col: str, keys: DataFrame, tracked: int) -> DataFrame:
    """``base``, whose column ``digest`` goes, with the results; ``keys`` has its ids and digests."""
    size, keep, hot_size, hot_keep = fresh(base, "_size", "_keep", "_hot_size", "_hot_keep")
    winners = materialise(verified_winners(keys, tracked), "winners").select(
        F.col("_digest").alias(digest), F.col("_hot_size").alias(hot_size), F.col("_hot_keep").alias(hot_keep)
    )
    rows = base.join(F.broadcast(winners), digest, "left")
    # Losers of a hot group end here.  Its winner goes the ordinary way, where repeated rows of it meet.
    settled = F.col(hot_size).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(hot_keep))
    lost = rows.where(settled).withColumns({keep: F.col(hot_keep), size: F.col(hot_size), "kept": F.lit(False)})
    group = Window.partitionBy(digest)
    first = group.orderBy(F.col(id_col).asc_nulls_last())
    open_rows = rows.where(~settled).withColumns(
        {
            keep: F.first(id_col).over(first),
            size: F.coalesce(F.col(hot_size), F.count(F.lit(1)).over(group)),
            "kept": F.row_number().over(first) == 1,
        }
    )
    out = open_rows.unionByName(lost)
    kept = [F.col(c) for c in base.columns if c != digest]
    return out.select(*kept, F.lower(F.hex(digest)).alias("text_sha256"), F.col(keep).alias("keep_id"), F.col(size).alias("group_size"), F.col("kept"))
