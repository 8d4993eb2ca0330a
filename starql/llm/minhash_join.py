"""Similarity join on word n-grams: MinHash banding, then verification on the full n-gram sets.

1. Each text becomes its set of 64-bit n-gram hashes; a signature of minima under ``bands * rows`` hash functions and
   a 128-bit digest of the set are kept.  Band and row counts follow from the threshold and the target recall.
2. Texts with equal sets are one *class of copies* with a representative and a size; only representatives go on.
3. Representatives are shuffled on band hashes.  A bucket yields one edge from each member to its least member, never
   all pairs; connected components of these edges are the candidate groups.
4. The n-gram sets of candidates are built again from their texts and brought together once per group; groups of more
   than ``BLOCK`` sets or ``BLOCK_BYTES`` are dealt to pairs of blocks.  Inside a block pair, intersections are matrix
   products, so no pair is ever a row.  Each block pair gives, for each text, the number of its links and one edge of a
   spanning forest.
5. Components of the forest are the classes; link counts are sums.

Defined results: a text with fewer than ``n`` words (at least one) has one n-gram of all its words; a text without
words, null or empty, links to nothing; repeated rows count as documents of their own; null ids are allowed and never
are a class id unless the whole class has none; extra columns pass through; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import fresh, materialise
from .components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.995
MAX_BANDS = 20
#: Sets of a block, and bytes of their n-grams, on average at most.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Candidate tables up to this many rows (some 30 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000

_rng = np.random.Generator(np.random.PCG64(77))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most selective rows whose number of bands for the target recall stays in the limit."""
    best = (max_bands, 1)
    for rows in range(1, 65):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands > max_bands:
            break
        best = (bands, rows)
    return best


def ngram_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    data, offsets = X.buffers(col, lower=True)
    s, e, rows = X.words(data, offsets)
    h, who, _ = X.ngrams(X.span_hashes(data, s, e), rows, n, short=True)
    cut = np.searchsorted(who, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def set_key(s: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    a, b = X.mix(s + X.U64(0x1234567)).sum(dtype=X.U64), X.mix(s ^ X.U64(0x9E3779B97F4A7C15)).sum(dtype=X.U64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def _hash_functions(k: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(4242))
    return r.integers(1, 1 << 63, (k, 2), dtype=np.int64).astype(X.U64) * X.U64(2) + X.U64(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each set and band; sets are not empty."""
    flat, heads = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), bands), X.U64)
    fs = _hash_functions(bands * rows)
    for b in range(bands):
        acc = np.full(len(sets), b + 1, X.U64)
        for a, c in fs[b * rows : (b + 1) * rows]:
            acc = X.mix(acc * X.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ c) * a, heads))
        out[:, b] = acc
    return out


def signatures(rows: DataFrame, n: int, bands: int, rows_per_band: int) -> DataFrame:
    """``(_id, _hash, _key, _n, _bands)`` from ``(_id, _text, _hash)``: digest and size of the n-gram set, and band
    hashes; key and bands are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                sets = ngram_sets(X.column(part, "_text"), n)
                full = [s for s in sets if len(s)]
                found = iter(band_hashes(full, bands, rows_per_band).view(np.int64).tolist() if full else [])
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([X.column(part, "_id"), X.column(part, "_hash"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([next(found) if k else None for k in keys], pa.list_(pa.int64()))], names=["_id", "_hash", "_key", "_n", "_bands"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, _hash long, _key binary, _n int, _bands array<bigint>")


def _linked(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """Boolean matrix of links; with ``split``, only between the first ``split`` sets and the others."""
    size = np.array([len(s) for s in sets], float)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), size.astype(int))
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    head = np.r_[True, flat[1:] != flat[:-1]]
    col = np.cumsum(head) - 1
    shared = np.bincount(col)[col] > 1
    who, col = who[shared], np.unique(col[shared], return_inverse=True)[1]
    cut = split or 0
    rows, cols = (np.arange(cut), np.arange(cut, len(sets))) if cut else (np.arange(len(sets)),) * 2
    both = np.zeros((len(rows), len(cols)), np.float32)
    width = 2048
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    m = np.zeros((len(sets), width), np.float32)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m[:] = 0
        m[who[a:b], col[a:b] - k * width] = 1
        both += m[:cut] @ m[cut:].T if cut else m @ m.T
    link = np.zeros((len(sets), len(sets)), bool)
    for i, row in zip(rows.tolist(), both, strict=True):
        shared = row.astype(float)
        link[i, cols] = shared >= threshold * (size[i] + size[cols] - shared) - 1e-9
    if cut:
        link[cut:, :cut] = link[:cut, cut:].T
    np.fill_diagonal(link, False)
    return link


def _roots(link: np.ndarray) -> np.ndarray:
    """Least member of each component of a symmetric boolean matrix."""
    lab = np.arange(len(link))
    while True:
        new = np.minimum(lab, np.where(link, lab[None, :], len(lab)).min(axis=1))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links and forest edges of a block pair, or of several small groups."""
    comp, node, size, side = (pdf[c].to_numpy() for c in ("comp", "node", "size", "side"))
    grams = pdf["grams"].tolist()
    order = np.lexsort((node, side, comp))
    same = np.r_[False, (comp[order[1:]] == comp[order[:-1]]) & (node[order[1:]] == node[order[:-1]])]
    order = order[~same]  # repeated rows bring their set twice
    start = np.flatnonzero(np.r_[True, comp[order[1:]] != comp[order[:-1]]]) if len(order) else []
    across = len(pdf) > 0 and pdf["lo"].iat[0] != pdf["hi"].iat[0]  # links inside a block are found where it meets itself
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(start, [*start[1:], len(order)], strict=True):
        if b - a < 2:
            continue
        at = order[a:b]
        own, split = node[at], int((side[at] == 0).sum())
        if across and not 0 < split < b - a:
            continue
        link = _linked([np.frombuffer(grams[i], X.U64) for i in at.tolist()], threshold, split if across else None)
        has = link.any(axis=1)
        if has.any():
            by_node = np.argsort(own, kind="stable")
            root = np.empty(len(own), np.int64)
            root[by_node] = own[by_node][_roots(link[np.ix_(by_node, by_node)])]
            out.append((own[has], (link @ size[at])[has].astype(np.int64), root[has]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("node", "links", "root"), cols, strict=True)))


def _small(df: DataFrame) -> DataFrame:
    """A materialised table, broadcast if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each row of ``df``: ``_id``, ``_hash`` (of the text), ``class_id`` (least id of the class of linked texts;
    the row's own id if it has no link), ``n_links`` (number of other rows with Jaccard similarity of at least
    ``threshold``) and ``is_first`` (true for exactly one row of each class)."""
    bands, rows = choose_bands(threshold, recall)
    src = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), text_hash(text_col).alias("_hash"))
    sig = materialise(signatures(src, n, bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_hash").alias("hash")))
    copies = sig.where("_key IS NOT NULL").groupBy("_key").agg(first.alias("f"), F.count(F.lit(1)).alias("size"), F.max("_n").alias("n"))
    copies = materialise(copies.select("_key", F.col("f.row").alias("node"), F.col("f.id").alias("id"), F.col("f.hash").alias("hash"), "size", "n"), "copies")

    reps = sig.join(copies.select(F.col("node").alias("_row"), F.col("size")), "_row", "left_semi")
    cells = reps.select(F.col("_row").alias("node"), F.explode("_bands").alias("cell"))
    full = cells.groupBy("cell").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").select("cell", "low")
    full = materialise(full, "cells")  # on its own, so that the join below can split a frequent cell's partition
    star = cells.join(full, "cell").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    groups = connected_components(materialise(star, "star")).withColumnRenamed("label", "comp")

    members = materialise(groups.join(copies.withColumnRenamed("_key", "key"), "node"), "members")
    spread = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    cand = members.join(materialise(spread, "blocks"), "comp")
    cand = materialise(cand.select("comp", "blocks", "node", "id", "hash", "size", "key"), "candidates")
    total = cand.count()
    # Id and text hash together: many rows may share an id, or have none.
    texts = src.join(_small(cand), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash"))).select("comp", "blocks", "node", "size", "key", "_text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                sets = ngram_sets(X.column(part, "_text"), n)
                own = [set_key(s) == k for s, k in zip(sets, X.column(part, "key").to_pylist(), strict=True)]  # an id may stand on several texts
                cols = [X.column(part, c) for c in ("comp", "blocks", "node", "size")] + [pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["comp", "blocks", "node", "size", "grams"]).filter(pa.array(own))

    sets = texts.mapInArrow(grams, "comp long, blocks long, node long, size long, grams binary")
    # A small group goes whole to one of many bins; a large one is dealt to all pairs of its blocks.
    bins = max(16, total // 500)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = F.col("blocks") > 1
    dealt = dealt.select(
        "comp", "node", "size", "grams",
        F.when(large, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins))).alias("k"),
        F.when(large, F.least("own", "other")).otherwise(F.lit(-1)).alias("lo"),
        F.when(large, F.greatest("own", "other")).otherwise(F.lit(-1)).alias("hi"),
        F.when(large & (F.col("own") > F.col("other")), 1).otherwise(0).alias("side"),
    )
    checked = dealt.groupBy("k", "lo", "hi").applyInPandas(lambda pdf: _verify(pdf, threshold), "node long, links long, root long")
    checked = materialise(checked, "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    forest = connected_components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))

    known = copies.join(links, "node", "left").join(forest, "node", "left").where("size > 1 OR links > 0")
    known = known.withColumn("label", F.coalesce("label", "node"))
    best = known.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("row"))).alias("f"))
    known = known.join(best, "label").select(F.col("_key"), F.col("f.id").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("f.row").alias("first"))
    known = materialise(known, "classes")
    answer = sig.select("_id", "_hash", "_key", "_row").join(_small(known), "_key", "left")
    return answer.select("_id", "_hash", F.when(F.col("first").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("first") == F.col("_row"), F.lit(True)).alias("is_first"))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``df`` with the ``class_id``, ``n_links`` and ``is_first`` of ``jaccard_classes``."""
    base = df.drop("class_id", "n_links", "is_first")
    return _attach(base, jaccard_classes(base, id_col, text_col, **options), id_col, text_col)


def _attach(base: DataFrame, answer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``base`` with their answers, matched by id and text hash; repeated rows are matched in turn."""
    i, h, turn, turn2 = fresh(base, "_ans_id", "_ans_hash", "_turn", "_turn2")
    repeated = answer.groupBy("_id", "_hash").count().where("count > 1").limit(1).count() > 0
    answer = answer.select(F.col("_id").alias(i), F.col("_hash").alias(h), "class_id", "n_links", "is_first")
    match = F.col(id_col).eqNullSafe(F.col(i)) & (text_hash(text_col) == F.col(h))
    if repeated:
        base_turn = base.withColumn(turn, F.row_number().over(Window.partitionBy(id_col, text_hash(text_col)).orderBy(F.lit(0))))
        answer = answer.withColumn(turn2, F.row_number().over(Window.partitionBy(i, h).orderBy("is_first")))
        out = base_turn.join(answer, match & (F.col(turn) == F.col(turn2)), "left")
    else:
        out = base.join(answer, match, "left")
    return out.select(*[F.col(c) for c in base.columns], "class_id", "n_links", "is_first")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
