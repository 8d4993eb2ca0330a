"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Each test item gives its word n-grams: of three words; of two where that is too long for the edits to be found (an
   item of five words); of all its words if it has one or two.
2. A bitmap of fixed size over the n-gram hashes goes to all tasks, whatever the size of the test set; the n-grams of the
   documents that pass it are written out with document and position.
3. Seeds of an item are its rare n-grams: those in at most ``max(32, n_docs / 10_000)`` documents, and in any case the
   rarer half of them and more than the allowed edits can break, so an item that many documents quote keeps its seeds
   and no copy loses all of them.
4. Seeds and written n-grams are joined by a shuffle on the n-gram and grouped by document and item.  Hits that lie close
   together form a window; it is aligned if it holds as many different seeds as a copy of the required similarity must
   (each edit breaks at most ``n`` of them), so nothing above the threshold is lost to this test.
5. Local alignment on words (match 2, mismatch -1, gap -1) gives a score, divided by that of the whole item.

Texts are read twice, and only those of documents with candidates are aligned.  Beyond ``BROADCAST_BYTES`` of candidates
the texts are thinned by a bitmap of the candidates' text hashes and joined by a shuffle.

Defined results: a null or empty text or item matches nothing; an item of one or two words is found wherever its words
stand in a row; repeated items or rows match each; of several windows of one item in a text the best counts, and of equal
ones the first; positions are word numbers, end exclusive; an empty table on either side gives no hit; null ids are
allowed; extra columns pass through."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import fresh, materialise

N = 3
SIMILARITY = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
#: A bitmap has 2**BITMAP_BITS bits (8 MB).
BITMAP_BITS = 26
#: Candidates of up to this many bytes, and up to this many rows to drop, are broadcast.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000


def edits(m: int, similarity: float) -> int:
    """Words of an item of ``m`` words that a copy may change."""
    return math.floor((1 - similarity) * m + 1e-9)


def seed_width(m: int, n: int, similarity: float) -> int:
    """The longest n-grams, up to ``n`` words, of which one is left whatever the allowed edits break."""
    return next(w for w in range(min(n, m), 0, -1) if w == 1 or m - w + 1 > w * edits(m, similarity))


def _text_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word, and the first word of each row and behind the last."""
    data, offsets = X.buffers(col, lower=True)
    s, e, rows = X.words(data, offsets)
    return X.span_hashes(data, s, e), rows, np.searchsorted(rows, np.arange(len(offsets)))


def item_profiles(items: DataFrame, n: int, similarity: float) -> DataFrame:
    """``(item, m, width, words, grams)`` for each ``(item, _text)`` with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                h, _, first = _text_words(X.column(part, "_text"))
                rows = []
                for key, a, b in zip(X.column(part, "item").to_pylist(), first[:-1], first[1:], strict=True):
                    if b > a:
                        w = seed_width(int(b - a), n, similarity)
                        gram, _, _ = X.ngrams(h[a:b], np.zeros(b - a, np.int64), w)
                        rows.append((key, int(b - a), w, h[a:b].tobytes(), np.unique(gram).view(np.int64).tolist()))
                cols = [*zip(*rows, strict=True)] or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "m", "width", "words", "grams"])

    return items.mapInArrow(run, "item long, m int, width int, words binary, grams array<bigint>")


def bitmap_of(hashes: DataFrame, column: str) -> bytes:
    """A bitmap over the leading bits of 64-bit hashes; at most 2**(BITMAP_BITS - 6) rows come to the driver."""
    cell = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS)
    words = hashes.select(F.shiftrightunsigned(cell, 6).alias("w"), F.expr("1L").alias("one"), (cell % 64).cast("int").alias("b"))
    got = words.groupBy("w").agg(F.expr("bit_or(shiftleft(one, b))").alias("v")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), X.U64)
    out[np.asarray(got["w"])] = np.asarray(got["v"]).view(X.U64)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes >> X.U64(64 - BITMAP_BITS)
    return (bits[cell >> X.U64(6)] >> (cell & X.U64(63)) & X.U64(1)).astype(bool)


def gram_hits(docs: DataFrame, bitmap: bytes, widths: list[int]) -> DataFrame:
    """``(_id, _hash, gram, pos, first)`` for the n-grams of ``(_id, _hash, _text)`` that pass the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, X.U64)
        for batch in batches:
            for part in X.slices(batch, "_text"):
                h, rows, first = _text_words(X.column(part, "_text"))
                for w in widths:
                    gram, who, at = X.ngrams(h, rows, w)
                    ok = np.flatnonzero(in_bitmap(bits, gram))
                    if not len(ok):
                        continue
                    gram, who, at = gram[ok], who[ok], at[ok]
                    order = np.lexsort((at, gram, who))
                    gram, who, at = gram[order], who[order], at[order]
                    new = np.r_[True, (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])]
                    take = pa.array(who)
                    yield pa.RecordBatch.from_arrays([X.column(part, "_id").take(take), X.column(part, "_hash").take(take), pa.array(gram.view(np.int64)), pa.array(at - first[who], pa.int64()), pa.array(new.astype(np.int32))], names=["_id", "_hash", "gram", "pos", "first"])

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInArrow(run, f"_id {kind}, _hash long, gram long, pos long, first int")


def choose_seeds(profiles: DataFrame, frequency: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """``(gram, item, need)``: the seeds of each item, and how many different ones a window must hold."""
    rank = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "gram")  # a partition is one item's n-grams
    broken = F.col("width") * F.floor((1 - similarity) * F.col("m") + 1e-9)
    all_ = profiles.select("item", "width", broken.alias("broken"), F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    ranked = all_.join(frequency, "gram", "left").withColumn("rank", F.row_number().over(rank))
    kept = ranked.where((F.coalesce("df", F.lit(0)) <= max(32, n_docs // 10_000)) | (F.col("rank") <= F.greatest(F.ceil(F.col("size") / 2), F.col("broken") + 1)))
    seeds = F.count(F.lit(1)).over(Window.partitionBy("item"))
    return kept.select("gram", "item", F.greatest(F.lit(1), seeds - F.col("broken")).alias("need"))


def best_window(words: np.ndarray, text: np.ndarray, pos: np.ndarray, gram: np.ndarray, need: int, n: int, least: float) -> tuple[float, int, int] | None:
    """Score, first word and last word + 1 of the best window of an item in a text; ``pos`` is sorted."""
    m, best = len(words), None
    head = np.flatnonzero(np.r_[True, np.diff(pos) > m * 3 // 2])
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(pos)], strict=True):
        if len(np.unique(gram[a:b])) < need:
            continue
        lo, hi = max(0, int(pos[a]) - m - m // 4), min(len(text), int(pos[b - 1]) + m + m // 4 + n)
        score, x, y = align(words, text[lo:hi])
        score /= MATCH * m
        if score >= least - 1e-9 and (best is None or score > best[0]):
            best = score, lo + x, lo + y
    return best


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score with the row and column where it ends (the first such row, then column)."""
    ramp = -GAP * np.arange(len(b))
    row, best = np.zeros(len(b), int), (0, 0, 0)
    for i, w in enumerate(a):
        diagonal = np.r_[0, row[:-1]] + np.where(b == w, MATCH, MISMATCH)
        t = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(t + ramp) - ramp  # gaps along the text
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j + 1)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: score, start and end in ``text``.  The start is found by aligning backwards from the end."""
    if not len(item) or not len(text):
        return 0, 0, 0
    score, i, j = _scores(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = _scores(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def _same_row(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a.eqNullSafe(b) & (c == d)


def candidates(docs: DataFrame, profiles: DataFrame, n: int, similarity: float) -> DataFrame:
    """``(_cid, _chash, items)``: for each document, the items with enough seeds in it and their hits."""
    grams = profiles.select(F.explode("grams").alias("gram"))
    widths = sorted(r.width for r in profiles.select("width").distinct().collect())  # at most n
    hits = materialise(gram_hits(docs, bitmap_of(grams, "gram"), widths), "hits")
    frequency = materialise(hits.groupBy("gram").agg(F.sum("first").alias("df")), "frequencies")
    seeds = materialise(choose_seeds(profiles, frequency, docs.count(), similarity), "seeds")
    each = hits.join(seeds, "gram").groupBy("_id", "_hash", "item").agg(F.max("need").alias("need"), F.sort_array(F.collect_set(F.struct("pos", "gram"))).alias("hits"))
    each = each.where(F.size(F.array_distinct(F.transform("hits", lambda x: x["gram"]))) >= F.col("need"))
    each = each.join(profiles.select("item", "words"), "item")
    per_doc = each.groupBy("_id", "_hash").agg(F.collect_list(F.struct("item", "need", "words", "hits")).alias("items"))
    return materialise(per_doc.withColumnsRenamed({"_id": "_cid", "_hash": "_chash"}), "candidates")


def matches(docs: DataFrame, items: DataFrame, n: int, similarity: float) -> DataFrame:
    """``(_id, _hash, item, score, first_word, last_word)``: each item of ``(item, _text)`` in each row of ``docs``."""
    profiles = materialise(item_profiles(items.dropDuplicates(["item"]), n, similarity), "items")
    near = candidates(docs, profiles, n, similarity)
    size = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + F.length(x["words"]) + 16 * F.size(x["hits"]))
    if (near.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        near = F.broadcast(near)
    else:
        docs = _thinned(docs, bitmap_of(near, "_chash"))
    texts = docs.join(near, _same_row(F.col("_id"), F.col("_cid"), F.col("_hash"), F.col("_chash"))).select("_id", "_hash", "_text", "items")
    #: e substitutions in m words give (2 (m - e) - e) / 2 m
    least = 1 - 1.5 * (1 - similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                h, _, first = _text_words(X.column(part, "_text"))
                out = []
                for r, found in enumerate(X.column(part, "items").to_pylist()):
                    own = h[first[r] : first[r + 1]]
                    for x in found:
                        pos, gram = (np.array([y[c] for y in x["hits"]], np.int64) for c in ("pos", "gram"))
                        got = best_window(np.frombuffer(x["words"], X.U64), own, pos, gram, x["need"], n, least)
                        if got:
                            out.append((r, x["item"], *got))
                take = pa.array([x[0] for x in out], pa.int64())
                cols = [pa.array([x[k] for x in out], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([X.column(part, "_id").take(take), X.column(part, "_hash").take(take), *cols], names=["_id", "_hash", "item", "score", "first_word", "last_word"])

    kind = dict(docs.dtypes)["_id"]
    return texts.mapInArrow(run, f"_id {kind}, _hash long, item long, score double, first_word long, last_word long")


def _thinned(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """The rows of ``(_id, _hash, _text)`` whose hash passes the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, X.U64)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, np.asarray(X.column(batch, "_hash")).view(X.U64))))

    return docs.mapInArrow(run, docs.schema)


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    text = F.coalesce(F.col(item_text), F.lit(""))
    return items.select(F.col(item_id).alias("_item_id"), F.xxhash64(text).alias("item"), text.alias("_text"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """``(id_col, item_id, score, first_word, last_word)``: each item found in each document."""
    tests = _items(items, item_id, item_text)
    found = matches(_keyed(docs, id_col, text_col), tests.select("item", "_text"), n, similarity)
    named = found.join(tests.select("item", "_item_id"), "item")
    return named.select(F.col("_id").alias(id_col), F.col("_item_id").alias(item_id), "score", "first_word", "last_word")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found."""
    tests = _items(items, item_id, item_text).select("item", "_text")
    found = matches(_keyed(docs, id_col, text_col), tests, n, similarity)
    i, h = fresh(docs, "_id", "_hash")
    gone = materialise(found.select(F.col("_id").alias(i), F.col("_hash").alias(h)).distinct(), "contaminated")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, _same_row(F.col(id_col), F.col(i), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.col(h)), "left_anti")
