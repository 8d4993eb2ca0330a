"""Suffix-array dedup: removes every byte covered by a ``SPAN``-byte string that also starts anywhere else.

A corpus is far too long for one array, so it is cut into small problems that lose nothing:

1. In every ``SPAN``-byte string, the ``GRAM``-byte substring with the least hash (the leftmost of equals) is its
   *anchor*.  Equal strings have their anchor at the same offset and with the same content, so any repeat shows up
   as two occurrences of one anchor gram.  Grams that occur once are dropped (counts with map-side aggregation).
2. Around an anchor, only ``SPAN - GRAM`` bytes on either side can belong to its strings: its *slice*.  Equal slices
   of one gram are copies; they are collapsed, and a slice with two occurrences is repeated as a whole.
3. The different slices of a gram are brought together.  On either side, their contents are paths through a compact
   trie, whose edges stand for symbols: two slices share exactly the edges before the place where they part.  The
   suffix array of these strings (``suffix_array``: Lyndon groups taken in descending order, then emitted,
   without renaming) brings the longest common continuation next to each suffix, and from the common prefixes
   with both neighbours follows the largest stretch around the anchor that repeated strings cover.
4. Stretches are collected for each text, merged and cut out of its bytes.

The slices of a gram with more than ``large`` different ones never come together in a task.  Such a group is divided by
where a common string may lie: if it has between ``lo`` and ``hi`` bytes left of the gram, then ``lo`` bytes there and
``SPAN - GRAM - hi`` on the right are common in full, so only slices that agree in these can share it.  Slices that
agree in all that strings of the interval can cover are copies there: this settles them, and one goes on for all.  The
intervals get narrower in ``STEPS`` as long as a group of agreeing slices is too large, down to one value, where whole
strings are compared.  Groups are counted by hash with map-side aggregation, and groups of one are dropped on the way.

Defined results: null counts as empty; matches do not cross rows; repeated rows are repeats of one another; texts
shorter than ``SPAN`` keep all bytes; what remains is bytes and may not be valid UTF-8; null or repeated ids are
allowed; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .common import materialise
from .suffix_array import common_prefixes, suffix_array

SPAN = 400
GRAM = 256
MARGIN = SPAN - GRAM
LARGE = 1024
#: Widths of the intervals in which groups that are too large are divided, one after the other.
STEPS = (72, 24, 6, 0)
#: Symbols of one suffix array (some 300 bytes of working memory each).
SYMBOLS = 300_000
#: Lists of up to this many entries in all (some 5 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_ENTRIES = 100_000
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_BASE2_INV = pow(_BASE2, -1, 1 << 64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all rows of a buffer: position in the row, row, gram hash, slice hash and margins."""
    n, width = len(data), MARGIN + 1
    if n < SPAN:
        return {}
    acc = np.zeros(n + 1, X.U64)
    np.cumsum(X._BYTE_CODE[data] * X._power(X._BASE, n), out=acc[1:])
    inv = X._power(X._BASE_INV, n)
    h = X.mix((acc[GRAM:] - acc[:-GRAM]) * inv[: n - GRAM + 1])
    mask = X.U64((1 << n.bit_length()) - 1)
    low = (h & ~mask) | np.arange(len(h)).astype(X.U64)  # the position decides between equal hashes
    w = 1
    while w * 2 <= width:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    if w < width:
        low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = rows[: len(low)] == rows[SPAN - 1 : SPAN - 1 + len(low)]
    at = np.unique((low[inside] & mask).astype(np.int64))
    row = rows[at]
    left, right = np.minimum(at - offsets[row], MARGIN), np.minimum(offsets[row + 1] - at - GRAM, MARGIN)
    a, b = at - left, at + GRAM + right
    acc2 = np.zeros(n + 1, X.U64)
    np.cumsum(X._BYTE_CODE[255 - data] * X._power(_BASE2, n), out=acc2[1:])
    part = X.mix((acc2[b] - acc2[a]) * X._power(_BASE2_INV, n)[a] + (left * (SPAN + 1) + right).astype(X.U64))
    return {"pos": at - offsets[row], "row": row, "gram": h[at], "part": part, "left": left, "right": right}


def _anchor_rows(docs: DataFrame, full: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                found = anchors(*X.buffers(X.column(part, "_text")))
                if not found:
                    continue
                gram = pa.array(found["gram"].view(np.int64))
                if not full:
                    g, n = np.unique(found["gram"].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"gram": g, "n": n.astype(np.int64)})
                    continue
                take = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays(
                    [gram, pa.array(found["part"].view(np.int64)), X.column(part, "_id").take(take), X.column(part, "_hash").take(take), pa.array(found["pos"], pa.int64()), pa.array(found["left"], pa.int32()), pa.array(found["right"], pa.int32())],
                    names=["gram", "part", "_id", "_hash", "pos", "lm", "rm"],
                )

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInArrow(run, f"gram long, part long, _id {kind}, _hash long, pos long, lm int, rm int" if full else "gram long, n long")


def _paths(sides: list[bytes]) -> list[list[tuple[int, int]]]:
    """The path of each string through the compact trie of all: (edge number, depth at its end) from the root on.

    Two strings share exactly the edges before the place where they part."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    depth, parent, stack, leaf = [0], [0], [0], [0] * len(sides)
    before = b""
    for i in order:
        own = sides[i]
        m = min(len(before), len(own))
        shared = m - ((int.from_bytes(before[:m]) ^ int.from_bytes(own[:m])).bit_length() + 7) // 8
        last = 0
        while depth[stack[-1]] > shared:
            last = stack.pop()
        if depth[stack[-1]] < shared:
            depth.append(shared)
            parent.append(stack[-1])
            parent[last] = len(depth) - 1
            stack.append(len(depth) - 1)
        if len(own) > shared:
            depth.append(len(own))
            parent.append(stack[-1])
            stack.append(len(depth) - 1)
        leaf[i] = stack[-1]
        before = own
    out = []
    for at in leaf:
        path = []
        while at:
            path.append((at, depth[at]))
            at = parent[at]
        out.append(path[::-1])
    return out


def repeated_stretches(slices: list[tuple[bytes, int, bytes]], span: int = SPAN, gram: int = GRAM, most: int | None = None) -> list[tuple[int, int] | None] | None:
    """For each slice (left margin, identity of its gram, right margin): the bytes left and right of the gram that
    strings of ``span`` bytes shared with another slice cover, or None.  The slices differ from one another.
    Instead of a result there is None if it would take a suffix array of more than ``most`` symbols."""
    lefts, rights = _paths([s[0][::-1] for s in slices]), _paths([s[2] for s in slices])
    if most is not None and sum(map(len, lefts)) + sum(map(len, rights)) + 2 * len(slices) > most:
        return None
    base = 1 + len(slices)
    width = 2 * len(slices) + 1
    grams = {g: base + 2 * width + k for k, g in enumerate(sorted({s[1] for s in slices}))}
    text: list[int] = []
    home: list[tuple[int, int]] = []
    for i, (_, g, _) in enumerate(slices):
        piece = [base + p[0] for p in reversed(lefts[i])] + [grams[g]] + [base + width + p[0] for p in rights[i]] + [1 + i]
        home += [(i, k) for k in range(len(piece))]
        text += piece
    order = suffix_array(text)
    lcp = common_prefixes(text, order) + [0]
    best: list[tuple[int, int] | None] = [None] * len(slices)
    for k, at in enumerate(order):
        i, o = home[at]
        n_left = len(lefts[i]) - o
        if n_left < 0:
            continue
        shared = max(lcp[k], lcp[k + 1]) - n_left - 1
        if shared < 0:
            continue
        a = lefts[i][n_left - 1][1] if n_left else 0
        b = rights[i][shared - 1][1] if shared else 0
        if a + b + gram >= span:
            old = best[i] or (0, 0)
            best[i] = (max(old[0], a), max(old[1], b))
    return best


def _merge(best: list, found: list, at: list[int]) -> None:
    """Widens the stretches of the slices ``at`` by ``found``."""
    for i, f in zip(at, found, strict=True):
        if f:
            old = best[i] or (0, 0)
            best[i] = (max(old[0], f[0]), max(old[1], f[1]))


def stretches(slices: list[tuple[bytes, int, bytes]], most: int = SYMBOLS, span: int = SPAN, gram: int = GRAM) -> list[tuple[int, int] | None]:
    """``repeated_stretches`` with suffix arrays of at most some ``most`` symbols.

    A larger group is divided by what its members share next to their common core: a common string that reaches ``x``
    bytes or more to the left of the gram has those in full, any other reaches ``y`` bytes or more to the right.  For
    the first kind, margins beyond ``y - 1`` to the right are left to the second, and the other way round, so the
    division does not add work.  When whole strings are shared, each side's longest continuation is next to it in the
    order of that side, so runs of that order, overlapping by one, are enough."""
    best: list[tuple[int, int] | None] = [None] * len(slices)
    todo = [(list(range(len(slices))), 0, 0, span - gram, span - gram)]
    while todo:
        who, lo, hi, most_left, most_right = todo.pop()
        cut = [(left[max(0, len(left) - most_left) :], mid, right[:most_right]) for left, mid, right in (slices[i] for i in who)]
        missing = span - gram - lo - hi
        found = repeated_stretches(cut, span, gram, most)
        if found is not None:
            _merge(best, found, who)
        elif not missing:
            step = max(2, most // (2 * span))
            for side in (lambda k: (cut[k][0][::-1], cut[k][1]), lambda k: (cut[k][2], cut[k][1])):
                order = sorted(range(len(who)), key=side)
                for at in range(0, len(order) - 1, step - 1):
                    run = order[at : at + step]
                    _merge(best, repeated_stretches([cut[k] for k in run], span, gram), [who[k] for k in run])
        else:
            x = lo + (missing + 1) // 2
            y = span - gram - x + 1
            parts: dict[tuple, list[int]] = {}
            for i, (left, mid, right) in zip(who, cut, strict=True):
                if len(left) >= x:
                    parts.setdefault(("l", mid, left[len(left) - x :]), []).append(i)
                if len(right) >= y:
                    parts.setdefault(("r", mid, right[:y]), []).append(i)
            for (kind, *_), group in parts.items():
                if len(group) > 1:
                    todo.append((group, x, hi, most_left, y - 1) if kind == "l" else (group, lo, y, x - 1, most_right))
    return best


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    group, gram, part, check = (pdf[c].to_numpy() for c in ("group", "gram", "part", "check"))
    left, right = pdf["l"].tolist(), pdf["r"].tolist()
    order = np.lexsort((part, group))
    g, p = group[order], part[order]
    new = np.r_[True, g[1:] != g[:-1]]
    order, start = order[(first := new | np.r_[True, p[1:] != p[:-1]])], np.flatnonzero(new[first])
    out = []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        if b - a > 1:
            at = order[a:b].tolist()
            found = stretches([(left[i], int(check[i]), right[i]) for i in at])
            out += [(int(gram[i]), int(part[i]), *f) for i, f in zip(at, found, strict=True) if f]
    return pd.DataFrame(out, columns=["gram", "part", "a", "b"]).astype("int64")


#: A slice that is wanted: its place, its group, and the interval in which common strings are looked for.
_WANT = ("gram", "part", "pos", "lo", "hi", "group")


def _with_texts(docs: DataFrame, want: DataFrame) -> DataFrame:
    """``(_id, _hash, _text, want)`` for the texts that hold wanted slices."""
    each = want.groupBy(_row().alias("_wrow")).agg(F.collect_list(F.struct(*_WANT)).alias("want"))
    each = materialise(each, "wanted")
    return docs.join(_small(each, "want"), _row() == F.col("_wrow")).select("_id", "_hash", "_text", "want")


def _row() -> Column:
    """A row by its id, which may be null, and text.  Joins on one 64-bit number keep Spark's hash tables compact: one
    on several columns takes a memory page (64 MB here) for each broadcast, however small."""
    return F.xxhash64("_id", "_hash")


def _fetch(texts: DataFrame) -> DataFrame:
    """The margins of wanted slices, as far as strings of their interval reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                rows: dict[str, list] = {c: [] for c in ("group", "gram", "part", "check", "l", "r")}
                for text, want in zip(X.column(part, "_text").to_pylist(), X.column(part, "want").to_pylist(), strict=True):
                    raw = text.encode()
                    for w in want:
                        p = w["pos"]
                        left, mid, right = raw[max(0, p - w["hi"]) : p], raw[p : p + GRAM], raw[p + GRAM : p + SPAN - w["lo"]]
                        for c, v in zip(rows, (w["group"], w["gram"], w["part"], hash_bytes(mid), left, right), strict=True):
                            rows[c].append(v)
                types = [pa.int64()] * 4 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return texts.mapInArrow(run, "group long, gram long, part long, check long, l binary, r binary")


def _divide(texts: DataFrame, width: int) -> DataFrame:
    """The wanted slices once for each interval of ``width`` within theirs: hash ``key`` of what all strings of the
    interval have in common, hash ``whole`` of all that they can cover, and the bytes ``a`` and ``b`` on either side that
    this has.  Slices that are too short for an interval are left out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                data, offsets = X.buffers(X.column(part, "_text"))
                rows = [(r, w["gram"], w["part"], w["pos"], w["lo"], w["hi"]) for r, ws in enumerate(X.column(part, "want").to_pylist()) for w in ws]
                row, gram, slice_, pos, lo, hi = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                each = (hi - lo) // width if width else hi - lo + 1
                who = np.repeat(np.arange(len(row)), each)
                lo = lo[who] + (np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)) * max(width, 1)
                row, pos = row[who], pos[who]
                begin, end, size = pos - lo, pos + SPAN - lo - width, np.diff(offsets)
                ok = (begin >= 0) & (end <= size[row])
                who, row, lo, pos = who[ok], row[ok], lo[ok], pos[ok]
                a, b = np.minimum(lo + width, pos), np.minimum(MARGIN - lo, size[row] - pos - GRAM)
                at = offsets[row] + pos
                key = X.span_hashes(data, at - lo, at + SPAN - lo - width)
                whole = X.mix(X.span_hashes(data, at - a, at + GRAM + b) + a.astype(X.U64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [X.column(part, "_id").take(take), X.column(part, "_hash").take(take), *[pa.array(c) for c in (gram[who], slice_[who], pos, lo, lo + width, a, b, key.view(np.int64), whole.view(np.int64))]],
                    names=["_id", "_hash", "gram", "part", "pos", "lo", "hi", "a", "b", "key", "whole"],
                )

    kind = dict(texts.dtypes)["_id"]
    return texts.mapInArrow(run, f"_id {kind}, _hash long, gram long, part long, pos long, lo long, hi long, a long, b long, key long, whole long")


def _settle(docs: DataFrame, want: DataFrame, large: int) -> DataFrame:
    """``(gram, part, a, b)`` from the wanted slices, given the size ``k`` of the group of each."""
    ready, found = [want.where(F.col("k") <= large)], []
    for width in STEPS:
        want = want.where(F.col("k") > large)
        if not want.limit(1).count():
            break
        rows = _divide(_with_texts(docs, want), width).withColumn("cell", F.xxhash64("gram", "lo", "key"))
        rows = materialise(rows.withColumn("whole", F.xxhash64("cell", "whole")).drop("key"), "divided")
        one = F.min(F.struct("_id", "_hash", "gram", "part", "pos", "lo", "hi")).alias("one")
        copies = materialise(rows.groupBy("cell", "whole").agg(F.count(F.lit(1)).alias("c"), one), "copies")
        found.append(rows.join(copies.where("c > 1").select("whole"), "whole").select("gram", "part", "a", "b"))
        # On its own, so that the join can split a frequent cell's partition.
        sizes = materialise(copies.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sizes")
        want = copies.join(sizes, "cell").select("one.*", "k", F.col("cell").alias("group"))
        want = materialise(want.select(*ready[0].columns), "intervals")
        ready.append(want.where(F.col("k") <= large))
    small = reduce(DataFrame.unionByName, ready)
    bins = max(16, small.count() // 400)
    arrays = _fetch(_with_texts(docs, small)).groupBy(F.pmod(F.xxhash64("group"), F.lit(bins)).alias("k")).applyInPandas(_resolve, "gram long, part long, a long, b long")
    return reduce(DataFrame.unionByName, found, arrays)


def hash_bytes(raw: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _small(df: DataFrame, entries: str) -> DataFrame:
    total = df.agg(F.sum(F.size(entries)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= BROADCAST_ENTRIES else df


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, removed, kept)`` for every row; ``removed`` lists (start, end) of the
    maximal removed runs, ``kept`` is what remains, as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    grams = _anchor_rows(docs, False).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    grams = materialise(grams, "grams")  # on its own, so that the join below can split a frequent gram's partition
    occ = materialise(_anchor_rows(docs, True).join(grams, "gram"), "occurrences")

    rep = F.min(F.struct("_id", "_hash", "pos", "lm", "rm"))
    parts = materialise(occ.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("c"), rep.alias("rep")), "slices")
    several = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    several = materialise(several, "several")  # on its own, for the same reason
    whole = parts.where("c > 1").select("gram", "part", F.col("rep.lm").cast("long").alias("a"), F.col("rep.rm").cast("long").alias("b"))
    rep = {c: F.col(f"rep.{c}") for c in ("_id", "_hash", "pos")}
    want = parts.join(several, "gram").select(rep["_id"].alias("_id"), rep["_hash"].alias("_hash"), "gram", "part", rep["pos"].alias("pos"), F.lit(0).cast("long").alias("lo"), F.lit(MARGIN).cast("long").alias("hi"), F.col("gram").alias("group"), "k")
    found = _settle(docs, materialise(want, "slices-open"), large)
    stretch = whole.unionByName(found).groupBy("gram", "part").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    stretch = materialise(stretch, "stretches")

    cuts = occ.join(stretch, ["gram", "part"]).select("_id", "_hash", F.struct((F.col("pos") - F.col("a")).alias("lo"), (F.col("pos") + GRAM + F.col("b")).alias("hi")).alias("cut"))
    # Repeated rows (same id and text) bring the same cuts; a set keeps the list within the text's own anchors.
    cuts = cuts.groupBy(_row().alias("_crow")).agg(F.collect_set("cut").alias("cuts"))
    cuts = materialise(cuts, "cuts")
    rows = docs.join(_small(cuts, "cuts"), _row() == F.col("_crow"), "left").select("_id", "_text", "cuts")
    kind = dict(docs.dtypes)["_id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in X.slices(batch, "_text"):
                sizes, gone, runs, kept = [], [], [], []
                for text, cut in zip(X.column(part, "_text").to_pylist(), X.column(part, "cuts").to_pylist(), strict=True):
                    raw = text.encode()
                    merged: list[list[int]] = []
                    for lo, hi in sorted((c["lo"], c["hi"]) for c in cut or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        else:
                            merged.append([lo, hi])
                    edges = [0, *[x for m in merged for x in m], len(raw)]
                    sizes.append(len(raw))
                    gone.append(sum(b - a for a, b in merged))
                    runs.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([X.column(part, "_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pair), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return rows.mapInArrow(apply, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:bigint,end:bigint>>, kept binary")
