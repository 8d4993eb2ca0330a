"""Language-model scoring: stupid backoff over word n-grams of the whole corpus, computed relationally.

Words and n-grams are keyed by 64-bit hashes; every count table is hash-partitioned and grows with the corpus.
The score of word w after the ``order`` - 1 words before it (fewer at the start of a text) is count(context w) / count(context)
if that n-gram is seen, else ``ALPHA`` times the score of w after the context without its first word, down to count(w) / N.  A
text's score is the sum of logarithms.  With ``leave_one_out`` the occurrence that is scored is taken off n-gram and context, so
an n-gram is seen if it stands anywhere else in the corpus; count(w) / N keeps it, so no score is infinite.  Without, every
n-gram of the corpus is seen, and nothing backs off.

1. The words N of all texts are counted.
2. Each slice of the input sends its distinct words and n-grams with their counts, packed, to ranges of the hash.  A range
   adds up its counts and answers each slice in the order of its keys.
3. Answers meet the texts of their slice, which are read a second time for that (sending them along with the keys would
   take them through two shuffles), and are scored there.  No more than a slice of texts or a range of keys is ever in one
   task, and both are sized by parameters, not by the data's groups: a key comes once from a slice, however frequent.

Both reads must see the same rows in the same tasks, as file scans do; an input with a shuffle in its plan is written to
the shared folder first, and every slice carries a digest of its texts, so a difference is an error and no wrong score.

Defined results: a null or wordless text has no words and score 0; repeated rows are scored each and count in the
corpus each; ids may be null or repeated; an empty table gives an empty result; extra columns are not carried."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .common import SLICE_BYTES, materialise

ALPHA = 0.4
#: Keys of one hash partition, at most.
PER_PARTITION = 2_000_000
#: Text bytes of a slice: the larger it is, the fewer keys are sent.
SLICE = 8 * SLICE_BYTES


def word_ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word."""
    data, offsets = X.buffers(col, lower=True)
    s, e, rows = X.words(data, offsets)
    return X.span_hashes(data, s, e), rows


def grams(w: np.ndarray, rows: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length up to ``order``: the hashes of all n-grams, and the index of the last word of each."""
    found = [(w, np.arange(len(w)))]
    for k in range(2, order + 1):
        code, _, at = X.ngrams(w, rows, k)
        found.append((code, at + k - 1))
    return [c for c, _ in found], [e for _, e in found]


def count_words(docs: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in X.slices(batch, "_text"):
                n += len(X.words(*X.buffers(X.column(part, "_text"), lower=True))[0])
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return int(docs.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)


def _planes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(raw: np.ndarray, m: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, m).T).view(kind)[:, 0] if m else np.zeros(0, kind)


def pack(code: np.ndarray, *columns: np.ndarray) -> bytes:
    """Entries sorted by code: differences of codes and columns (of 32 bits) in byte planes; then deflated."""
    order = np.argsort(code, kind="stable")
    raw = _planes(np.diff(code[order].astype("<i8"), prepend=np.int64(0)), "<i8") + b"".join(_planes(c[order], "<u4") for c in columns)
    return struct.pack("<I", len(code)) + zlib.compress(raw, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    m = struct.unpack("<I", blob[:4])[0]
    raw = np.frombuffer(zlib.decompress(blob[4:]), np.uint8)
    return np.cumsum(_whole(raw[: 8 * m], m, "<i8")), *(_whole(raw[a : a + 4 * m], m, "<u4").astype(np.int64) for a in range(8 * m, len(raw), 4 * m or 1))


def pack_texts(texts: pa.Array) -> tuple[bytes, list[int]]:
    data, offsets = X.buffers(texts)
    return pa.Codec("zstd", 9).compress(data.tobytes(), asbytes=True), np.diff(offsets).tolist()


def unpack_texts(blob: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype("<i8")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.Codec("zstd").decompress(blob, int(offsets[-1])))


def keys(texts: pa.Array, order: int, partitions: int) -> list[tuple[int, bytes]]:
    """The distinct n-grams of a slice with their counts, packed for each range of the hash in ascending order."""
    code, n = np.unique(np.concatenate(grams(*word_ids(texts), order)[0]), return_counts=True)
    p = ((code >> X.U64(32)) * X.U64(partitions) >> X.U64(32)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(p)]
    return [(int(p[a]), pack(code[a:b], n[a:b])) for a, b in zip(heads, ends, strict=True)]


def add_counts(blobs: list[bytes]) -> list[bytes]:
    """For each packed slice: the counts of its keys over all slices, in the order of the keys."""
    parts = [unpack(b) for b in blobs]
    _, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([x[1] for x in parts])).astype(np.int64)[inverse]
    ends = np.cumsum([len(x[0]) for x in parts])
    return [zlib.compress(_planes(c, "<u8"), 6) for c in np.split(count, ends[:-1])]


def unpack_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return _whole(raw, len(raw) // 8, "<u8").astype(np.int64)


def score_slice(texts: pa.Array, counts: np.ndarray, order: int, total: int, leave_one_out: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words and score of each row of a slice, from the corpus counts of its distinct n-grams."""
    w, rows = word_ids(texts)
    codes, last = grams(w, rows, order)
    _, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    each = np.split(counts[inverse], np.cumsum([len(c) for c in codes])[:-1])
    own = int(leave_one_out)
    score, context = np.log(np.maximum(each[0], 1)) - np.log(total), each[0]
    for count, e in zip(each[1:], last[1:], strict=True):
        seen = np.log(np.maximum(count - own, 1)) - np.log(np.maximum(context[e - 1] - own, 1))
        score[e] = np.where(count > own, seen, np.log(ALPHA) + score[e])
        context = np.zeros(len(w), np.int64)
        context[e] = count
    return np.bincount(rows, minlength=len(texts)), np.bincount(rows, score, len(texts))


def _numbered_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, int]]:
    """Number (task and place in it) and digest of each slice."""
    task, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in X.slices(batch, "_text", SLICE):
            data, offsets = X.buffers(X.column(part, "_text"))
            digest = hashlib.blake2b(data.tobytes() + offsets.tobytes(), digest_size=8).digest()
            yield task << 32 | nth, part, int.from_bytes(digest, "little", signed=True)
            nth += 1


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, leave_one_out: bool = True) -> DataFrame:
    """``(id_col, n_words, log_score)`` for every row."""
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialise(docs, "texts")
    total = max(count_words(docs), 1)
    partitions = max(8, -(-order * total // PER_PARTITION))
    kind = dict(docs.dtypes)["_id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, digest in _numbered_slices(batches):
            cells = keys(X.column(part, "_text"), order, partitions)
            m = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int64()), pa.array([number] * m, pa.int64()), pa.array([digest] * m, pa.int64()), pa.array([c[1] for c in cells], pa.binary())], names=["p", "slice", "digest", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, digest in _numbered_slices(batches):
            blob, sizes = pack_texts(X.column(part, "_text"))
            ids = X.column(part, "_id")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([digest], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["slice", "digest", "ids", "sizes", "blob"])

    schema = "p long, slice long, digest long, blob binary"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(blob=add_counts(pdf["blob"].tolist()))

    def score(cells: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if len(heads) != 1 or (cells["digest"] != heads["digest"].iloc[0]).any():
            raise RuntimeError("the texts changed between two reads")
        head = heads.iloc[0]
        counts = np.concatenate([np.zeros(0, np.int64), *map(unpack_counts, cells.sort_values("p")["blob"])])
        words, value = score_slice(unpack_texts(head["blob"], head["sizes"]), counts, order, total, leave_one_out)
        return pd.DataFrame({id_col: pd.Series(list(head["ids"]), dtype=object), "n_words": words.astype(np.int64), "log_score": value})

    answers = docs.mapInArrow(emit, schema).groupBy("p").applyInPandas(count, schema)
    texts = docs.mapInArrow(send, f"slice long, digest long, ids array<{kind}>, sizes array<bigint>, blob binary")
    return answers.groupBy("slice").cogroup(texts.groupBy("slice")).applyInPandas(score, f"`{id_col}` {kind}, n_words long, log_score double")
