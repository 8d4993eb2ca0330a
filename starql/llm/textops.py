"""Vectorised text primitives on Arrow columns: byte buffers, words, 64-bit word and n-gram hashes.

A *word* is a maximal run of ASCII letters, digits or bytes of non-ASCII characters in the lower-cased text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SLICE_BYTES

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_MULT = _rng.integers(1, 1 << 63, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    WORD_BYTE[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 1)
        got = np.full(size, base, U64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = got
    return got[:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows so that each part has about ``limit`` bytes of text; rows are never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def buffers(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row number of each byte position."""
    return np.searchsorted(offsets, at, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses two rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = WORD_BYTE[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = w[edges]
    last = w.copy()
    last[:-1] &= ~w[1:]
    edges = edges[edges > 0]
    last[edges - 1] = w[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, doc_of(offsets, starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a polynomial over random byte codes."""
    if not len(starts):
        return np.zeros(0, U64)
    acc = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * _power(_BASE, len(data)), out=acc[1:])
    h = (acc[ends] - acc[starts]) * _power(_BASE_INV, len(data))[starts]
    return mix(h)


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word index of every run of ``n`` words within one row.

    ``short``: a row with 1 to n-1 words gives one n-gram of all its words."""
    m = len(hashes) - n + 1
    if m > 0:
        ok = np.flatnonzero(rows[: m] == rows[n - 1 :])
        out = np.zeros(len(ok), U64)
        for k in range(n):
            out = (out + hashes[ok + k]) * _MULT[k]
        got, who, at = mix(out), rows[ok], ok
    else:
        got, who, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short and len(hashes):
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(np.r_[heads, len(rows)])
        few = heads[sizes < n]
        if len(few):
            size = sizes[sizes < n]
            out = np.zeros(len(few), U64)
            for k in range(n - 1):
                there = size > k
                out[there] = (out[there] + hashes[few[there] + k]) * _MULT[k]
            got, who, at = np.r_[got, mix(out + size.astype(U64))], np.r_[who, rows[few]], np.r_[at, few]
            order = np.argsort(who, kind="stable")
            got, who, at = got[order], who[order], at[order]
    return got, who, at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
