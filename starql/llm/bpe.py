"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text where its content says so, so a passage that stands in many
documents is cut into the same chunks in all of them.  A chunk is encoded once and its ids are kept under its
digest; later occurrences take them from there.  Where two chunks meet, merges may cross the cut, so a span round the
seam is encoded again.  Its ends are *certain* boundaries where there are some nearby: a space between two characters
that are none is one in every script, as the split pattern cuts before it whatever stands around it.  Elsewhere (no
spaces at all, or very long words) the span is a number of tokens on either side, which doubles until what comes out
agrees at both ends with the tokens that were there.  Inside a run of letters or of digits such agreement is proof: a
sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs.

Where the ids are kept: one store per Python worker, in two generations of ``STORE_BYTES`` of chunks and ids each,
shared by all tasks that the worker runs.  Nothing is shuffled, and a lost executor only loses a store that refills by
itself.  A chunk that comes again after more than two generations, or in another worker, is encoded again.

Ids are those of the ``tokenizers`` library for the given file with ``add_special_tokens=False``: strings of added
tokens become their ids, truncation and padding are not applied.  Texts of characters below U+0250 are encoded
by ``tiktoken`` from ranks that are read out of the same file (six times as fast); chunks with any other character
by ``tokenizers`` itself, as the two libraries may hold different Unicode tables there.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text; a row of any length
is encoded whole; repeated rows give repeated results; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops as X
from .common import sent_text

# Fixed values of the byte-level scheme: the pattern that splits text before merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 32
MEAN_CHUNK = 1024
STORE_BYTES = 24 << 20
#: Bytes round a seam that are searched for certain boundaries, and tokens of the first span without them.
NEAR = 256
TOKENS = 8
_ODD = re.compile("[^\x00-\u024f]")
_codecs: dict[str, Codec] = {}


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Codec:
    """Encoder and decoder of one tokenizer file (its content, not its path: workers need no file)."""

    def __init__(self, content: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        back = {c: b for b, c in enumerate(_byte_letters())}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: s.encode() for s, i in self.added.items()}
        ranks = {}
        for piece, i in spec["model"]["vocab"].items():
            if piece not in self.added:
                raw = bytes(back[c] for c in piece)
                ranks[raw] = i
                self.pieces[i] = raw
        self.table = [self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)]
        self.size = [len(p) for p in self.table]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merges]
        self.by_rank = ids == sorted(ids)
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_str(content.decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = self.hits = self.misses = 0

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if self.by_rank and not _ODD.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def chunk(self, raw: bytes) -> list[int]:
        """Ids of a chunk, from the store if it was seen before."""
        name = hashlib.blake2b(raw, digest_size=16).digest()
        got = self.young.get(name)
        if got is None:
            got = self.old.get(name)
            if got is None:
                self.misses += 1
                got = array("i", self.plain(raw.decode())).tobytes()
            else:
                self.hits += 1
            if self.held > STORE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[name] = got
            self.held += len(got) + 150  # with the digest and the two objects
        else:
            self.hits += 1
        return array("i", got).tolist()

    def joined(self, chunks: list[bytes]) -> list[int]:
        """Ids of the concatenation of ``chunks``."""
        if len(chunks) < 2:
            return self.chunk(chunks[0]) if chunks else []
        raw = b"".join(chunks)
        out, at = self.chunk(chunks[0]), len(chunks[0])
        for own in chunks[1:]:
            self._join(out, raw, at, self.chunk(own), at + len(own))
            at += len(own)
        return out

    def _join(self, out: list[int], raw: bytes, seam: int, ahead: list[int], end: int) -> None:
        """Extends ``out``, the ids of ``raw[:seam]``, to those of ``raw[:end]``; ``ahead`` has those of the chunk between."""
        lefts, rights = self._left(out, raw, seam, end), self._right(ahead, raw, seam, end)
        (n, a, sure_a), (m, b, sure_b) = next(lefts), next(rights)
        while True:
            new = self.plain(raw[a:b].decode())
            good_a = sure_a or new[:1] == out[n : n + 1]
            good_b = sure_b or new[-1:] == ahead[m - 1 : m]
            if good_a and good_b:
                out[n:] = new
                out += ahead[m:]
                return
            if not good_a:
                n, a, sure_a = next(lefts)
            if not good_b:
                m, b, sure_b = next(rights)

    def _left(self, ids: list[int], raw: bytes, seam: int, end: int) -> Iterator[tuple[int, int, bool]]:
        """Where a span may begin, from the nearest on: token index, byte position, and whether it is sure."""
        n, at, least = len(ids), seam, 0
        size = self.size
        cut = seam
        while (cut := raw.rfind(b" ", max(1, seam - NEAR), cut)) > 0:
            if certain(raw, cut, end):
                while at > cut:
                    n -= 1
                    at -= size[ids[n]]
                if at == cut:
                    yield n, cut, True
                    break
        n, at, least = len(ids), seam, TOKENS
        while n:
            n -= 1
            at -= size[ids[n]]
            if len(ids) - n >= least and n and inner(raw, at, end):
                yield n, at, False
                least *= 2
        yield 0, 0, True

    def _right(self, ids: list[int], raw: bytes, seam: int, end: int) -> Iterator[tuple[int, int, bool]]:
        n, at = 0, seam
        size = self.size
        cut = seam
        while 0 < (cut := raw.find(b" ", cut + 1, min(end, seam + NEAR))):
            if certain(raw, cut, end):
                while at < cut:
                    at += size[ids[n]]
                    n += 1
                if at == cut:
                    yield n, cut, True
                    break
        n, at, least = 0, seam, TOKENS
        while n < len(ids):
            at += size[ids[n]]
            n += 1
            if n >= least and n < len(ids) and inner(raw, at, end):
                yield n, at, False
                least *= 2
        yield len(ids), end, True

    def encode(self, chunks: list[bytes]) -> list[int]:
        raw = b"".join(chunks) if self.special else b""
        if self.special and any(s.encode() in raw for s in self.added):
            out, text, at = [], raw.decode(), 0
            for m in self.special.finditer(text):
                out += self.joined(cut_chunks(text[at : m.start()].encode())) + [self.added[m[0]]]
                at = m.end()
            return out + self.joined(cut_chunks(text[at:].encode()))
        return self.joined(chunks)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def _char_before(raw: bytes, at: int) -> str:
    a = at - 1
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    return raw[a:at].decode()


def _char_at(raw: bytes, at: int, end: int) -> str:
    b = at + 1
    while b < end and raw[b] & 0xC0 == 0x80:
        b += 1
    return raw[at:b].decode()


def certain(raw: bytes, cut: int, end: int) -> bool:
    """A space at ``cut`` with a character on both sides that is no white space."""
    if not 0 < cut < end - 1:
        return False
    before, after = raw[cut - 1], raw[cut + 1]
    if before < 128 and after < 128:
        return 32 < before < 127 and 32 < after < 127
    return not _blank(_char_before(raw, cut)) and not _blank(_char_at(raw, cut + 1, end))


def _blank(c: str) -> bool:
    """White space, or a character that some Unicode table may count as such."""
    return c.isspace() or unicodedata.category(c)[0] in "CZ"


def inner(raw: bytes, at: int, end: int) -> bool:
    """A character start inside a run of letters, of ASCII digits, or of other printable characters: the split pattern
    goes on across it, whatever comes before.  An apostrophe never begins a span, as it may begin a contraction."""
    before, after = raw[at - 1], raw[at]
    if before < 128 and after < 128:
        return after != 39 and 0 < _KIND[before] == _KIND[after]
    if after & 0xC0 == 0x80:
        return False
    return 0 < _settled(_char_before(raw, at)) == _settled(_char_at(raw, at, end)) and after != 39


#: Of ASCII characters: letter 1, digit 2, other printable 3, else 0.
_KIND = [1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 * (32 < b < 127) for b in range(128)]


def _settled(c: str) -> int:
    """1 for letters and 3 for marks and symbols that are so in the oldest Unicode table here and in the newest, else 0."""
    if ord(c) < 128:
        return _KIND[ord(c)]
    old, new = unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]
    return 1 if old == new == "L" else 3 if old in "PS" and new in "PS" else 0


def cut_points(data: np.ndarray) -> np.ndarray:
    """Content-defined cuts of a byte buffer: where the hash of the last ``WINDOW`` bytes is 0 modulo the mean
    chunk size, moved on to the next character start."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    acc = np.zeros(n + 1, X.U64)
    np.cumsum(X._BYTE_CODE[data] * X._power(X._BASE, n), out=acc[1:])
    h = X.mix((acc[WINDOW:] - acc[:-WINDOW]) * X._power(X._BASE_INV, n)[: n - WINDOW + 1])
    at = np.flatnonzero(h % X.U64(MEAN_CHUNK) == 0) + WINDOW
    for _ in range(3):
        inside = at < n
        at[inside] += (data[at[inside]] & 0xC0) == 0x80
    return np.unique(at[at < n])


def cut_chunks(raw: bytes) -> list[bytes]:
    edges = [0, *cut_points(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]


def codec(content: bytes) -> Codec:
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def _rows_of_chunks(col: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each row.  A cut depends on the 32 bytes before it only, so cuts within 32 bytes of a row's
    start, where the window would reach into the row before, are left out."""
    data, offsets = X.buffers(col)
    raw, cuts = data.tobytes(), cut_points(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = cuts[np.searchsorted(cuts, a + WINDOW) : np.searchsorted(cuts, b)].tolist()
        edges = [a, *own, b]
        yield [raw[x:y] for x, y in zip(edges, edges[1:], strict=False) if y > x]


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the array ``ids_col`` of token ids and, if ``decoded_col`` is given, the text decoded from them
    as ``decode(ids, skip_special_tokens=False)`` gives it.  The file at ``tokenizer_path`` is read by the driver
    and sent to the workers (its size is fixed)."""
    with open(tokenizer_path, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop(ids_col, *([decoded_col] if decoded_col else []))
    src, text = sent_text(df, text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for batch in batches:
            for part in X.slices(batch, text):
                found = [c.encode(chunks) for chunks in _rows_of_chunks(X.column(part, text))]
                cols = [X.column(part, n) for n in names] + [pa.array(found, pa.list_(pa.int32()))]
                if decoded_col:
                    cols.append(pa.array([c.decode(ids) for ids in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, ids_col, *([decoded_col] if decoded_col else [])])

    return src.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; null ids count as none."""
    with open(tokenizer_path, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop(decoded_col)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for batch in batches:
            found = [c.decode(ids or []) for ids in X.column(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, decoded_col])

    return df.mapInArrow(run, schema)
