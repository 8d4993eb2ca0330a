"""Secret scan: three base patterns plus a linear-chain conditional random field.

A *token* is a maximal run of ``[A-Za-z0-9+/_-]``, with one or two ``=`` at its end.  The field tags each token B (a secret begins), I (inside) or O
(outside) from its shape, the neighbouring words and separators, and features of the whole text; the best path is
found by Viterbi.  A token that is far from any key word (none in the ``NEAR`` bytes before it) and has no secret-like
shape (8 or more characters with a digit, or 20 or more that mix cases) is O on every path, and so is one of fewer than
``SHORTEST`` characters.  The chain falls apart at such tokens, so only the runs between them need to be decoded; the
result is that of decoding the whole text.  Next to a key word every token is left to the weights.

The field is fitted on the driver to texts that a seeded generator writes from the templates below (assignments,
headers, prefixed keys, and look-alikes that are no secrets); the weights (a table of fixed size) are broadcast.

Defined results: null counts as empty and has no spans; spans are in code points, end exclusive; repeated rows give
repeated results; an empty table gives an empty result; no text is cut; extra columns pass through."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .common import fresh

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")

# Words that announce a secret, and parts of them that a text must hold to be searched for them.
KEY_WORD = re.compile(rb"(?i)pass(?:word|wd|phrase|code)|\bpwd\b|secret|token|api[ _-]?key|(?:private|access|license)[ _-]?key|credential|bearer|\bauth|\blog ?in\b|\bkey\b")
KEY_PARTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"login", b"log in")

B, I, O = 0, 1, 2
DIM = 1 << 13
CONTEXT = 48
NEAR = 40
SHORTEST = 4
NEG = -1e9

_TOK = re.compile(rb"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_TOKEN = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-":
    _TOKEN[_c] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = _DIGIT.copy()
_HEX[97:103] = True


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs that do not cross rows."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def secret_shape(token: str | bytes) -> bool:
    """8 or more characters with a digit, or 20 or more that mix cases."""
    t = token.decode() if isinstance(token, bytes) else token
    n = len(t)
    return n >= 8 and any(c.isdigit() for c in t) or n >= 20 and t != t.lower() and t != t.upper()


def after_key_words(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges in which a token that starts there is near a key word."""
    low = raw.lower()
    if not any(p in low for p in KEY_PARTS):
        return []
    return [(m.end(), m.end() + NEAR) for m in KEY_WORD.finditer(raw)]


def open_tokens(raw: bytes) -> list[tuple[int, int]]:
    """The tokens of a text that may be part of a secret."""
    near = after_key_words(raw)
    out, k = [], 0
    for m in _TOK.finditer(raw):
        a, b = m.span()
        while k < len(near) and near[k][1] < a:
            k += 1
        if b - a >= SHORTEST and (k < len(near) and near[k][0] <= a or secret_shape(m[0])):
            out.append((a, b))
    return out


def _f(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % DIM


def file_features(raw: bytes) -> list[int]:
    kb = max(len(raw), 200) / 1000
    marks = sum(raw.count(c) for c in (b"=", b"{", b";", b":"))
    digits = sum(raw.count(str(d).encode()) for d in range(10))
    return [_f("file.marks", min(int(marks / kb), 8)), _f("file.digits", min(int(digits / kb / 10), 8)), _f("file.lines", min(int(raw.count(b"\n") / kb), 8))]


def token_features(before: str, token: str, after: str, of_file: list[int]) -> list[int]:
    """Active features of a token; ``before`` and ``after`` are the text around it."""
    up, low = sum("A" <= c <= "Z" for c in token), sum("a" <= c <= "z" for c in token)
    dig, n = sum("0" <= c <= "9" for c in token), len(token)
    shape = re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", token)))
    turns = sum(a != b for a, b in zip(shape, shape[1:], strict=False))
    words = re.findall(r"[^\W\d_]+", before.lower())
    follow = re.search(r"[^\W\d_]+", after.lower())
    gap = re.search(r"[^\w]*$", before)[0][-4:]
    classes = f"{up > 0:d}{low > 0:d}{dig > 0:d}{n > up + low + dig:d}"
    keys = list(KEY_WORD.finditer(before.encode()))
    key = keys[-1][0].lower().decode() if keys else ""
    between = re.findall(r"[^\W\d_]+", before.encode()[keys[-1].end() :].decode("utf-8", "ignore").lower()) if keys else []
    vowels, hard = sum(c in "aeiouyAEIOUY" for c in token), max(map(len, re.findall(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+", token)), default=0)
    out = [
        _f("bias", 1),
        _f("shape", re.sub(r"(.)\1+", r"\1", shape)[:6]),
        _f("classes", classes),
        _f("length", min(n // 4, 12)),
        _f("digits", dig * 8 // n),
        _f("turns", turns * 8 // n),
        _f("classes.length", (classes, min(n // 8, 6))),
        _f("classes.turns", (classes, turns * 4 // n)),
        _f("hex", not token.strip("0123456789abcdef")),
        _f("prefix", token[:3].lower() if "_" in token[:5] or "-" in token[:5] else ""),
        _f("gap", re.sub(r"\s+", " ", gap)),
        _f("right", after[:1] if not after[:1].isalnum() else "a"),
        _f("next", follow[0] if follow else ""),
        _f("key", key),
        _f("between", " ".join(between[:3]) if keys else "none"),
        _f("apart", (min(len(between), 4), bool(keys), gap.strip()[:2])),
        _f("apart.classes", (min(len(between), 3), bool(keys), classes, min(n // 4, 5))),
        _f("size.classes", (classes, min(n, 24))),
        _f("vowels", (classes, vowels * 6 // n)),
        _f("hard", (classes, min(hard, 7))),
        _f("closed", (token.lower() == token, n >= 12, min(len(between), 2), bool(keys))),
    ]
    out += [_f(f"prev{k}", words[-k]) for k in (1, 2) if len(words) >= k]
    return out + of_file


class Field:
    """Weights and inference of the field."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((DIM, 3)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move
        self.mask = np.array([[0, 0, 0], [0, 0, 0], [0, NEG, 0]])  # O is never followed by I

    def scores(self, seq: list[list[int]], open_: list[bool]) -> np.ndarray:
        e = np.array([self.emit[f].sum(axis=0) for f in seq])
        e[~np.array(open_), :2] = NEG
        return e

    def viterbi(self, e: np.ndarray) -> list[int]:
        m = self.move + self.mask
        best, back = e[0] + m[O], []
        for row in e[1:]:
            t = best[:, None] + m
            back.append(t.argmax(axis=0))
            best = t.max(axis=0) + row
        tags = [int((best + m[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def step(self, seq: list[list[int]], open_: list[bool], tags: list[int], grad_e: dict, grad_m: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood of one sequence (forward-backward)."""
        e, m, n = self.scores(seq, open_), self.move + self.mask, len(seq)
        fw, bw = np.empty((n, 3)), np.empty((n, 3))
        fw[0] = e[0] + m[O]
        for i in range(1, n):
            fw[i] = np.logaddexp.reduce(fw[i - 1][:, None] + m, axis=0) + e[i]
        bw[-1] = m[:, O]
        for i in range(n - 2, -1, -1):
            bw[i] = np.logaddexp.reduce(m + (e[i + 1] + bw[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(fw[-1] + bw[-1])
        for i in range(n):
            d = -np.exp(fw[i] + bw[i] - z)
            d[tags[i]] += 1
            if np.abs(d).max() > 1e-4:
                for f in seq[i]:
                    grad_e[f] = grad_e.get(f, 0) + d
        path = [O, *tags, O]
        for a, b in zip(path, path[1:], strict=False):
            grad_m[a, b] += 1
        grad_m[O] -= np.exp(m[O] + e[0] + bw[0] - z)
        grad_m[:, O] -= np.exp(fw[-1] + m[:, O] - z)
        for i in range(1, n):
            grad_m -= np.exp(fw[i - 1][:, None] + m + (e[i] + bw[i])[None, :] - z)


# The templates of the generated training texts.  {v} is a secret, {n} a look-alike that is none.
KEYS = ["password", "passwd", "secret", "token", "api_key", "apikey", "access key", "client_secret", "auth", "private_key", "credential", "pwd"]
WITH_SECRET = ['{k} = "{v}"', "{k}: {v}", "{k}={v}", '"{k}": "{v}"', "Authorization: Bearer {v}", "export {K}={v}", "--{k} {v}", "{k} is {v}", "your {k} {v}", "{k} {v} expires", "x-{k}: {v}", "login with {k} '{v}'", "key {v}", "{w} ghp_{a}", "{w} sk-{a}", "{w} xoxb-{a}", "{v}.{v}.{v}"]
WITH_WEAK = ["{k} is {s}", "your {k} is {s}", "the {k} is {s} .", "login with {k} {s}", "login with {k} '{s}'", "use {k} {s} to enter", "{k}: {s}", "my {k} was {s}", "{k} = {s}", "set the {k} to {s}", "with the {k} {s}", "new {k} {s}", "{K}={s}", "{k} -> {s}", "{k} ({s})"]
AROUND_KEYS = ["the {k} was {w}", "{k} is {w}", "{k} {w}", "forgot the {k} {w}", "change your {k} {w} {w}", "{k} policy for {w}", "a {k} of {w}", "no {k} needed", "{k} required", "the {k} is required", "the {k} has expired", "enter {k} here", "{k} and {w}", "{k} must be long", "in the {k} of {w} {w}", "reset {k} at {u}", "{k} on {d}", "{k} number {c}", "{k} see page {y}", "{k} {ver}", "{k} for {m}"]
WITHOUT = ["call {p}", "from {ip}", "card {c}", "on {d}", "mail {m}", "version {ver}", "see {u}", "order = {c}", "id: {i}", "isbn {isbn}", "page {i}", "{L}", "{h}", "{w} {c} {w}", "{C}", "commit {i}", "{y}-{y}", "{w}{i}"]


def generated(seed: int = 11, count: int = 700) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of the secrets in them."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda s: s[int(r.integers(len(s)))]
    some = lambda alphabet, lo, hi: "".join(pick(alphabet) for _ in range(int(r.integers(lo, hi))))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]) for _ in range(int(r.integers(1, 5))))
    alnum = lower + lower.upper() + digits
    strong = [lambda: some(alnum, 16, 44), lambda: some(alnum + "+/", 20, 44) + pick(["", "=", "=="]), lambda: some(digits + "abcdef", 16, 64), lambda: some(lower + digits, 16, 40), lambda: some(alnum + "_-", 20, 44), lambda: some(lower.upper() + digits, 16, 32)]

    secret = lambda: pick(strong)()
    phrase = lambda: "".join(word() for _ in range(int(r.integers(3, 6))))

    def weak() -> str:
        """What people choose: short, or without digits."""
        kind = int(r.integers(6))
        if kind == 0:
            return some(alnum, 6, 14)
        if kind == 1:
            return (phrase() + "correct")[: int(r.integers(13, 30))]
        if kind == 2:
            return "-".join(word() + pick(lower) for _ in range(4))
        if kind == 3:
            return "".join(c.upper() if r.random() < 0.5 else c for c in some(lower, 8, 18))
        if kind == 4:
            return word().title() + num(int(r.integers(2, 5)))
        return some(lower, 10, 24)

    num = lambda n: some(digits, n, n + 1)
    other = {
        "p": lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", "ip": lambda: ".".join(num(2) for _ in range(4)), "c": lambda: num(int(r.integers(8, 20))), "d": lambda: f"20{num(2)}-0{num(1)}-1{num(1)}T1{num(1)}", "m": lambda: f"{word()}.{num(2)}@mail{num(1)}.example.com",
        "ver": lambda: f"v{num(1)}.{num(2)}.{num(1)}-rc{num(1)}", "u": lambda: f"https://{word()}.example.org/{word()}/{num(6)}/{word()}-{word()}-{num(4)}", "i": lambda: num(int(r.integers(4, 12))), "isbn": lambda: f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", "L": lambda: "".join(word() for _ in range(4)),
        "h": lambda: "-".join(word() for _ in range(int(r.integers(3, 6)))), "C": lambda: "".join(word().title() for _ in range(5)), "y": lambda: "20" + num(2), "w": word, "k": lambda: pick(KEYS), "s": weak, "K": lambda: pick(KEYS).upper().replace(" ", "_"), "v": secret, "a": lambda: some(alnum, 24, 40),
    }
    for _ in range(count):
        text, spans = "", []
        prose = int(pick([2, 2, 10, 40]))  # from dense files to prose with a secret here and there
        for _ in range(int(r.integers(3, 7))):
            text += " ".join(word() for _ in range(int(r.integers(prose, 4 * prose)))) + pick([" ", "\n", ". ", " | ", "### "])
            part = pick(pick([WITH_SECRET, WITH_WEAK, WITHOUT, WITHOUT, AROUND_KEYS]))
            jwt = part.count("{v}") > 1
            began = len(text)
            for lit, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", part):
                text += lit
                if name:
                    value = other[name]()
                    if name in "vas" and not jwt:
                        at = len(text) - (len(re.search(r"[\w-]*$", lit)[0]) if name == "a" else 0)
                        spans.append((at, len(text) + len(value)))
                    text += value
            if jwt:
                spans.append((began, len(text)))
            text += pick([" ", "\n", ", ", ". ", "*** ", "!! "])
        yield text, spans


def sequence(text: str) -> tuple[list[list[int]], list[bool], list[tuple[int, int]]]:
    """Features, openness and byte span of each token of a whole text."""
    raw = text.encode()
    of_file, ready = file_features(raw), set(open_tokens(raw))
    at = [m.span() for m in _TOK.finditer(raw)]
    return [_features(raw, a, b, of_file) for a, b in at], [x in ready for x in at], at


def _features(raw: bytes, a: int, b: int, of_file: list[int]) -> list[int]:
    return token_features(raw[max(0, a - CONTEXT) : a].decode("utf-8", "ignore"), raw[a:b].decode(), raw[b : b + CONTEXT].decode("utf-8", "ignore"), of_file)


def fit(seed: int = 11, count: int = 700, epochs: int = 5, rate: float = 0.3) -> Field:
    """Stochastic gradient ascent on the penalised likelihood of the generated texts."""
    data = []
    for text, spans in generated(seed, count):
        raw = text.encode()
        of_file, ready, at = file_features(raw), set(open_tokens(raw)), [m.span() for m in _TOK.finditer(raw)]
        open_ = [x in ready for x in at]
        tags: list[int] = []
        for (a, b), ok in zip(at, open_, strict=True):
            hit = next((s for s in spans if s[0] <= a and b <= s[1] + 1), None)
            tags.append(O if hit is None or not ok else B if a == hit[0] or O in tags[-1:] or not tags else I)
        keep = [i for i in range(len(at)) if any(open_[max(0, i - 1) : i + 2])]  # closed tokens far from open ones are O on any path
        data.append(([_features(raw, *at[i], of_file) for i in keep], [open_[i] for i in keep], [tags[i] for i in keep]))
    field, ge, gm = Field(), np.full((DIM, 3), 1e-2), np.full((3, 3), 1e-2)
    order = np.random.Generator(np.random.PCG64(seed + 1))
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            if not data[k][0]:
                continue
            de, dm = {}, np.zeros((3, 3))
            field.step(*data[k], de, dm)
            idx = np.fromiter(de, np.int64, len(de))
            if len(idx):
                d = np.array([de[i] for i in idx]) - 1e-3 * field.emit[idx]
                ge[idx] += d * d
                field.emit[idx] += rate * d / np.sqrt(ge[idx])
            gm += dm * dm
            field.move += rate * dm / np.sqrt(gm)
    return field


def crf_spans(field: Field, raw: bytes, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of secrets, from the open tokens ``at`` of a text (byte positions)."""
    of_file = file_features(raw)
    out: list[list[int]] = []
    chain: list[tuple[int, int]] = []

    def flush() -> None:
        seq = [_features(raw, a, b, of_file) for a, b in chain]
        for (a, b), tag in zip(chain, field.viterbi(field.scores(seq, [True] * len(seq))), strict=True):
            if tag == B:
                out.append([a, b])
            elif tag == I:
                out[-1][1] = b

    for a, b in at:
        if chain and _TOKEN[np.frombuffer(raw[chain[-1][1] : a], np.uint8)].any():  # another token between: O on every path
            flush()
            chain = []
        chain.append((a, b))
    if chain:
        flush()
    return [(a, b) for a, b in out]


def scan_batch(field: Field, col: pa.Array) -> list[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of all spans of each row, by start and kind."""
    data, offsets = X.buffers(col)
    raw = data.tobytes()
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_DIGIT[data], out=digits[1:])
    s, e = runs(_TOKEN[data], offsets)
    size = e - s
    shaped = np.zeros(len(offsets) - 1, bool)  # rows that may hold a token of secret-like shape
    shaped[X.doc_of(offsets, s[(size >= 8) & (digits[e] > digits[s]) | (size >= 20)])] = True
    hs, he = runs(_HEX[data], offsets)
    has_hex = np.zeros(len(offsets) - 1, bool)
    has_hex[X.doc_of(offsets, hs[he - hs >= 24])] = True
    out = []
    for d, (o, p) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = raw[o:p]
        low = own.lower()
        announced = any(w in low for w in KEY_PARTS)
        text = own.decode() if has_hex[d] or b"AKIA" in own or announced else ""
        found = base_spans(text) if text else []
        tokens = open_tokens(own) if shaped[d] or announced else []
        spans = crf_spans(field, own, tokens) if tokens else []
        if spans:
            chars = np.r_[0, np.cumsum((data[o:p] & 0xC0) != 0x80)]  # characters before each byte position
            taken = np.zeros(int(chars[-1]) + 1, np.int64)
            for u, _, v in found:
                taken[u] += 1
                taken[v] -= 1
            taken = np.r_[0, np.cumsum(np.cumsum(taken) > 0)]  # characters of base spans before each position
            at = chars[np.array(spans)].tolist()
            found = sorted(found + [(x, 3, y) for x, y in at if taken[x] == taken[y]])
        out.append(found)
    return out


def scan_secrets(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with ``secrets``: an array of (kind, start, end, value) in the order of start and kind."""
    model = field or fit()
    weights = df.sparkSession.sparkContext.broadcast((model.emit.astype(np.float32), model.move))
    df = df.drop("secrets")
    (text,) = fresh(df, "_text")
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    schema = T.StructType([*df.schema.fields, T.StructField("secrets", T.ArrayType(kind))])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*weights.value)
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            for part in X.slices(batch, text):
                col = X.column(part, text)
                texts = {}
                found = scan_batch(f, col)
                for i, spans in enumerate(found):
                    if spans:
                        texts[i] = col[i].as_py()
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "value": texts[i][a:b]} for a, k, b in spans] for i, spans in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*[X.column(part, n) for n in names], pa.array(rows, arrow)], names=[*names, "secrets"])

    return df.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)
