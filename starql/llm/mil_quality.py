"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` white-space separated words.  Each passage becomes a feature vector
(shares of byte classes, word-length statistics, repetition within the passage and the document), which a layer of
``tanh`` units encodes.  Gated attention (``tanh`` times ``sigmoid``, a softmax over the passages of a document) gives
each passage a weight; the score is a logistic function of the weighted sum of the passage codes.  All weights are
learned jointly from the labels of documents, by Adam with hand-written gradients.

Fitted to a bounded sample: at most ``sample`` labelled rows that are not held out, of texts up to ``longest``
characters (for the fit only), those with the lowest id hash.  Every document is scored on its whole text.

Defined results: a null or empty text is one passage of zeros and gets a score like any other; if there is no label
or only one class to learn from, the score is the share of label 1 (0.5 without labels); several labels of one id
count by their mean, labels that are null do not count; of several rows with one id, the least text is learned from; repeated rows are scored each; extra columns pass through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .common import bounded_sample, is_held_out, sent_text

WORDS = 48
SAMPLE = 6000
LONGEST = 60_000
THRESHOLD = 0.7

_CLASS = np.full(256, 31, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 5
for _i, _c in enumerate(b".,!?|#$%&*@:;\"'()-_/=<>{"):
    _CLASS[_c] = 6 + _i
N_CLASS = 32
N_FEATURES = N_CLASS + 11


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (one row each) and the text each belongs to.  Each text has at least one passage."""
    data, offsets = X.buffers(col)
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros((n_rows, N_FEATURES), np.float32), np.arange(n_rows)
    word = data > 32
    starts, ends, rows = _words(word, offsets)
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    heads = np.flatnonzero(nth % WORDS == 0)
    empty = np.setdiff1d(np.arange(n_rows), rows)
    owner = rows[heads]
    edge = np.r_[starts[heads], len(data)]
    stop = np.minimum(edge[1:], offsets[owner + 1])
    x = np.zeros((len(heads), N_FEATURES), np.float32)
    if len(heads):
        pid = np.repeat(np.arange(len(heads)), stop - edge[:-1])
        at = np.concatenate([np.arange(a, b) for a, b in zip(edge[:-1], stop, strict=True)]) if len(empty) or (stop != edge[1:]).any() else np.arange(edge[0], edge[-1])
        hist = np.bincount(pid * N_CLASS + _CLASS[data[at]], minlength=len(heads) * N_CLASS).reshape(-1, N_CLASS)
        size = np.maximum(stop - edge[:-1], 1)
        x[:, :N_CLASS] = np.sqrt(hist / size[:, None])
        wp = np.searchsorted(heads, np.arange(len(rows)), side="right") - 1
        length = (ends - starts).astype(float)
        count = np.bincount(wp, minlength=len(heads))
        mean = np.bincount(wp, length, len(heads)) / count
        x[:, N_CLASS] = mean / 10
        x[:, N_CLASS + 1] = np.sqrt(np.maximum(np.bincount(wp, length**2, len(heads)) / count - mean**2, 0)) / 10
        x[:, N_CLASS + 2] = np.bincount(wp, length <= 3, len(heads)) / count
        x[:, N_CLASS + 3] = count / WORDS
        h = X.span_hashes(data, starts, ends)
        x[:, N_CLASS + 4] = _distinct(wp, h, len(heads)) / count
        per_row = np.bincount(rows, minlength=n_rows)
        x[:, N_CLASS + 5] = (_distinct(rows, h, n_rows) / np.maximum(per_row, 1))[owner]
        x[:, N_CLASS + 6] = np.log1p(per_row)[owner] / 8
        ls, le, lr = _words(data != 10, offsets)
        lines = np.maximum(np.bincount(lr, minlength=n_rows), 1)
        x[:, N_CLASS + 7] = (_distinct(lr, X.span_hashes(data, ls, le), n_rows) / lines)[owner]
        x[:, N_CLASS + 8] = np.log1p(lines)[owner] / 5
        last = data[ends - 1]
        mark = ~((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57) | (last >= 128))
        x[:, N_CLASS + 9] = np.bincount(wp, mark, len(heads)) / count
        x[:, N_CLASS + 10] = _distinct(wp, h >> X.U64(58), len(heads)) / np.minimum(count, 64)
    if len(empty):
        x, owner = np.r_[x, np.zeros((len(empty), N_FEATURES), np.float32)], np.r_[owner, empty]
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
    return x, owner


def _words(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(mask)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, X.doc_of(offsets, starts)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values in each group."""
    key = np.sort(_pair(group, value))
    head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return np.bincount((key[head] >> X.U64(40)).astype(np.int64), minlength=n)


def _pair(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Group in the high 24 bits, 40 bits of the value below (slices have far fewer than 2**24 groups)."""
    return group.astype(X.U64) << X.U64(40) | (value & X.U64((1 << 40) - 1))


class Attention:
    """Parameters and passes of the network."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, n: int, hidden: int = 24, gate: int = 12, seed: int = 5) -> Attention:
        r = np.random.Generator(np.random.PCG64(seed))
        w = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        return cls({"mean": np.zeros(n), "scale": np.ones(n), "w": w(n, hidden), "b": np.zeros(hidden), "v": w(hidden, gate), "u": w(hidden, gate), "a": w(gate, 1)[:, 0], "c": w(hidden, 1)[:, 0], "d": np.zeros(1)})

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple:
        p = self.p
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, np.searchsorted(doc, np.arange(n)))[doc])  # every document has a passage
        att = e / np.bincount(doc, e, n)[doc]
        z = np.stack([np.bincount(doc, att * h[:, k], n) for k in range(h.shape[1])], axis=1)
        logit = z @ p["c"] + p["d"][0]
        return x, h, t, s, att, z, logit

    def score(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        *_, att, _, logit = self.forward(x, doc, n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), att

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        x, h, t, s, att, z, logit = self.forward(x, doc, n)
        g = (1 / (1 + np.exp(-logit)) - y) / n
        dz = g[:, None] * p["c"]
        dh = att[:, None] * dz[doc]
        da = (h * dz[doc]).sum(axis=1)
        de = att * (da - np.bincount(doc, att * da, n)[doc])
        dt, ds = de[:, None] * p["a"] * s * (1 - t**2), de[:, None] * p["a"] * t * s * (1 - s)
        dh += dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - h**2)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}


def train(x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 240, batch_docs: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Attention:
    """Adam on mini-batches of documents; ``doc`` is sorted and numbers the documents of ``y``."""
    net = Attention.start(x.shape[1])
    net.p["mean"], net.p["scale"] = x.mean(axis=0), x.std(axis=0) + 1e-2
    net.p["d"] += np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    r = np.random.Generator(np.random.PCG64(seed))
    first, last = np.searchsorted(doc, np.arange(len(y))), np.searchsorted(doc, np.arange(len(y)), side="right")
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for i in range(1, steps + 1):
        take = np.sort(r.choice(len(y), min(batch_docs, len(y)), replace=False))
        rows = np.concatenate([np.arange(first[k], last[k]) for k in take])
        local = np.repeat(np.arange(len(take)), last[take] - first[take])
        for k, g in net.gradients(x[rows], local, y[take]).items():
            g = g + decay * net.p[k] * (k not in "bd")
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            net.p[k] -= rate * (1 - 0.8 * i / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.999**i)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Attention | float:
    """The trained network, or a constant score if there is nothing to learn."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    ids = bounded_sample(marks, id_col, F.lit("all"), sample).select(id_col)
    marks = marks.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    text = docs.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) <= longest).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = text.join(F.broadcast(marks), id_col)  # at most `sample` rows are broadcast
    joined = joined.groupBy(id_col, "_y").agg(F.min("_text").alias("_text"))  # of rows with one id, the least text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "_text"):
                x, owner = passages(X.column(part, "_text"))
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([X.column(part, id_col), X.column(part, "_y"), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "y", "x"])

    kind = dict(docs.dtypes)[id_col]
    rows = sorted(joined.mapInArrow(run, f"id {kind}, y int, x binary").collect(), key=lambda r: (r.id, r.x))
    if len({r.y for r in rows}) < 2:
        return sum(r.y for r in rows) / len(rows) if rows else 0.5
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    return train(np.concatenate(x).astype(float), np.repeat(np.arange(len(x)), [len(v) for v in x]), np.array([r.y for r in rows], float))


def score_quality(df: DataFrame, model: Attention | float, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``top_passage`` (number of the passage with the largest attention weight)."""
    df = df.drop("score", "top_passage")
    src, text = sent_text(df, text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("top_passage", T.IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast(model.p if isinstance(model, Attention) else float(model))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Attention(sent.value) if isinstance(sent.value, dict) else None
        for batch in batches:
            for part in X.slices(batch, text):
                n = part.num_rows
                score, top = np.full(n, sent.value if net is None else 0.0), np.zeros(n, np.int32)
                if net is not None:
                    x, owner = passages(X.column(part, text))
                    score, att = net.score(x.astype(float), owner, n)
                    best = np.lexsort((np.arange(len(att)), -att, owner))
                    heads = best[np.searchsorted(owner, np.arange(n))]
                    top = (heads - np.searchsorted(owner, np.arange(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[X.column(part, c) for c in names], pa.array(score, pa.float64()), pa.array(top, pa.int32())], names=[*names, "score", "top_passage"])

    return src.mapInArrow(run, schema)
