"""Language identification by multilingual mixture inference.

Each language has a distribution over byte trigrams of lower-cased letters.  A document is a mixture: expectation-
maximisation estimates the language proportions that best explain its trigrams, and the set of languages grows
greedily as long as the penalised likelihood (half the log of the trigram count for each added language, with
the count divided by the trigram length, as overlapping trigrams are not independent) improves.  The prediction
is the language with the largest proportion; its score is that proportion times the posterior of the language
against the other ones.

The distributions are fitted to a bounded sample of at most ``per_language`` labelled rows of each language (those
with the lowest id hash among rows that are not held out), of at most the ``languages`` most frequent labels, and keep
the ``vocabulary`` most frequent trigrams of each language; all three are parameters.  Every document is then scored on its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing was learned all are
``und``; a text with letters but no known trigram gets the language with most sampled text, with score 1/(number of
languages); rows with null id are scored but never learned from; repeated rows are scored each; extra columns pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .common import bounded_sample, fresh, is_held_out

PER_LANGUAGE = 640
VOCABULARY = 6000
LANGUAGES = 200
ROUNDS = 10
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigram_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """24-bit codes of the trigrams of all rows, and the row of each.  Runs of other bytes count as one space."""
    data, offsets = X.buffers(col, lower=True)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = _LETTER[data]
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    edges = offsets[1:-1]
    keep[edges[edges < len(data)]] = True
    at = np.flatnonzero(keep)
    b = np.where(ok[at], data[at], 32).astype(np.int32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    same = rows[2:] == rows[:-2]
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[same]
    return codes, rows[2:][same]


def _counts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in X.slices(batch, text):
            langs = X.column(part, "stratum").to_pylist()
            codes, rows = trigram_codes(X.column(part, text))
            names = sorted(set(langs))
            lang = np.array([names.index(v) for v in langs])[rows] if len(rows) else rows
            key, n = np.unique(lang.astype(np.int64) << 24 | codes, return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [names[k] for k in key >> 24], "gram": pa.array(key & 0xFFFFFF, pa.int32()), "n": pa.array(n, pa.int64())})


_tables: dict[bytes, np.ndarray] = {}


class Mixture:
    """Trigram distributions of the learned languages."""

    def __init__(self, names: list[str], grams: np.ndarray, prob: np.ndarray, first: int):
        self.names, self.grams, self.prob, self.first = names, grams, prob, first
        key = grams.tobytes()
        if key not in _tables:  # one table of 64 MB for each worker, not for each task
            _tables.clear()
            _tables[key] = np.full(1 << 24, -1, np.int32)
            _tables[key][grams] = np.arange(len(grams))
        self.table = _tables[key]

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, int]]) -> Mixture | None:
        if not rows:
            return None
        names = sorted({r[0] for r in rows})
        grams = np.array(sorted({r[1] for r in rows}))
        count = np.zeros((len(grams), len(names)))
        place = {g: i for i, g in enumerate(grams.tolist())}
        for lang, gram, n in rows:
            count[place[gram], names.index(lang)] = n
        return cls(names, grams, (count + 0.5) / (count + 0.5).sum(axis=0), int(count.sum(axis=0).argmax()))

    def infer(self, rows: np.ndarray, feats: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (rows x languages; 0 for languages outside the chosen set) and the posterior of each single
        language.  ``rows`` is sorted."""
        k, v = len(self.names), len(self.grams)
        share, post = np.zeros((n_rows, k)), np.full((n_rows, k), 1 / k)
        doc, feat, cnt = [], [], []
        for r, a, b in zip(*_groups(rows), strict=True):
            c = np.bincount(feats[a:b], minlength=v)
            f = np.flatnonzero(c)
            doc.append(np.full(len(f), r))
            feat.append(f)
            cnt.append(c[f])
        if not doc:
            share[:, self.first] = 1
            return share, post
        d, f, c = np.concatenate(doc), np.concatenate(feat), np.concatenate(cnt).astype(float)
        p = self.prob[f]
        total = np.bincount(d, c, n_rows)
        single = np.stack([np.bincount(d, c * np.log(p[:, j]), n_rows) for j in range(k)], axis=1)
        best = np.where(total > 0, single.argmax(axis=1), self.first)
        share[np.arange(n_rows), best] = 1
        scaled = (single - single.max(axis=1, keepdims=True)) / 3
        post = np.exp(scaled)
        post /= post.sum(axis=1, keepdims=True)
        like = single.max(axis=1)
        penalty = 0.5 * np.log(np.maximum(total / 3, 2)) * 3
        open_ = total > 0
        while k > 1 and open_.any():
            gain, choice, theta = np.full(n_rows, -np.inf), np.zeros(n_rows, int), np.zeros((n_rows, k))
            use = open_[d]
            du, cu, pu = d[use], c[use], p[use]
            for j in range(k):
                # The likelihood is concave in the proportions, so its slope at 0 bounds what language j can add.
                slope = np.bincount(du, cu * pu[:, j] / (pu * share[du]).sum(axis=1), n_rows) - total
                fits = open_ & (share[:, j] == 0) & (slope > penalty)
                if not fits.any():
                    continue
                start = share * 0.8
                start[:, j] += 0.2
                sub = fits[du]
                dj, cj, pj = du[sub], cu[sub], pu[sub]
                for _ in range(ROUNDS):
                    w = pj * start[dj]
                    w *= (cj / w.sum(axis=1))[:, None]
                    start = np.stack([np.bincount(dj, w[:, i], n_rows) for i in range(k)], axis=1)
                    start /= np.maximum(start.sum(axis=1, keepdims=True), 1e-300)
                now = np.bincount(dj, cj * np.log((pj * start[dj]).sum(axis=1)), n_rows) - like
                better = fits & (now > gain)
                gain[better], choice[better], theta[better] = now[better], j, start[better]
            taken = open_ & (gain > penalty)
            share[taken] = theta[taken]
            like[taken] += gain[taken]
            open_ = taken & ((share > 0).sum(axis=1) < k)
        return share, post

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
        codes, rows = trigram_codes(col)
        feats = self.table[codes]
        known = feats >= 0
        share, post = self.infer(rows[known], feats[known], len(col))
        letters = np.asarray(pc.match_substring_regex(pc.fill_null(col.cast(pa.large_string()), ""), r"\p{L}"))
        best = share.argmax(axis=1)
        at = np.arange(len(col))
        score = np.where(letters, np.clip(share[at, best] * post[at, best], 0, 1), 0.0)
        names = [self.names[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        parts = [{self.names[j]: float(s[j]) for j in np.flatnonzero(s > 0)} if ok else {} for s, ok in zip(share, letters, strict=True)]
        return names, score, parts


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[heads], heads, np.r_[heads[1:], len(rows)]


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, vocabulary: int = VOCABULARY, languages: int = LANGUAGES) -> Mixture | None:
    learn = df.where(~is_held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    common = learn.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).select(lang_col)
    learn = learn.join(F.broadcast(common), lang_col, "left_semi")
    ids = bounded_sample(learn, id_col, F.col(lang_col), per_language)
    sample = learn.select(F.col(id_col), F.col(lang_col).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = sample.join(F.broadcast(ids), [id_col, "stratum"], "left_semi")  # at most per_language rows of each language
    counts = sample.mapInArrow(lambda it: _counts(it, "_text"), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= vocabulary)
    return Mixture.from_counts([(r.lang, r.gram, r.n) for r in top.collect()])


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Mixture | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``proportions`` (language to share)."""
    model = model or fit(df, id_col, text_col, lang_col)
    df = df.drop("lang_pred", "score", "proportions")
    (text,) = fresh(df, "_text")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast(None if model is None else (model.names, model.grams, model.prob, model.first))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if sent.value is None else Mixture(*sent.value)
        for batch in batches:
            for part in X.slices(batch, text):
                if m is None:
                    lang, score, parts = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows), [{}] * part.num_rows
                else:
                    lang, score, parts = m.predict(X.column(part, text))
                cols = [X.column(part, n) for n in names]
                cols += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(x.items()) for x in parts], pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "proportions"])

    return df.withColumn(text, F.col(text_col)).mapInArrow(run, schema)
