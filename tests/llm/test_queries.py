"""The registered queries over the smallest tables: against SQL where there is some, else against plain versions."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starql.llm import langid, mil_quality
from starql.llm import textops as X
from starql.llm.queries import oracle_sql, queries, tokenizer_file

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(repr, want.fetchall()))


def test_op1_base_patterns(spark):
    got = {r.doc_id: r for r in queries()["op1_secret_scan"](spark, SF).collect()}
    docs = read("documents")
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("crf")) == listed


def test_op2_held_out_rows(spark):
    got = {r.doc_id: r for r in queries()["op2_language_id"](spark, SF).collect()}
    docs = read("documents")
    langs = {d["lang"] for d in docs if d["lang"]}
    assert all(got[d["doc_id"]].held_out == held_out(d["doc_id"]) for d in docs)
    assert all(r.lang_pred in langs | {"und"} and 0 <= r.score <= 1 for r in got.values())
    test = [d for d in docs if d["lang"] and held_out(d["doc_id"]) and re.search(r"[^\W\d_]", d["text"] or "")]
    assert np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in test]) > 0.95


def test_op4_rules(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    got = {r.page_id: r for r in queries()["op4_url_filter"](spark, SF).collect()}
    for p in read("pages"):
        url, host, path = p["url"], "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = re.split(r"[?#]", rest[cut:])[0]
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        r = got[p["page_id"]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def plain_score(net, x):
    """Gated attention over the passages of one document, one number at a time."""
    p = net.p
    n, hidden, gate = len(x), len(p["b"]), p["v"].shape[1]
    h = [[math.tanh(sum((x[i][f] - p["mean"][f]) / p["scale"][f] * p["w"][f][k] for f in range(len(x[i]))) + p["b"][k]) for k in range(hidden)] for i in range(n)]
    e = [sum(p["a"][g] * math.tanh(sum(h[i][k] * p["v"][k][g] for k in range(hidden))) / (1 + math.exp(-sum(h[i][k] * p["u"][k][g] for k in range(hidden)))) for g in range(gate)) for i in range(n)]
    att = [math.exp(v) for v in e]
    z = sum(a * sum(h[i][k] * p["c"][k] for k in range(hidden)) for i, a in enumerate(att)) / sum(att)
    return 1 / (1 + math.exp(-(z + p["d"][0])))


def test_op5_scores(spark):
    docs, labels = read("documents"), {r["doc_id"]: r["quality"] for r in read("labels")}
    got = {r.doc_id: r for r in queries()["op5_quality"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    net = mil_quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for d in docs[:12]:
        x, _ = mil_quality.passages(pa.array([d["text"]]))
        assert got[d["doc_id"]].score == pytest.approx(plain_score(net, x.astype(float)[:60]), abs=1e-6) or len(x) > 60
    test = [(got[i].score, q) for i, q in labels.items() if i in got and held_out(i) and q is not None]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    if good and bad:
        assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_op5_passages():
    """Passages are runs of at most ``WORDS`` words; one row of features for each, and one for a text without words."""
    texts = ["", None, "a", " ".join(["word"] * (3 * mil_quality.WORDS + 1)), "é" * 500]
    x, owner = mil_quality.passages(pa.array(texts))
    assert x.shape[1] == mil_quality.N_FEATURES and sorted(set(owner.tolist())) == [0, 1, 2, 3, 4]
    assert np.bincount(owner)[3] == 4 and not x[owner == 0].any()


def test_op8_digests(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in queries()["op8_bpe"](spark, SF).collect()}
    for d in read("documents"):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_sets_against_em_over_every_set():
    """The greedy choice of languages, against the best penalised likelihood over all sets, each fitted by plain EM."""
    import collections
    import itertools
    import random

    from .data import prose

    r = random.Random(3)
    counts = collections.Counter()
    for lang in ("en", "fr", "de"):
        codes, _ = langid.trigram_codes(pa.array([prose(r, lang, 3000)]))
        counts.update((lang, int(c)) for c in codes)
    m = langid.Mixture.from_counts([(a, b, n) for (a, b), n in counts.items()])
    texts = [prose(r, "en", 80), prose(r, "fr", 100) + " " + prose(r, "de", 100), prose(r, "de", 60) + " " + prose(r, "en", 90), " ".join(prose(r, x, 80) for x in ("en", "fr", "de"))]
    _, _, parts = m.predict(pa.array(texts))
    for text, part in zip(texts, parts, strict=True):
        codes, _ = langid.trigram_codes(pa.array([text]))
        p = m.prob[(f := m.table[codes])[f >= 0]]
        found = {}
        for size in (1, 2, 3):
            for which in itertools.combinations(range(3), size):
                theta = np.full(size, 1 / size)
                for _ in range(300):
                    w = p[:, which] * theta
                    theta = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
                penalty = (size - 1) * 0.5 * math.log(max(len(p) / 3, 2)) * 3
                found[which] = np.log(p[:, which] @ theta).sum() - penalty, theta
        best = max(found, key=lambda k: found[k][0])
        assert set(part) == {m.names[k] for k in best}
        assert all(part[m.names[k]] == pytest.approx(v, abs=0.03) for k, v in zip(best, found[best][1], strict=True))


def test_words_of_sql_are_words_of_operators():
    text = "Ab-c d_é 日本 x1\n\t!É"
    data, offsets = X.buffers(pa.array([text]), lower=True)
    s, e, _ = X.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
