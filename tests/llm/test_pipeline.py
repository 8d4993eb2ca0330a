"""Each stage of the pipeline against brute force over the rows that its predecessor kept."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from starql.llm import mil_quality as Q  # noqa: E402
from starql.llm import minhash_join as M  # noqa: E402
from starql.llm import textops as X  # noqa: E402
from starql.llm.bpe import bpe_encode  # noqa: E402
from starql.llm.common import BATCH_BYTES, bound_batches, written  # noqa: E402
from starql.llm.queries import tokenizer_file  # noqa: E402

from .data import corpus, odd, prose  # noqa: E402
from .test_text import plain_align  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    at = tmp_path_factory.mktemp("tables")
    items = [(k, prose(r, "en", r.randint(20, 50))) for k in range(12)] + [(50, None)]
    rows = [x for x in corpus(seed=5, n=160) if x[0] is not None] + odd()
    rows += [(20_000 + k, prose(r, "en", 60) + "\n" + items[k % 12][1] + "\n" + prose(r, "fr", 40), "en") for k in range(24)]
    junk = [(30_000 + k, " | ".join(w.upper() + "!!" for w in prose(r, "en", r.randint(40, 120)).split()), "en") for k in range(80)]
    labels = [(i, 1, 0) for i, _, _ in rows if i is not None and i < 160] + [(i, 0, 0) for i, _, _ in junk]
    docs = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows + junk]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), items


def key(i):
    return (i is None, i or 0)


def listed(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages(spark, folder, tmp_path):
    sf, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs, read = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        outs[name] = read.collect(), out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        read = out

    before, after = outs["quality"]
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if r.doc_id is not None and (r.doc_id < 160 or 20_000 <= r.doc_id < 30_000)]
    assert np.mean([i in kept for i in clean]) > 0.97 and np.mean([i in kept for i in range(30_000, 30_080)]) < 0.05

    before, after = outs["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: key(r.doc_id)):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r.text or ""), r)
    assert listed(after) == listed(first.values())

    before, after = outs["near_dedup"]
    before = sorted(before, key=lambda r: key(r.doc_id))
    sets = [set(s.tolist()) for s in M.ngram_sets(pa.array([r.text for r in before]), 5)]
    label = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n / len(sets[a] | sets[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert listed(after) == listed(before[k] for k in range(len(before)) if label[k] == k)
    assert len(after) < len(before)

    before, after = outs["decontamination"]

    def hashes(text):
        data, offsets = X.buffers(pa.array([text]), lower=True)
        s, e, _ = X.words(data, offsets)
        return X.span_hashes(data, s, e)

    tests = [hashes(t) for _, t in items if t]
    short = lambda r: len(r.text or "") < 10_000  # the long text is one phrase again and again, and holds no item
    clean = [r for r in before if not (short(r) and any(plain_align(t, hashes(r.text)) >= 0.7 * 2 * len(t) for t in tests))]
    assert listed(after) == listed(clean) and len(before) - len(after) >= 12

    before, after = outs["tokenise"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in before]
    assert sorted(((r.doc_id, list(r.ids)) for r in after), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_run_and_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    before = written(spark)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 50
    assert len(written(spark)) == len(before) + 1  # intermediate tables are gone
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_batches_are_bounded(spark, folder):
    """A stage's Arrow batches end at a few MB, whatever its rows hold; a lower bound that is set stays."""
    sf, _ = folder
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 1000) AS text", "'en' AS lang", "'src' AS source", "11000L AS n_chars")
    try:
        for stage in ("quality", "near_dedup", "decontamination", "tokenise"):
            spark.conf.unset(name)
            dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            got = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < BATCH_BYTES + 1_000_000
        spark.conf.set(name, "64k")
        bound_batches(spark)
        assert spark.conf.get(name) == "64k"
    finally:
        spark.conf.set(name, old)


def test_texts_are_sent_once(spark):
    """The operators read the text column itself; a null there counts as empty, and a nested one is added."""
    docs = spark.createDataFrame([(1, "some words " * 40), (2, None), (3, "")], "doc_id long, text string")
    nested = docs.selectExpr("doc_id", "struct(text AS t) AS s")
    net = Q.Attention.start(Q.N_FEATURES)
    for make, value in ((lambda df, c: Q.score_quality(df, net, c), "score"), (lambda df, c: bpe_encode(df, tokenizer_file(), c), "ids")):
        sent = make(docs, "text")
        plan = sent._jdf.queryExecution().optimizedPlan()
        assert plan.children().head().output().size() == 2
        got = {r.doc_id: r[value] for r in sent.collect()}
        assert got == {r.doc_id: r[value] for r in make(nested, "s.t").collect()} and got[2] == got[3] != got[1]
