"""Exact dedup, n-gram Jaccard join and suffix-array dedup against brute force."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from starql.llm import minhash_join as M
from starql.llm.components import connected_components
from starql.llm.exact_dedup import dedup_report, exact_dedup, frequent_digests, verified_winners
from starql.llm.suffix_array import common_prefixes, suffix_array
from starql.llm.suffix_dedup import remove_repeats, repeated_stretches, stretches

from .data import corpus, frame, odd


def key(i):
    return (i is None, i)


@pytest.mark.parametrize("tracked", [4096, 16])
def test_exact_dedup(spark, tracked):
    rows = corpus() + odd() + [(2000 + k, "a  hot\ttext\n" if k % 2 else "a hot text ", None) for k in range(120)]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    want = sorted((str(i), str(min(g, key=key)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    out = exact_dedup(frame(spark, rows).repartition(5), tracked=tracked)
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert "_digest" in out.columns and out.columns.count("kept") == 1


def test_heavy_hitters_are_found_and_verified(spark):
    rows = [(k, "hot" if k % 3 == 0 else "warm" if k % 5 == 0 else f"cold {k}") for k in range(3000)]
    keys = spark.createDataFrame(rows, "_id long, _digest string").repartition(7)
    winners = {r._digest: (r._hot_size, r._hot_keep) for r in verified_winners(keys, 64).collect()}
    assert winners == {"hot": (1000, 0), "warm": (400, 5)}
    assert frequent_digests(keys, 64).count() <= 64


def brute_links(sets, threshold):
    links = collections.defaultdict(set)
    for a, x in enumerate(sets):
        for b in range(a):
            n = len(set(x.tolist()) & set(sets[b].tolist()))
            if n and n / (len(x) + len(sets[b]) - n) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def test_jaccard_join(spark, monkeypatch):
    r = random.Random(4)
    base = " ".join(f"w{r.randrange(999)}" for _ in range(120)).split()
    near = []
    for k in range(40):  # a group of near copies, larger than the blocks below
        w = list(base)
        w[r.randrange(len(w))] = f"n{k}"
        near.append((3000 + k, " ".join(w), None))
    rows = corpus() + odd() + near
    monkeypatch.setattr(M, "BLOCK", 8)
    out = M.jaccard_join(frame(spark, rows).repartition(3))
    got = out.collect()
    sets = M.ngram_sets(pa.array([t for _, t, _ in rows]), M.N)
    links = brute_links(sets, M.THRESHOLD)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in links:
        for b in links[a]:
            parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(rows[k][0])
    want = sorted((str(rows[k][0]), str(min(classes[find(k)], key=key)), len(links[k])) for k in range(len(rows)))
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in got) == want
    assert sum(x.is_first for x in got) == len(classes)
    assert out.columns.count("class_id") == 1 and len(links) > 60


def test_a_large_group_of_near_copies(spark):
    """5,000 texts that all link to one another, in several blocks; a third of all rows has no id."""
    r = random.Random(14)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(5000):
        w = list(base)
        w[k % 150], w[(k // 150) * 4 + 1] = f"a{k}", f"b{k}"
        rows.append((None if k % 3 == 0 else k, " ".join(w), None))
    out = M.jaccard_classes(frame(spark, rows).repartition(6))
    got = out.select("class_id", "n_links", "is_first").collect()
    sets = [set(x.tolist()) for x in M.ngram_sets(pa.array([t for _, t, _ in rows]), 5)]
    some = r.sample(range(5000), 8)
    want = collections.Counter(sum(len(sets[a] & x) / len(sets[a] | x) >= 0.8 for x in sets) - 1 for a in some)
    links = collections.Counter(x.n_links for x in got)
    assert len(got) == 5000 and all(links[n] for n in want) and {x.class_id for x in got} == {1} and sum(x.is_first for x in got) == 1


def test_many_rows_without_an_id(spark):
    """Short texts in pairs: null ids give the same links as own ids, in about the same time."""
    import time

    texts = [f"pair {k // 2} alpha{k // 2} beta{k // 2} gamma{k // 2} delta{k // 2} epsilon{k // 2}" + " omega" * (k % 2) for k in range(2000)]
    took, links = [], []
    for ids in (range(2000), [None] * 2000):
        began = time.time()
        links.append(sorted(x.n_links for x in M.jaccard_classes(frame(spark, [(i, t, None) for i, t in zip(ids, texts)])).collect()))
        took.append(time.time() - began)
    assert links[0] == links[1] and took[1] < 3 * took[0] + 10


def test_blocks_by_bytes(spark, monkeypatch):
    """A few long texts in more blocks than texts: empty blocks add no links."""
    r = random.Random(15)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]]), None) for k in range(7)]
    monkeypatch.setattr(M, "BLOCK_BYTES", 1000)
    assert [x.n_links for x in M.jaccard_classes(frame(spark, rows)).collect()] == [6] * 7


def test_bands():
    bands, rows = M.choose_bands(0.8, 0.995, 20)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands <= 20 and (bands, rows) == (18, 6)


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e for e in edges if e[0] != e[1])}


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        text = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(40))]
        order = suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        for k, n in enumerate(common_prefixes(text, order)):
            if k:
                a, b = text[order[k - 1] :], text[order[k] :]
                assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


@pytest.mark.parametrize("most", [4, 30, 60])
def test_divided_groups_give_the_same_stretches(most):
    r = random.Random(7)
    for _ in range(150):
        left, right = "".join(r.choice("ab") for _ in range(8)), "".join(r.choice("ab") for _ in range(8))
        slices = set()
        for _ in range(r.randrange(2, 14)):
            a, b = list(left), list(right)
            if r.random() < 0.7:
                a[r.randrange(8)] = r.choice("abx")
            if r.random() < 0.7:
                b[r.randrange(8)] = r.choice("aby")
            slices.add(("".join(a).encode()[r.choice([0, 0, 0, 3]) :], r.choice([1, 1, 1, 2]), "".join(b).encode()[: r.choice([8, 8, 5])]))
        slices = sorted(slices)
        want = []
        for i, (l, g, x) in enumerate(slices):
            a, b = [0], [0]
            for j, (m, h, y) in enumerate(slices):
                if i != j and g == h:
                    n = next((k for k in range(min(len(l), len(m))) if l[-1 - k] != m[-1 - k]), min(len(l), len(m)))
                    o = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
                    if n + o >= 8:
                        a.append(n)
                        b.append(o)
            want.append((max(a), max(b)) if len(a) > 1 else None)
        assert repeated_stretches(slices, 12, 4) == want
        assert stretches(slices, most, 12, 4) == want


def brute_repeats(texts, span=400):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(x), sum(gone), runs, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("large", [512, 2])
def test_suffix_dedup(spark, large):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(2500)) for _ in range(3)]
    rows = odd() + corpus(n=25)
    for k in range(60):
        x = r.randrange(2000)
        t = list(r.choice(base)[x : x + r.randrange(100, 1200)])
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = "X"
        rows.append((5000 + k, f"q{k}" * r.randrange(50) + "".join(t) + f"z{k}" * r.randrange(50), None))
    rows += [(6000, "a" * 2000, None), (6001, "ab" * 500, None), (6002, "a" * 405 + "b", None), (6003, base[0], None), (6003, base[0], None)]
    got = remove_repeats(frame(spark, rows).repartition(3), large=large).collect()
    want = brute_repeats([t for _, t, _ in rows])
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == sorted((str(i), *w) for (i, _, _), w in zip(rows, want, strict=True))


def test_dedup_report(spark):
    rows = corpus() + odd() + [(2000 + k, "a hot text", None) for k in range(120)]
    want = exact_dedup(frame(spark, rows)).select("doc_id", "text_sha256", "keep_id", "group_size", "kept").collect()
    got = dedup_report(frame(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "text_sha256", "keep_id", "group_size", "kept"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


def test_a_very_common_passage_in_many_surroundings(spark):
    """One gram with many different slices: they are divided step by step and never gathered."""
    r = random.Random(16)
    passage = "".join(r.choice("abcdefgh ") for _ in range(380))
    rows = []
    for k in range(400):
        end = "".join(r.choice("xyz") for _ in range(r.choice([0, 3, 30, 200])))
        rows.append((k, "".join(r.choice("uvw") for _ in range(r.choice([5, 60, 300]))) + "tail"[: k % 5] + passage + "same"[: k % 4] + end, None))
    got = remove_repeats(frame(spark, rows), large=8).collect()
    want = brute_repeats([t for _, t, _ in rows])
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == sorted((i, *w) for (i, _, _), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("op", [exact_dedup, dedup_report, M.jaccard_join, remove_repeats])
def test_empty(spark, op):
    assert op(frame(spark, [])).collect() == []
