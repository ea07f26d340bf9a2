import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelloom.llm import textcore as tc
from voxelloom.llm.components import components
from voxelloom.llm.nearjoin import intersections, near_classes, needed_matches, op9_ngram_jaccard_join, signatures


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """class_id and n_links of each row, by an inverted index."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(shingle_set(text), []).append(doc)
    keys = list(sets)
    posts = defaultdict(list)
    for i, s in enumerate(keys):
        for x in s:
            posts[x].append(i)
    near = defaultdict(set)
    for i, s in enumerate(keys):
        for j, both in Counter(j for x in s for j in posts[x] if j > i).items():
            if both >= threshold * (len(s) + len(keys[j]) - both) - 1e-9:
                near[i].add(j)
                near[j].add(i)
    label, seen = {}, set()
    for i in range(len(keys)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min(d for j in group for d in sets[keys[j]])
        label |= {j: least for j in group}
    return {d: (label[i], len(near[i]), len(sets[k])) for i, k in enumerate(keys) for d in sets[k]}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_same) for r in df.collect()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(x[1] for x in want.values())
    assert result(op9_ngram_jaccard_join(docs)) == want


@pytest.mark.parametrize(("group", "band_group"), [(2048, 512), (40, 30), (40, 3)])
def test_large_group(spark, group, band_group):
    rng = random.Random(1)
    rows = []
    for base in range(3):
        # A group of copies, one whose texts differ more, and one of texts that share a half only.
        words = [f"w{rng.randrange(500)}" for _ in range(200)]
        for _ in range((150, 60, 40)[base]):
            w = list(words)
            for _ in range(rng.randrange((6, 14, 3)[base])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[:100] + [f"y{rng.randrange(10**6)}" for _ in range(100)] if base == 2 else w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_classes(docs, group=group, band_group=band_group)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [(1, None, "k"), (2, "", None), (3, "one two", None), (4, " one\ttwo ", None), (5, "One two", None), (6, long, None), (7, long + " tail", None), (None, "one two", None), (4, " one\ttwo ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = [(r.doc_id, r.class_id, r.n_same, r.n_links) for r in op9_ngram_jaccard_join(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 4, 0), (4, 3, 4, 0), (4, 3, 4, 0), (5, 5, 1, 0), (6, 6, 1, 1), (7, 6, 1, 1), (None, 3, 4, 0)], key=str)
    assert op9_ngram_jaccard_join(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(900, 900)]
    made = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(made, 0).collect()}
    assert got == {r.node: r.label for r in components(made).collect()}
    assert components(made.limit(0)).collect() == components(made.limit(0), -1).collect() == []
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_posterior_and_estimates():
    needed = needed_matches()
    assert needed == sorted(needed) and needed[-1] < 0.8 * 128
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 900).astype(tc.U64), rng.integers(0, 2**63, 100).astype(tc.U64)
    both = np.concatenate([np.sort(a), np.sort(np.concatenate([a[:800], b]))])
    sig = signatures(both, np.array([0, 900, 1800]), 4096)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.03
    sets = [np.unique(rng.integers(0, 50, 30)).astype(tc.U64) for _ in range(6)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)
    assert intersections(sets[:2], sets[2:]).tolist() == [r[2:] for r in want[:2]]


def test_structured_words_and_the_largest_id(spark):
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    rows = [(1, f"{one} x y z u"), (2, f"{other} x y z u"), (3, f"{one} x y z u"), ((1 << 63) - 1, f"{other} x y z u")]
    assert result(op9_ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    with_null = [*rows, (None, f"{one} x y z u")]
    got = [(r.doc_id, r.class_id, r.n_same) for r in op9_ngram_jaccard_join(spark.createDataFrame(with_null, "doc_id long, text string")).collect()]
    assert (None, 1, 3) in got and ((1 << 63) - 1, 2, 2) in got
