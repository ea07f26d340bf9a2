import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import bloomlm
from voxelloom.llm import textcore as tc
from voxelloom.llm.bloomlm import Counts, Filter, backoff_weights, filter_piece, fit, looked_up, op1_lm_scoring, score, train


def tokens(text):
    return [w.decode() for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()] + ["\n"]


WEIGHTS = np.tile(np.linspace(0, 0.6, 65), (2, 1)) * np.array([[1.0], [0.5]])


def is_held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def counted(rows):
    counts = [Counter(), Counter(), Counter()]
    for d, text in rows:
        if not is_held(d):
            t = tokens(text)
            for k in range(3):
                counts[k].update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))
    return counts


def means(counts):
    """What a level of each order stands for."""
    out = []
    for c in counts:
        by = defaultdict(list)
        for n in c.values():
            by[n.bit_length()].append(n)
        out.append({q: sum(x) / len(x) for q, x in by.items()} | {0: 0.0})
    return out


def discounts(counts):
    out = []
    for c in counts:
        of = Counter(c.values())
        out.append(of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5)
    return out


def brute(rows, weights):
    counts = counted(rows)
    n, v = sum(counts[0].values()), len(counts[0])
    mean, less = means(counts), discounts(counts)
    out = {}
    for d, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[0][(w,)] + 1) / (n + (v + 1))) for w in t)
        whole = 0.0
        for i, w in enumerate(t):
            p = (counts[0][(w,)] + 1) / (n + v + 1)
            for k in (1, 2):
                if i >= k:
                    c = mean[k][counts[k][tuple(t[i - k : i + 1])].bit_length()]
                    exact = counts[k - 1][tuple(t[i - k : i])]
                    context = exact if k == 1 else mean[1][exact.bit_length()]
                    p = min(1.0, max(c - less[k], 0) / max(context, 1) + weights[k - 1][exact.bit_length()] * p)
            whole += math.log10(p)
        out[d] = (is_held(d), len(t), sum(counts[0][(w,)] > 0 for w in t), n, base, whole)
    return out


def brute_weights(rows):
    """What the discount takes from the contexts of each level, context by context."""
    counts = counted(rows)
    mean, less = means(counts), discounts(counts)
    out = np.ones((2, 65))
    for k in (1, 2):
        taken, tokens = defaultdict(float), defaultdict(float)
        for gram, c in counts[k].items():
            q = counts[k - 1][gram[:-1]].bit_length()
            taken[q] += less[k] * c / mean[k][c.bit_length()]
            tokens[q] += c
        known = sorted(tokens)
        out[k - 1, 1:] = np.interp(range(1, 65), known, [taken[q] / tokens[q] for q in known])
    return out


def test_filter_errors():
    rng = np.random.default_rng(1)
    value = np.unique(rng.integers(0, 2**62, 20_000).astype(tc.U64))
    count = rng.integers(1, 100, len(value))
    piece = filter_piece(value, count).tobytes()
    whole = Filter(1, {0: len(piece)}, piece)
    level = whole.levels(value)
    exact = np.array([int(c).bit_length() for c in count])
    assert (level >= exact).all() and (level > exact).mean() < 0.03
    other = rng.integers(2**62, 2**63, 20_000).astype(tc.U64)
    assert 0.01 < (whole.levels(other) > 0).mean() < 0.03
    # In any order, repeated, and with a bound.
    some = rng.integers(0, len(value), 5000)
    assert (looked_up(whole, value[some]) == level[some]).all()
    assert (looked_up(whole, value[some], 3) == np.minimum(level[some], 3)).all()
    numbers, sums = np.zeros((2, 1, 65), int)
    numbers[0, 1:3], sums[0, 1:3] = (4, 2), (4, 5)
    table = Counts(numbers, sums, np.array([1]))
    assert [table.of(1, q) for q in (0, 1, 2, 3)] == [0.0, 1.0, 2.5, 5.5] and table.discount[0] == 4 / 6


def test_filter_is_right_in_49_of_50():
    rng = np.random.default_rng(3)
    value = np.unique(rng.integers(0, 2**62, 100_000).astype(tc.U64))
    count = rng.integers(1, 100, len(value))
    piece = filter_piece(value, count).tobytes()
    whole = Filter(1, {0: len(piece)}, piece)
    assert (whole.levels(value) > np.array([int(c).bit_length() for c in count])).mean() < 0.022
    assert (whole.levels(rng.integers(2**62, 2**63, 100_000).astype(tc.U64)) > 0).mean() < 0.022


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    weights = WEIGHTS.copy()
    weights[:, 0] = 1
    want = brute([(r.doc_id, r.text) for r in docs.collect()], weights)
    got = {r.doc_id: r for r in score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, weights=weights).collect()}
    assert got.keys() == want.keys()
    for d, (held, n, known, total, base, whole) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(whole, rel=0.05, abs=1)  # the filter errs to higher counts now and then


def test_fitted_default_against_brute_force(spark):
    # With so many bits the filter makes no error.
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weights = brute_weights(rows)
    want = brute(rows, weights)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for most in (1 << 28, 0):
        got = {r.doc_id: r for r in score(docs, held, bits=2000.0, broadcast_bytes=most).collect()}
        assert got.keys() == want.keys()
        for d, x in want.items():
            assert got[d].score == pytest.approx(x[-1], rel=1e-6) and got[d].base_score == pytest.approx(x[-2], rel=1e-9)


def test_probabilities_sum_to_one():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    counts, weights = counted(rows), brute_weights(rows)
    mean, less = means(counts), discounts(counts)
    # What discounted bigrams and the shorter context share out, over all contexts of each level as often as they come.
    given, tokens = defaultdict(float), defaultdict(float)
    for (h, _), c in counts[1].items():
        given[counts[0][(h,)].bit_length()] += mean[1][c.bit_length()] - less[1]
    for (h,), c in counts[0].items():
        if h != "\n":
            given[c.bit_length()] += c * weights[0][c.bit_length()]
            tokens[c.bit_length()] += c
    # Within a level of contexts the mean count of a level of bigrams isn't quite what it is over all.
    assert sum(given.values()) == pytest.approx(sum(tokens.values()), rel=1e-6)
    assert all(given[q] == pytest.approx(tokens[q], rel=0.1) for q in tokens if tokens[q] > 1000)


def test_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in op1_lm_scoring(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # Texts with nothing in common with others lose a little by interpolation.
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held) and all(r.score > 1.1 * r.base_score for r in held)


def test_weights():
    numbers, sums = np.zeros((2, 2, 65), int)
    numbers[:, 1:3], sums[:, 1:3] = (6, 3), (6, 6)
    counts = Counts(numbers, sums, np.array([3, 3]))
    seen = np.zeros((1, 65, 65), int)
    # Of contexts of level 1 each token is a different one; of level 2 every other token is.
    seen[0, 1, 1], seen[0, 2, 2] = 10, 4
    assert backoff_weights(seen, counts, 2)[0, :4].tolist() == [1.0, 0.5, 0.25, 0.25]


def test_weights_are_from_all_training_texts(spark, monkeypatch):
    # 1.2 million tokens that don't repeat, and a text that does.
    one, again = [f"a{i} b{i} c{i}" for i in range(400_000)], " ".join(f"w{i % 500}" for i in range(1000))
    texts = [" ".join(one[i : i + 400]) for i in range(0, len(one), 400)] + [again] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    model = train(docs)
    got = fit(model, docs, model.broadcast())
    # Words of the repeating text occur 600 times each and foretell the next; all others occur once.
    foretold = (600).bit_length()
    assert got[0, foretold] < 0.01 and got[0, 1] == pytest.approx(model.counts.discount[1], rel=0.05) and got[0, 0] == 1
    assert np.allclose(got, fit(model, docs), atol=1e-9)
    seen = []
    monkeypatch.setattr(bloomlm, "backoff_weights", lambda tokens, counts, order: seen.extend(tokens.sum(axis=(1, 2))))
    fit(model, docs)
    # All but the first word, or the first two, of each text.
    assert seen == [model.tokens - len(texts), model.tokens - 2 * len(texts)]


def test_texts_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts[:40])]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 120))


def test_shuffled_probes_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    one = {r.doc_id: r.score for r in score(docs, held).collect()}
    many = {r.doc_id: r.score for r in score(docs, held, broadcast_bytes=0).collect()}
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) < 1e-9 for d in one)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "Word word WORD \t word", "y"), (3, "Word word WORD \t word", "y"), (None, "é É", None), (4, "z " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    got = op1_lm_scoring(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 5), (3, 5), (4, 100_001)]
    assert all(r.score <= 0 and np.isfinite(r.score) for r in got)
    assert op1_lm_scoring(docs.limit(0)).collect() == []
    alone = score(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and all(r.n_known == 0 for r in alone)


def test_structured_words(spark):
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    docs = spark.createDataFrame([(0, one), (1, other), (2, one)], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in score(docs, F.col("doc_id") == 1).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_workers_share_a_broadcast_filter(spark):
    """Workers map the pieces (32 MB here), without a copy in each, and read what a filter at hand gives."""
    n, rng = 40, np.random.default_rng(5)
    pieces = [(b, np.bitwise_or(*rng.integers(0, 1 << 64, (2, 100_000 + b), np.uint64)).tobytes()) for b in range(n) if b != 7]
    sizes = {b: len(x) for b, x in pieces}
    value = np.sort(rng.integers(0, 1 << 63, 20_000, np.uint64) << np.uint64(1))
    parts = bloomlm.Model(3, 1, 1, None, n, spark.createDataFrame(pieces, "bucket int, filter binary"), sizes).broadcast()

    def run(_):
        def own():
            with open("/proc/self/smaps_rollup") as f:
                return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

        before = own()
        level = parts.levels(value)
        yield own() - before, level.tobytes()

    grown, level = spark.sparkContext.parallelize([0], 1).mapPartitions(run).first()
    assert np.array_equal(np.frombuffer(level, np.uint8), Filter(n, sizes, b"".join(x for _, x in pieces)).levels(value))
    assert max(level) > 3
    assert grown < 8


def test_counts_leave_by_order():
    """Each batch has the letters of one order, and together they have all n-grams."""
    texts = [f"a b c d {i}" for i in range(50)]
    batches = list(bloomlm._count(3, 4)([pa.record_batch({"text": texts[:20]}), pa.record_batch({"text": texts[20:]})]))
    assert [set(b.column("kind").to_pylist()) for b in batches] == [{1}, {2}, {3}]
    sums = [sum(int(tc.restored(c, np.uint32).sum()) for c in b.column("counts").to_pylist()) for b in batches]
    assert sums == [50 * 6, 50 * 5, 50 * 4]
