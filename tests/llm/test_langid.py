import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import langid
from voxelloom.llm.langid import Ftrl, drawn_texts, identify, op6_language_id, softmax, temperature


def test_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = op6_language_id(docs).collect()
    assert {r.doc_id for r in got} == set(lang) and len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    assert right > 0.97
    assert abs(np.mean([r.score for r in held]) - right) < 0.05


def test_held_out_labels_dont_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).repartition(3)
    one = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in op6_language_id(docs).collect()}
    assert one == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in op6_language_id(other).collect()}


def test_odd_rows(spark):
    rows = [(i, ("der und die " if i % 2 else "the and of ") * 9, "de" if i % 2 else "en", 0.5) for i in range(40)]
    rows += [(100, None, "de", None), (101, "", "en", None), (102, "123 !?", "en", 0.1), (103, "the and " * 40_000, None, None), (None, "der und", None, None), (1, "der und die " * 9, "de", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in op6_language_id(docs).collect()]
    by = {d: (p, s) for d, p, s in got}
    assert len(got) == len(rows) and by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103][0] == "en" and by[None][0] == "de" and all(0 <= s <= 1 for _, _, s in got)
    assert op6_language_id(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in identify(docs, F.lit(True)).collect()} == {"und"}
    assert {r.lang_pred for r in op6_language_id(docs.filter("lang = 'de'")).collect()} == {"de", "und"}


def test_ftrl_and_temperature():
    rng = np.random.default_rng(0)
    model, ids = Ftrl(3), np.arange(12)
    for _ in range(600):
        c = int(rng.integers(3))
        x = rng.random(12) * 0.1
        x[c * 3] += 1
        model.learn(ids, x, c)
    w = model.weights(ids)
    assert all(softmax(np.eye(12)[c * 3] @ w).argmax() == c for c in range(3)) and not model.weights()[20:].any()
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(4 * logits, labels) - 4) < 0.5


def feature(gram):
    """The column of an n-gram, letters or 0 for a blank, by plain arithmetic."""
    x, m = 0, 0xFFFFFFFF
    for k, c in enumerate(gram):
        x = (x * 0x01000193 + c * 0x9E3779B1) & m
    k = len(gram) - 1
    return (((x ^ (x >> 15) ^ (k * 0x85EBCA6B & m)) * 0x2C1B3C6D) & m) >> 16


def frequencies(text):
    """Relative frequencies of the features of a text: n-grams of each length start at every character and at the blanks after it."""
    c = [ord(x) if x.isalpha() else 0 for x in text.lower()] + [0] * 6
    out, n = Counter(), len(c) - 3
    for k in (1, 2, 3):
        out.update(feature(c[i : i + k]) if i < n - 3 else feature([0] * 1) if k == 1 else feature([0] * k) for i in range(n))
    whole = sum(out.values())
    return {f: v / whole for f, v in out.items()}


def brute(rows, draw, all_train=False):
    """Predictions of (doc_id, text, lang) by a plain model; ``draw`` is each text's hash."""
    train = [(t, c) for d, t, c in rows if (all_train or zlib.crc32(str(d).encode()) % 4 != 2) and t is not None and c is not None]
    labels = sorted({c for _, c in train})
    df = Counter(f for t, _ in train for f in frequencies(t))
    idf = lambda f: math.log((1 + len(train)) / (1 + df[f])) + 1
    by = defaultdict(set)
    for t, c in train:
        by[c].add(t)
    vectors = []
    for c in labels:
        for t in sorted(by[c], key=lambda t: (draw[t] % (1 << 30), draw[t]))[: langid.SAMPLE // len(labels)]:
            tf = sorted(frequencies(t).items())
            ids = np.array([f for f, _ in tf] + [langid.FEATURES], np.int32)
            x = np.append(np.array([v for _, v in tf], np.float32) * np.array([idf(f) for f, _ in tf]) * langid.SCALE, 1.0)
            vectors.append((ids, x, labels.index(c)))
    vectors.sort(key=lambda v: (zlib.crc32(v[0].tobytes()), zlib.crc32(v[1].tobytes()), v[2]))
    z, n = defaultdict(lambda: np.zeros(len(labels))), defaultdict(lambda: np.zeros(len(labels)))

    def weight(f):
        return np.array([0.0 if abs(a) <= langid.L1 else (math.copysign(langid.L1, a) - a) / ((langid.BETA + math.sqrt(b)) / langid.ALPHA + langid.L2) for a, b in zip(z[f], n[f])])

    for _ in range(langid.EPOCHS):
        for i, (ids, x, c) in enumerate(vectors):
            if i % 5:
                w = np.array([weight(f) for f in ids.tolist()])
                p = softmax(x @ w)
                for f, v, own in zip(ids.tolist(), x, w):
                    g = v * (p - (np.arange(len(labels)) == c))
                    z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / langid.ALPHA * own
                    n[f] += g * g
    final = {f: weight(f) for f in list(z)}
    none = np.zeros(len(labels))
    aside = vectors[::5]
    heat = temperature(np.array([sum(v * final.get(f, none) for f, v in zip(ids.tolist(), x)) for ids, x, _ in aside]), np.array([c for _, _, c in aside]))
    out = {}
    for d, t, _ in rows:
        if t is None or not any(x.isalpha() for x in t.lower()):
            out[d] = ("und", 0.0)
            continue
        p = softmax((sum(v * idf(f) * langid.SCALE * final.get(f, none) for f, v in frequencies(t).items()) + final[langid.FEATURES]) / heat)
        out[d] = (labels[int(p.argmax())], float(p.max()))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").orderBy("doc_id").limit(70)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    draw = {r.text: r.draw for r in docs.select("text", F.xxhash64("text", F.lit(6)).alias("draw")).collect()}
    want = brute(rows, draw)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op6_language_id(docs).collect()}
    assert got.keys() == want.keys()
    for d, (c, p) in want.items():
        assert got[d][0] == c and got[d][1] == pytest.approx(p, abs=1e-4)


def test_the_draw_is_bounded_and_counts_copies_once(spark):
    rows = [("same text in every third row", "en")] * 3000 + [(f"text number {i}", "en") for i in range(6000)] + [(f"wort {i}", "de") for i in range(50)] + [("wort 1", "de")] * 9
    docs = spark.createDataFrame(rows, "text string, label string")
    got = Counter((r.label, r.text) for r in drawn_texts(docs, 100).collect())
    assert Counter(c for c, _ in got) == {"en": 100, "de": 50} and set(got.values()) == {1}
    assert got == Counter((r.label, r.text) for r in drawn_texts(docs, 100, {"en": 6001, "de": 50}).collect())
    hot = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string")
    assert {(r.lang_pred) for r in op6_language_id(hot).collect()} == {"en", "de"}
    many = spark.range(2000).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        op6_language_id(many)
