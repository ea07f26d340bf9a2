from collections import Counter, defaultdict

import corpus_pipeline
from corpus_pipeline import exact_dedup, language_id, mix_sources, near_dedup
from pyspark.sql import functions as F

from tests.llm.test_langid import brute as language_brute
from tests.llm.test_mixing import targets
from tests.llm.test_nearjoin import brute as near_brute
from voxelloom.llm import unigram

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() >= 0.99 * docs.count()
    once = exact_dedup(spark, docs, SF)
    assert once.columns == docs.columns
    last = {}
    for r in docs.collect():
        last[lower(r.text)] = max(last.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    first = near_dedup(spark, once, SF)
    assert first.columns == docs.columns
    want = near_brute([(r.doc_id, r.text) for r in once.collect()])
    assert sorted(r.doc_id for r in first.collect()) == sorted(d for d, x in want.items() if x[0] == d)
    mixed = mix_sources(spark, first, SF)
    assert mixed.columns == docs.columns
    size, taken = defaultdict(int), defaultdict(int)
    for r in first.collect():
        size[r.source] += len((r.text or "").encode().split())
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    for s, t in targets(size).items():
        assert taken[s] == int(t + 1e-6)


def test_language_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1200").orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(10**6, "1 2 3", "en", "s", 5), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "zzzz qqqq", None, None, 9)], docs.schema)
    docs = docs.unionByName(odd)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    draw = {r.text: r.draw for r in docs.select("text", F.xxhash64("text", F.lit(6)).alias("draw")).collect()}
    want = {d for d, (lang, score) in language_brute(rows, draw, all_train=True).items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in language_id(spark, docs, "").collect()} == want and 10**6 not in want


def test_encoding_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    v = unigram.vocabulary(unigram.MODEL)
    got = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (unigram.segment_one(v, ("▁" + r.text.replace(" ", "▁")).encode()) if r.text else [])


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) > 500 and all(r.round_trip and len(r.ids) == r.n_ids for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, None), (3, "12 34", "en", None, 5, None), (4, "Word one", "en", None, 8, "y"), (4, "word ONE", "en", None, 8, "y"), (5, "word one", None, "b", 8, None), (6, "word one", "en", "b", 8, None), (6, "word one", "en", "b", 8, None)]
    rows += [(7, "one " * 50_000, "en", "c", 200_000, None), (None, "word two three four five six", "en", "c", 27, None), (8, "word two three four five six", None, "c", 27, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    kept = language_id(spark, docs, "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter([4, 4, 5, 6, 6, 7, None, 8])
    once = exact_dedup(spark, docs, "")
    assert Counter(r.doc_id for r in once.collect()) == Counter([2, 3, 6, 7, 8])
    assert once.columns == docs.columns
    first = near_dedup(spark, docs, "")
    assert Counter(r.doc_id for r in first.collect()) == Counter([1, 3, 4, 4, 5, 7, 8])
    assert set(rows_of(mix_sources(spark, docs, ""))) - set(rows_of(docs)) != {None}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert language_id(spark, unlabelled, "").count() == 8
