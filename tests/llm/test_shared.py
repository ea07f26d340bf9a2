from pyspark.sql import functions as F

from voxelloom.llm.digests import op4_exact_dedup
from voxelloom.llm.mixing import mix
from voxelloom.llm.nearjoin import op9_ngram_jaccard_join
from voxelloom.llm.shared import join_groups


def hot_rows(spark, n=6000):
    """A third of all rows have no id and one text."""
    text = F.when(F.col("id") % 3 == 0, F.lit("the one text that a third of all rows have in common here")).otherwise(F.concat(F.lit("text of its own, number "), F.col("id").cast("string")))
    return spark.range(n).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))


def test_rows_without_an_id_are_spread(spark):
    rows = hot_rows(spark).withColumn("key", F.xxhash64("text"))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    found = join_groups(rows, groups, "key", "size", 6000, "doc_id", with_spread=True, apart=F.lit(True))
    most = found.groupBy("key", "spread").count().agg(F.max("count")).first()[0]
    assert found.count() == 6000 and most < 50
    assert found.filter("size = 2000").count() == 2000


def test_results_for_rows_without_an_id(spark):
    docs = hot_rows(spark)
    got = op4_exact_dedup(docs).groupBy("group_size", "kept").count().collect()
    # All of the group are without an id: one is kept.
    assert {(r.group_size, r.kept): r["count"] for r in got} == {(1, True): 4000, (2000, True): 1, (2000, False): 1999}
    known = docs.unionByName(docs.filter("doc_id IS NULL").limit(1).withColumn("doc_id", F.lit(7_000_000).cast("long")))
    kept = op4_exact_dedup(known).filter("kept AND group_size > 1").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in kept] == [(7_000_000, 7_000_000, 2001)]
    near = op9_ngram_jaccard_join(docs).filter("n_same > 1")
    assert near.count() == 2000 and near.filter("class_id IS NULL AND n_same = 2000").count() == 2000


def test_rows_without_an_id_take_part_in_the_mix(spark):
    docs = hot_rows(spark).withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id()))
    words = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    one, other = mix(docs), mix(docs.repartition(3))
    assert one.agg(F.sum("taken")).first()[0] == words * 15 // 10
    assert one.select("doc_id", "size", "taken").exceptAll(other.select("doc_id", "size", "taken")).isEmpty()
