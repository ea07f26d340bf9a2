import pytest
from pyspark.sql import functions as F

from voxelloom.functions import tables
from voxelloom.operators import histogram, roi


@pytest.fixture(scope="module")
def voxels(spark):
    tables.register(spark)
    rows = spark.range(2 * 12 * 10 * 8).selectExpr("concat('v', id % 2) AS volume_id", "id div 2 % 12 AS x", "id div 24 % 10 AS y", "id div 240 AS z", "cast(id * 7 % 11 % 3 AS int) AS m", "cast(id % 13 AS double) AS v")
    rows.createOrReplaceTempView("some_voxels")
    return rows


def test_regions_equal_those_of_dataframes(spark, voxels):
    got = spark.sql("SELECT * FROM random_rois(TABLE(some_voxels) PARTITION BY (volume_id), 30, ARRAY(3, 5, 2), ARRAY(12, 10, 8), 4)")
    want = roi.random_rois(voxels, 30, (3, 5, 2), (12, 10, 8), seed=4)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = spark.sql("SELECT * FROM dense_rois(TABLE(some_voxels) PARTITION BY (volume_id) ORDER BY (z, y, x), ARRAY(3, 5, 2), ARRAY(12, 10, 8))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, roi.dense_rois(voxels, (3, 5, 2), (12, 10, 8)).collect()))


def test_edges_equal_those_of_dataframes(spark, voxels):
    got = spark.sql("SELECT * FROM equalised_edges(TABLE(SELECT m AS hist_idx, v AS value FROM some_voxels) PARTITION BY (hist_idx), 4)")
    want = histogram.determine_edges(voxels.select(F.col("m").alias("hist_idx"), F.col("v").alias("value")), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["hist_idx"].dataType.simpleString() == "int"


@pytest.mark.parametrize("call,why", [
    ("random_rois(TABLE(some_voxels) PARTITION BY (volume_id), -1, ARRAY(3, 5, 2), ARRAY(12, 10, 8), 4)", "constant of 0"),
    ("random_rois(TABLE(some_voxels) PARTITION BY (volume_id), 3, ARRAY(3, 5), ARRAY(12, 10, 8), 4)", "three numbers"),
    ("dense_rois(TABLE(SELECT x FROM some_voxels), ARRAY(3, 5, 2), ARRAY(12, 10, 8))", "no column"),
    ("equalised_edges(TABLE(some_voxels), 4)", "no column hist_idx"),
])
def test_wrong_arguments_are_told_when_a_query_is_planned(spark, voxels, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT * FROM {call}")
