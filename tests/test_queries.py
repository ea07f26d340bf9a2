import duckdb
import pytest

import __spark_entry__
from tests.parity import connected, same
from voxelloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sample_lines_of_large_sums(spark, tmp_path):
    """Voxels that sum to a million and more, as those of large tables do."""
    duckdb.sql(f"COPY (SELECT * REPLACE (l_quantity * 100000 AS l_quantity) FROM read_parquet('{SF}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    large = duckdb.connect()
    large.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    same(QUERIES["sample_lines"](spark, str(tmp_path)), large, ORACLES["sample_lines"])


def test_sample_lines_without_boxes(spark, tmp_path):
    """No voxel has mask value 1."""
    duckdb.sql(f"COPY (SELECT * REPLACE (l_quantity * 3 AS l_quantity) FROM read_parquet('{SF}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert QUERIES["sample_lines"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["dicom_names", "dicom_compressed", "dicom_converted"])
@pytest.mark.parametrize("odd", ["l_quantity / 4 AS l_quantity", "-l_quantity AS l_quantity", "CASE l_returnflag WHEN 'A' THEN NULL ELSE l_returnflag END AS l_returnflag", "l_returnflag || 'ä中' AS l_returnflag", "' ' || l_returnflag || '> ' AS l_returnflag"])
def test_dicom_of_odd_line_items(spark, tmp_path, odd, name):
    """Sums with fractions and below zero; flags that are null, of other scripts or with blanks at their ends."""
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}) FROM read_parquet('{SF}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
