"""Queries that agree with their SQL on small tables only: more stations than places, calm wind, more parts than the first grid's."""

import pytest
from pyspark.sql import functions as F

from airloom.plans import registry

from .oracle import connection, difference

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["J15_station_of_road", "J2_nearest_in_radius", "G11_wind_direction"])
def test_matches_sql_at_a_tenth(spark, name):
    assert difference(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connection(SF)) == ""


def test_grid_scan_has_no_southern_edge(spark, tmp_path):
    """Rows beyond the first grid's lie south of any latitude that a small table reaches."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 100_000).coalesce(1).write.parquet(f"{tmp_path}/files")
    next((tmp_path / "files").glob("part-*.parquet")).rename(tmp_path / "part.parquet")
    name = "S8_grid_scan"
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
    assert difference(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], connection(str(tmp_path))) == ""


def copied_relation(path, relation, times):
    """A relation of the sf0.1 tables, as copies with shifted keys have it."""
    con = connection(SF)
    con.execute(f"COPY (SELECT * REPLACE (o_orderkey + {150_000 * times} AS o_orderkey, o_custkey + {15_000 * times} AS o_custkey) FROM orders WHERE o_custkey = {relation}) TO '{path}/orders.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey + {150_000 * times} AS l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = {relation})) TO '{path}/lineitem.parquet'")
    return connection(str(path))


def test_an_open_chain_that_is_a_task_s_longest(spark, tmp_path):
    """Three ways of relation 89998 hang together, with gaps on either side."""
    con, name = copied_relation(tmp_path, 14_998, 5), "X50_relation_rings"
    assert difference(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], con) == ""


def test_an_area_next_to_a_half(spark, tmp_path):
    """Two rings of 2987796.499999 square metres by the SQL, of 2987796.5 if they are summed in another order."""
    con, name = copied_relation(tmp_path, 158, 3), "X50_multipolygons"
    assert difference(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], con) == ""
