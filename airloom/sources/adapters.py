"""Air-quality views of the star-schema tables: observations, stations, grids, emissions, met and adjustments.

Each ``*_SQL`` is the same view in DuckDB SQL, to start a ``WITH`` list.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sid = F.col("user_id") % 6
    return e.select(
        "event_id",
        F.col("event_type").alias("var"),
        F.concat(F.lit("S"), sid.cast("string")).alias("source_id"),
        sid.alias("sid"),
        (60.10 + 0.02 * sid).alias("lat"),
        (24.70 + 0.04 * (sid % 3)).alias("lon"),
        "ts",
        seconds().alias("sec"),
        F.floor(seconds() / 3600).alias("sys_hour"),
        "value",
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("maturity"),
    )


OBS = """obs AS (
  SELECT event_id, event_type AS var, 'S' || CAST(user_id % 6 AS VARCHAR) AS source_id, user_id % 6 AS sid,
    60.10 + 0.02 * CAST(user_id % 6 AS DOUBLE) AS lat, 24.70 + 0.04 * CAST(user_id % 3 AS DOUBLE) AS lon, ts,
    CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS sys_hour, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS maturity
  FROM events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station metadata; ids ``S<n>``, with the aliases that observations may use."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ST"), s.cast("string")).alias("station"),
        F.concat(F.lit("S"), s.cast("string")).alias("alias1"),
        F.concat(F.lit("X"), (s + 1).cast("string")).alias("alias2"),
        (60.0 + 0.01 * (s % 40)).alias("lat"),
        (24.0 + 0.013 * (s % 60)).alias("lon"),
        (1.0 + (s % 5)).cast("double").alias("imprecision"),
        (F.col("s_nationkey") % 4).cast("long").alias("tz"),
        "s_acctbal",
    )


STATIONS = """stations AS (
  SELECT 'ST' || CAST(s_suppkey AS VARCHAR) AS station, 'S' || CAST(s_suppkey AS VARCHAR) AS alias1, 'X' || CAST(s_suppkey + 1 AS VARCHAR) AS alias2,
    60.0 + 0.01 * CAST(s_suppkey % 40 AS DOUBLE) AS lat, 24.0 + 0.013 * CAST(s_suppkey % 60 AS DOUBLE) AS lon,
    CAST(1 + s_suppkey % 5 AS DOUBLE) AS imprecision, CAST(s_nationkey % 4 AS BIGINT) AS tz, s_acctbal
  FROM supplier)"""

GRID_W = 50


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of ``GRID_W`` columns, one value a cell; row 0 is the north edge."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(p / GRID_W).alias("h"), (p % GRID_W).alias("w"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("long").alias("size"), "p_partkey"
    )


CELLS = "cells AS (SELECT p_partkey // 50 AS h, p_partkey % 50 AS w, p_retailprice AS value, CAST(p_size AS BIGINT) AS size, p_partkey FROM part)"


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly emission rows by category, pollutant, cell and height."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("emitter"),
        F.col("l_linenumber").cast("long").alias("cat"),
        F.col("l_returnflag").alias("pollutant"),
        (F.col("l_partkey") % 40).alias("h"),
        (F.col("l_suppkey") % 40).alias("w"),
        F.col("l_quantity").alias("height_m"),
        (F.col("l_extendedprice") * 0.001).alias("rate"),
        F.col("l_discount").alias("share"),
        F.to_date("l_shipdate").alias("day"),
        "l_orderkey",
    )


EMISSIONS = """emissions AS (
  SELECT 'E' || CAST(l_suppkey AS VARCHAR) AS emitter, CAST(l_linenumber AS BIGINT) AS cat, l_returnflag AS pollutant, l_partkey % 40 AS h, l_suppkey % 40 AS w,
    l_quantity AS height_m, l_extendedprice * 0.001 AS rate, l_discount AS share, CAST(l_shipdate AS DATE) AS day, l_orderkey
  FROM lineitem)"""

