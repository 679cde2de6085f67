import pytest
from pyspark.sql import functions as F

from airloom.operators import proxies
from airloom.sources import ledger

LINES = ["a = AFFINE<2*x+1*b>", "", "# a comment", "b = AFFINE<1*y-1*c>,y_MAX<5>", "c = AFFINE<3*z>"]


def test_order_of_recipes():
    recipes = proxies.parsed(LINES)
    assert proxies.levels(recipes) == [["c"], ["b"], ["a"]] and proxies.measured(recipes) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="need each other"):
        proxies.levels(proxies.parsed(["a = AFFINE<1*b>", "b = AFFINE<1*a>"]))


def test_missing_inputs(spark):
    wide = spark.createDataFrame([(1, 1.0, 9.0, 2.0), (2, None, 1.0, 2.0), (3, 1.0, 1.0, None), (4, 1.0, None, 2.0)], "k int, x double, y double, z double")
    rows = {r.k: (r.a, r.b, r.c) for r in proxies.evaluated(wide, proxies.parsed(LINES)).collect()}
    assert rows == {1: (1.0, -1.0, 6.0), 2: (None, -5.0, 6.0), 3: (None, None, None), 4: (None, None, 6.0)}


def test_sources_keep_what_they_measure(spark):
    rows = spark.createDataFrame([("s", 1, "z", 2.0), ("s", 2, "z", 3.0), ("s", 2, "c", 7.0), ("t", 1, "z", 4.0)], "source_id string, sys_hour long, var string, value double")
    got = {(r.source_id, r.sys_hour, r["var"]): r.value for r in proxies.station_proxies(rows, proxies.parsed(["c = AFFINE<3*z>"])).collect()}
    assert got == {("s", 2, "c"): 7.0, ("t", 1, "c"): 12.0}


def test_an_interrupted_slice_is_invisible(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    rows = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("v"))
    broken = rows.select("k", F.when(F.col("k") == 5, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        ledger.write_slices({"one": rows, "two": broken, "three": rows.withColumn("more", F.lit("x"))}, path)
    got = ledger.read_slices(spark, path)
    assert got.columns == ["k", "v", "more", "slice"] and {(r.slice, r.more) for r in got.collect()} == {("one", None), ("three", "x")} and got.count() == 12
    ledger.write_slices({"two": rows.limit(2), "one": rows.filter("k = 3")}, path)
    assert sorted((r.slice, r.k) for r in ledger.read_slices(spark, path, ["one", "two"]).collect()) == [("one", 3), ("two", 0), ("two", 1)]
    assert ledger.read_slices(spark, path, ["four"]).count() == 0
    with pytest.raises(ValueError, match="column v"):
        ledger.write_slices({"odd": rows.select("k", F.lit("text").alias("v"))}, path)
        ledger.read_slices(spark, path)
