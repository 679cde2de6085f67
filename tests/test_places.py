import math

import pytest
from pyspark.sql import functions as F

from airloom.functions import sun
from airloom.operators import spatial, terrain


def crowd(spark, n, lat, lon, prefix=""):
    return spark.range(n).select("id", F.lit(lat).alias(f"{prefix}lat"), F.lit(lon).alias(f"{prefix}lon"))


def test_crowds_at_one_place_meet_once(spark):
    """10^10 pairs of rows, one pair of places."""
    points, targets = crowd(spark, 100_000, 60.0, 24.0), crowd(spark, 100_000, 60.01, 24.0, prefix="t")
    found = spatial.gathered(points, targets, 3000.0, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n"), F.max("dist").alias("far")])
    got = found.groupBy("n").agg(F.count(F.lit(1)).alias("targets"), F.max("far").alias("far")).collect()
    assert [(r.n, r.targets) for r in got] == [(100_000, 100_000)]
    assert got[0].far == pytest.approx(6371000 * math.radians(0.01))


def test_inverse_distance_of_crowds(spark):
    """Two crowds of unlike size around a crowd of targets."""
    near = crowd(spark, 50_000, 60.0, 24.0).withColumn("value", F.lit(1.0))
    far = crowd(spark, 100_000, 60.02, 24.0).withColumn("value", F.lit(7.0))
    targets = crowd(spark, 50_000, 60.01, 24.0, prefix="t")
    got = spatial.inverse_distance(near.union(far), targets, 4000.0, ["id"]).groupBy(F.round("value", 9).alias("value")).count().collect()
    assert [(r.value, r["count"]) for r in got] == [(5.0, 50_000)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_samples_broadcast_no_grid(spark):
    grids = spark.range(100).select(F.lit(0).alias("layer"), F.floor(F.col("id") / 10).alias("h"), (F.col("id") % 10).alias("w"), F.col("id").cast("double").alias("value"))
    points = spark.range(6).select("id", F.lit(0).alias("layer"), F.lit(4.3).alias("y"), F.when(F.col("id") < 5, 5.6).otherwise(2.6).alias("x"))
    got = spatial.smooth_at(points, grids, "id")
    assert "Broadcast" not in plan(got)
    rows = {r.id: r.value for r in got.collect()}
    cells = [(max(0.2, math.hypot(4.3 - h, 2.6 - w)), 10 * h + w) for h in range(10) for w in range(10)]
    near = [(1 / d, v) for d, v in cells if d < 2.1]
    assert len(rows) == 6 and len({rows[k] for k in range(5)}) == 1 and rows[5] == pytest.approx(sum(k * v for k, v in near) / sum(k for k, _ in near))


def test_horizons_are_merged_and_the_sky_is_worked_out_by_time(spark):
    places = spark.range(48).select((F.col("id") / 24).cast("long").alias("h"), F.lit(0).cast("long").alias("w"), F.lit(60.0).alias("lat"), F.lit(24.0).alias("lon"), (1718928000 + 3600 * (F.col("id") % 24)).alias("sec"))
    horizon = spark.range(72).select(F.floor(F.col("id") / 36).alias("h"), F.lit(0).cast("long").alias("w"), (F.col("id") % 36).cast("int").alias("sector"), F.lit(90.0).alias("horizon"))
    found = terrain.shaded_power(places, horizon)
    assert "SortMergeJoin" in plan(found) and plan(found).count("ATAN2") <= 2
    elevation, _ = sun.position(F.col("sec"), F.col("lat"), F.col("lon"))
    want = {(r.h, r.sec): r.e for r in places.withColumn("e", elevation).collect() if r.e > 0}
    assert {(r.h, r.sec): r.elevation for r in found.collect()} == want
