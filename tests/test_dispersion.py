import math

import pytest
from pyspark.sql import functions as F

from airloom.functions import geo, physics
from airloom.operators import dispersion as d


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_erfc_and_wind_round_trip(spark):
    for x in (-1.5, 0.0, 0.3, 2.0):
        assert value(spark, geo.erfc(F.lit(x))) == pytest.approx(math.erfc(x), abs=2e-7)
    for angle in (0.0, 1.0, 90.0, 225.0, 359.0):
        n, e = geo.wind_components(F.lit(angle), F.lit(5.0))
        assert value(spark, geo.wind_direction(n, e)) == pytest.approx(angle, abs=0.02)


def test_puffs_conserve_mass(spark):
    e = spark.createDataFrame([("E", 1, 3, 4, 50.0, 20.0), ("E", 2, 3, 4, 10.0, 20.0)], "emitter string, cat long, h long, w long, rate double, height_m double")
    puffs = d.released(e, 8.0)
    assert puffs.count() == 9 and puffs.agg(F.sum("mass")).first()[0] == pytest.approx(60)
    merged = d.merged(d.advected(puffs, 1.0, 0.0, 60.0), 500.0)
    assert merged.count() == 2 and merged.agg(F.sum("mass")).first()[0] == pytest.approx(60)
    assert merged.first().y_m == pytest.approx(360)


def test_plume_decays_and_stays_below_the_lid(spark):
    p = lambda x, z: value(spark, physics.plume(F.lit(x), F.lit(0.0), F.lit(z), F.lit(20.0), F.lit(3.0), F.lit(300.0), F.lit(3)))
    assert p(2000.0, 2.0) > p(8000.0, 2.0) > 0 and p(2000.0, 400.0) == 0.0


def test_us_index_inverts_its_cubic(spark):
    c = physics.us_concentration("PM25", F.lit(120.0))
    assert value(spark, physics.us_index("PM25", c)) == pytest.approx(120.0, abs=0.2)


def test_trajectory_mass(spark):
    rows = spark.createDataFrame([("v", 0, 0.0, 0.0, 2.0), ("v", 600, 1000.0, 0.0, 2.0), ("v", 90000, 0.0, 0.0, 2.0)], "vessel string, sec long, y_m double, x_m double, rate double")
    pts = d.trajectory_points(rows, "vessel", 100.0)
    assert pts.agg(F.sum("mass")).first()[0] == pytest.approx(1200.0) and pts.count() == 14


def test_pairs_within_a_radius_anywhere(spark):
    from airloom.operators import spatial

    rows = [(f"p{k}", lat, lon) for k, (lat, lon) in enumerate([(75.0, 20.0), (84.0, 179.95), (84.0, -179.9), (0.0, 180.0), (0.001, -179.999), (-89.9, 10.0), (-89.9, 100.0), (60.0, 24.0), (60.01, 24.02), (75.0, 20.3)])]
    p = spark.createDataFrame(rows, "id string, lat double, lon double")
    t = p.select(F.col("id").alias("other"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    got = {(r.id, r.other) for r in spatial.within(p, t, 9000.0).collect()}
    want = set()
    for a, y, x in rows:
        for b, v, u in rows:
            turn = min((x - u - 360 * k for k in (-1, 0, 1)), key=abs)
            if math.hypot(y - v, math.cos(math.radians(v)) * turn) * geo.DEGREE_M < 9000:
                want.add((a, b))
    assert got == want and ("p1", "p2") in got and ("p3", "p4") in got and ("p0", "p9") in got


def test_lines_reach_both_ends(spark):
    rows = spark.createDataFrame([(0, 0, 4, 0), (2, 3, 2, 3), (5, 1, 0, -2)], "h0 long, w0 long, h1 long, w1 long")
    cells = {(r.h0, r.h, r.w) for r in d.line_cells(rows).collect()}
    assert {(0, h, 0) for h in range(5)} | {(2, 2, 3), (5, 5, 1), (5, 0, -2)} <= cells and len(cells) == 5 + 1 + 6
