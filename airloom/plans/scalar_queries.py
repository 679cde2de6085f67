"""Queries for scalar functions: geometry (G), dates (E), strings (R) and domain formulas (M)."""

from pyspark.sql import functions as F

from airloom.functions import color, geo, physics, text
from airloom.sources.adapters import CELLS, EMISSIONS, OBS, STATIONS, emissions, grid_cells, observations, seconds, stations, table

from .base import query

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x, n)
M = "6371000.0 * 2 * pi() / 360"
#: Angles and speeds of observations, for formulas on winds.
WIND = OBS + ", wind AS (SELECT event_id, CAST((sec // 60 * 7) % 360 AS DOUBLE) AS dir, value / 30.0 AS speed, CAST(event_id % 36 AS DOUBLE) * 10 AS heading, CAST(event_id % 5 AS DOUBLE) AS own FROM obs)"


def winds(spark, sf):
    o = observations(spark, sf)
    return o.select("event_id", ((F.floor(c("sec") / 60) * 7) % 360).cast("double").alias("dir"), (c("value") / 30.0).alias("speed"), ((c("event_id") % 36).cast("double") * 10).alias("heading"), (c("event_id") % 5).cast("double").alias("own"))


@query("G1_distance", f"WITH {STATIONS} SELECT station, round(sqrt(power(lat - 60.2, 2) + power(cos(radians(60.2)) * (lon - 24.5), 2)) * {M}, 3) AS metres FROM stations")
def g1(spark, sf):
    return stations(spark, sf).select("station", r(geo.distance_m(c("lat"), c("lon"), lit(60.2), lit(24.5)), 3).alias("metres"))


@query("G2_distance_squared", f"WITH {STATIONS} SELECT station, round((power(lat - 60.2, 2) + power(cos(radians(60.2)) * (lon - 24.5), 2)) * power({M}, 2) / 1000000.0, 4) AS km2 FROM stations")
def g2(spark, sf):
    return stations(spark, sf).select("station", r(F.pow(geo.distance_m(c("lat"), c("lon"), lit(60.2), lit(24.5)), 2) / 1e6).alias("km2"))


@query("G3_cell_index", f"WITH {STATIONS} SELECT station, CAST(floor((60.395 - lat) / 0.02) AS BIGINT) AS h, CAST(floor((lon - 24.005) / 0.03) AS BIGINT) AS w FROM stations")
def g3(spark, sf):
    h, w = geo.cell_of(c("lat"), c("lon"), 60.395, 24.005, 0.02, 0.03)
    return stations(spark, sf).select("station", h.alias("h"), w.alias("w"))


@query("G4_box_area", f"WITH {STATIONS} SELECT station, round(0.1 * {M} / 1000 * 0.2 * cos(radians(lat + 0.05)) * {M} / 1000, 4) AS km2, round(lat + 0.05, 4) AS mid FROM stations")
def g4(spark, sf):
    return stations(spark, sf).select("station", r(geo.box_area_km2(c("lat"), c("lat") + 0.1, c("lon"), c("lon") + 0.2)).alias("km2"), r(c("lat") + 0.05).alias("mid"))


@query("G5_metres_from_corner", f"WITH {STATIONS} SELECT station, round((lat - 60) * {M}, 3) AS north, round((lon - 24) * cos(radians(60.0)) * {M}, 3) AS east FROM stations")
def g5(spark, sf):
    n, e = geo.to_metres(c("lat"), c("lon"), lit(60.0), lit(24.0))
    return stations(spark, sf).select("station", r(n, 3).alias("north"), r(e, 3).alias("east"))


@query("G6_rotate", f"WITH {WIND} SELECT event_id, round(3 * cos(radians(dir)) - 4 * sin(radians(dir)), 4) + 0.0 AS h, round(4 * cos(radians(dir)) + 3 * sin(radians(dir)), 4) + 0.0 AS w FROM wind")
def g6(spark, sf):
    h, w = geo.rotated(lit(3.0), lit(4.0), c("dir"))
    return winds(spark, sf).select("event_id", (r(h) + 0.0).alias("h"), (r(w) + 0.0).alias("w"))


@query("G7_sector", f"WITH {STATIONS} SELECT station, CAST(floor(((degrees(atan2(lon - 24.4001, lat - 60.2001)) + 360) % 360) / 30) AS BIGINT) AS sector FROM stations")
def g7(spark, sf):
    return stations(spark, sf).select("station", geo.sector(c("lat") - 60.2001, c("lon") - 24.4001, 30).alias("sector"))


@query("G8_heading_to_cartesian", f"WITH {WIND} SELECT event_id, (450 - dir) % 360 AS angle FROM wind")
def g8(spark, sf):
    return winds(spark, sf).select("event_id", geo.heading_to_cartesian(c("dir")).alias("angle"))


@query("G9_apparent_wind", f"""WITH {WIND}, v AS (SELECT *, radians((450 - dir) % 360) AS a, radians((450 - heading) % 360) AS b FROM wind)
SELECT event_id, round(CASE WHEN own < 0.1 THEN speed ELSE sqrt(power(speed * cos(a) + own * cos(b), 2) + power(speed * sin(a) + own * sin(b), 2)) END, 4) AS speed FROM v""")
def g9(spark, sf):
    s, _ = geo.apparent_wind(c("speed"), c("dir"), c("own"), c("heading"))
    return winds(spark, sf).select("event_id", r(s).alias("speed"))


@query("G10_wind_components", f"""WITH {WIND}, v AS (SELECT event_id, speed * cos(radians(dir)) AS n, speed * sin(radians(dir)) AS e FROM wind)
SELECT event_id, round(CASE WHEN abs(n) < 0.001 THEN 0 ELSE -n END, 4) + 0.0 AS north, round(CASE WHEN abs(e) < 0.001 THEN 0 ELSE -e END, 4) + 0.0 AS east FROM v""")
def g10(spark, sf):
    n, e = geo.wind_components(c("dir"), c("speed"))
    return winds(spark, sf).select("event_id", (r(n) + 0.0).alias("north"), (r(e) + 0.0).alias("east"))


@query("G11_wind_direction", f"""WITH {WIND}, v AS (SELECT event_id, -speed * cos(radians(dir + 0.5)) AS n, -speed * sin(radians(dir + 0.5)) AS e FROM wind)
SELECT event_id, round((degrees(atan2(-e, -n)) + 360) % 360, 3) AS dir, round(greatest(0.1, sqrt(n * n + e * e)), 4) AS speed FROM v""")
def g11(spark, sf):
    n, e = -c("speed") * F.cos(F.radians(c("dir") + 0.5)), -c("speed") * F.sin(F.radians(c("dir") + 0.5))
    return winds(spark, sf).select("event_id", r(geo.wind_direction(n, e), 3).alias("dir"), r(geo.wind_speed(n, e)).alias("speed"))


ERFC = "CASE WHEN x < 0 THEN 2 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) ELSE t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) END"


@query("G13_erfc", f"WITH {OBS}, v AS (SELECT event_id, value / 100.0 - 1 AS x FROM obs), t AS (SELECT event_id, x, 1 / (1 + 0.3275911 * abs(x)) AS t FROM v) SELECT event_id, round({ERFC}, 6) AS erfc, round(asinh(x), 6) AS asinh FROM t")
def g13(spark, sf):
    x = c("value") / 100.0 - 1
    return observations(spark, sf).select("event_id", r(geo.erfc(x), 6).alias("erfc"), r(F.asinh(x), 6).alias("asinh"))


@query("G14_fixed_decimals", "SELECT c_custkey, round(c_acctbal, 1) AS a FROM customer")
def g14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r(c("c_acctbal"), 1).alias("a"))


@query("G15_quadratic", "SELECT p_partkey, round((8 - (4 * 4 - 8 - 4)) * power(p_size / 50.0, 2) + (4 * 4 - 8 - 4) * (p_size / 50.0) + 1, 4) AS y FROM part")
def g15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(geo.quadratic(c("p_size").cast("double"), 1, 4, 9, 50.0)).alias("y"))


@query("G16_curve", "SELECT p_partkey, round(1 + 4 * power(greatest(0, least(1, (p_size - 5) / 40.0)), 1.3), 4) AS y FROM part")
def g16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(geo.curve(c("p_size").cast("double"), 5.0, 45.0, 1.0, 5.0, 1.3)).alias("y"))


@query("G17_byte_codec", "WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) - min(p_retailprice) AS span FROM part), e AS (SELECT p_partkey, CAST(floor((p_retailprice - lo) * 250 / span - 125) AS BIGINT) AS code, lo, span FROM part, m) SELECT p_partkey, code, round((code + 125) * span / 250 + lo, 3) AS value FROM e")
def g17(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    lo, hi = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    e = p.withColumn("code", geo.byte_code(c("p_retailprice"), lit(lo), lit(hi - lo)).cast("long"))
    return e.select("p_partkey", "code", r(geo.byte_value(c("code"), lit(lo), lit(hi - lo)), 3).alias("value"))


@query("E1_parse_dates", f"WITH {OBS} SELECT event_id, sec FROM obs")
def e1(spark, sf):
    o = observations(spark, sf)
    forms = F.when(c("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(c("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = text.parsed_time(c("s")).cast("timestamp_ntz")
    return o.select("event_id", forms.alias("s")).withColumn("t", parsed).select("event_id", seconds("t").alias("sec"))


@query("E2_system_time", f"WITH {OBS} SELECT event_id, sec, sys_hour FROM obs")
def e2(spark, sf):
    return observations(spark, sf).select("event_id", "sec", "sys_hour")


@query("E3_zone_shift", f"WITH {OBS} SELECT event_id, hour(ts + INTERVAL 2 HOUR) AS local_hour, (sec + 7200) // 3600 AS local_sys_hour FROM obs")
def e3(spark, sf):
    return observations(spark, sf).select("event_id", F.expr("hour(ts + INTERVAL 2 HOURS)").cast("long").alias("local_hour"), F.floor((c("sec") + 7200) / 3600).alias("local_sys_hour"))


@query("E5_date_formats", f"WITH {OBS} SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS file_name, 'T' || strftime(ts, '%H') AS hour FROM obs")
def e5(spark, sf):
    return observations(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss").alias("file_name"), F.concat(lit("T"), F.date_format("ts", "HH")).alias("hour"))


@query("E6_day_of_year", f"WITH {EMISSIONS} SELECT DISTINCT day, dayofyear(day) AS doy, ((dayofyear(day) - 1) * 24) // 168 AS week FROM emissions")
def e6(spark, sf):
    return emissions(spark, sf).select("day").distinct().select("day", F.dayofyear("day").cast("long").alias("doy"), F.floor((F.dayofyear("day") - 1) * 24 / 168).alias("week"))


@query("E7_day_of_week", f"WITH {EMISSIONS} SELECT DISTINCT day, dayofweek(day) + 1 AS dow, month(day) - 1 AS month0 FROM emissions")
def e7(spark, sf):
    return emissions(spark, sf).select("day").distinct().select("day", F.dayofweek("day").cast("long").alias("dow"), (F.month("day") - 1).cast("long").alias("month0"))


@query("E8_day_type", f"WITH {EMISSIONS} SELECT DISTINCT day, CASE dayofweek(day) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS day_type FROM emissions")
def e8(spark, sf):
    return emissions(spark, sf).select("day").distinct().select("day", F.when(F.dayofweek("day") == 7, 1).when(F.dayofweek("day") == 1, 2).otherwise(0).alias("day_type"))


@query("E9_source_zone_fix", f"WITH {OBS}, {STATIONS} SELECT event_id, sec - tz * 3600 AS utc_sec FROM obs JOIN stations ON alias1 = source_id")
def e9(spark, sf):
    s = stations(spark, sf).select(c("alias1").alias("source_id"), "tz")
    return observations(spark, sf).join(s, "source_id").select("event_id", (c("sec") - c("tz") * 3600).alias("utc_sec"))


@query("E10_span_overlap", "SELECT o_orderkey, o_orderdate <= TIMESTAMP '1996-06-30' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1996-01-01' AS overlaps FROM orders")
def e10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr("CAST(o_orderdate AS timestamp_ntz) <= timestamp_ntz'1996-06-30' AND CAST(o_orderdate AS timestamp_ntz) + INTERVAL 30 DAYS >= timestamp_ntz'1996-01-01'").alias("overlaps"))


@query("E11_season_and_month", f"WITH {EMISSIONS} SELECT DISTINCT day, CASE WHEN month(day) IN (12, 1, 2) THEN 0 WHEN month(day) < 6 THEN 1 WHEN month(day) < 9 THEN 2 ELSE 3 END AS season, CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS month_before FROM emissions")
def e11(spark, sf):
    m = F.month("day")
    return emissions(spark, sf).select("day").distinct().select("day", F.when(m.isin(12, 1, 2), 0).when(m < 6, 1).when(m < 9, 2).otherwise(3).alias("season"), F.add_months(F.trunc("day", "month"), -1).alias("month_before"))


@query("E12_special_day", f"WITH {EMISSIONS} SELECT DISTINCT day, CASE WHEN (month(day), day(day)) IN ((1, 1), (12, 24), (12, 25), (12, 26)) THEN 1 WHEN (month(day), day(day)) = (12, 6) THEN 1 ELSE dayofweek(day) + 1 END AS dow_key FROM emissions")
def e12(spark, sf):
    md = F.month("day") * 100 + F.dayofmonth("day")
    return emissions(spark, sf).select("day").distinct().select("day", F.when(md.isin(101, 1206, 1224, 1225, 1226), 1).otherwise(F.dayofweek("day")).cast("long").alias("dow_key"))


@query("R1_tag", "SELECT p_partkey, nullif(regexp_extract('TYPE<' || p_type || '>,SIZE<' || CAST(p_size AS VARCHAR) || '>', '(?:^|[^A-Za-z0-9_])SIZE<([^<>]*)>', 1), '') AS size FROM part")
def r1(spark, sf):
    s = F.concat(lit("TYPE<"), c("p_type"), lit(">,SIZE<"), c("p_size").cast("string"), lit(">"))
    return table(spark, sf, "part").select("p_partkey", text.tag(s, "SIZE").alias("size"))


@query("R2_pairs", "SELECT p_partkey, p_size * 2 AS b FROM part")
def r2(spark, sf):
    s = F.concat(lit("a="), c("p_size").cast("string"), lit(",b="), (c("p_size") * 2).cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.pairs(s)["b"].cast("int").alias("b"))


@query("R3_short_id", "SELECT s_suppkey, upper(array_to_string(string_split(replace(s_name, '#', '_') || '_x_y_z', '_')[1:3], '_')) AS id FROM supplier")
def r3(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.short_id(F.concat(F.regexp_replace("s_name", "#", "_"), lit("_x_y_z"))).alias("id"))


@query("R4_clean_id", "SELECT s_suppkey, regexp_replace(trim(s_name), '[^A-Za-z0-9]+', '_', 'g') AS id FROM supplier")
def r4(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.clean_id(c("s_name")).alias("id"))


@query("R5_pad", "SELECT n_nationkey, rpad(n_name, 20, ' ') || '|' AS name FROM nation")
def r5(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.rpad("n_name", 20, " "), lit("|")).alias("name"))


@query("M1_imprecision", f"WITH {STATIONS} SELECT station, round(greatest(1, least(1000, power(imprecision, 1.4) * 2)), 5) AS imprecision FROM stations")
def m1(spark, sf):
    return stations(spark, sf).select("station", r(physics.imprecision(c("imprecision"), 2.0), 5).alias("imprecision"))


@query("M2_observation_variance", f"WITH {OBS} SELECT event_id, round(20 * (1 + maturity / 48.0) * 1.5 * (1 + 10 * 0.3) * (1 + least(abs(sid - 3), 35)), 5) AS variance FROM obs")
def m2(spark, sf):
    v = physics.observation_variance("NO2", c("maturity"), lit(1.5), 0.3, c("sid") - 3)
    return observations(spark, sf).select("event_id", r(v, 5).alias("variance"))


@query("M3_temporal_variance", "SELECT p_partkey, round(0.0302 * power(least(p_size, 35), 3) - 1.7555 * power(least(p_size, 35), 2) + 32.061 * least(p_size, 35) + 20, 4) AS variance FROM part")
def m3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(physics.temporal_variance("PM10", c("p_size").cast("double"))).alias("variance"))


@query("M4_index", f"""WITH {OBS}, i AS (SELECT event_id, 1 + 4 * power(greatest(0, least(1, value / 200)), 1.3) AS a, 1 + 4 * power(greatest(0, least(1, (value - 10) / 140)), 1.0) AS b FROM obs)
SELECT event_id, round(greatest(a, b), 4) AS by_max, round((a * a + b * b) / (a + b), 4) AS self_weighted, round((a + b) / 2, 4) AS equal FROM i""")
def m4(spark, sf):
    parts = [physics.index_of(c("value"), 0.0, 200.0, 1.3), physics.index_of(c("value"), 10.0, 150.0, 1.0)]
    return observations(spark, sf).select("event_id", *[r(physics.combined_index(parts, h)).alias(n) for h, n in (("max", "by_max"), ("self", "self_weighted"), ("equal", "equal"))])


@query("M5_us_concentration", "SELECT p_partkey, round(CASE WHEN p_size * 9 > 150 THEN 1.3e-5 * power(p_size * 9, 3) - 0.0131 * power(p_size * 9, 2) + 5.0726 * (p_size * 9) - 455.22 ELSE 0.000874 * power(p_size * 9, 2) + 0.2405 * (p_size * 9) END, 4) AS pm25 FROM part")
def m5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(physics.us_concentration("PM25", c("p_size") * 9.0)).alias("pm25"))


@query("M6_affine", f"WITH {OBS} SELECT event_id, round(0.6 * greatest(value, 5) + 1.5 * least(CAST(maturity AS DOUBLE), 1), 4) AS y FROM obs")
def m6(spark, sf):
    f = text.affine("AFFINE<0.6*VALUE+1.5*MATURITY>,VALUE_MIN<5>,MATURITY_MAX<1>")
    return observations(spark, sf).select("event_id", r(f(lambda n: c(n.lower()).cast("double"))).alias("y"))


@query("M7_stability", f"WITH {WIND} SELECT event_id, CASE WHEN dir - 60 <= 0 THEN 3 WHEN dir - 60 < 100 THEN CASE WHEN speed <= 3 THEN 2 ELSE 3 END WHEN dir - 60 < 250 THEN CASE WHEN speed <= 3 THEN 1 ELSE 2 END ELSE CASE WHEN speed <= 3 THEN 0 ELSE 1 END END AS by_radiation, CASE WHEN x < -0.056 THEN 0 WHEN x < -0.016 THEN 1 WHEN x < -0.004 THEN 2 ELSE 3 END AS by_length FROM (SELECT *, (dir - 180) / 2500 AS x FROM wind)")
def m7(spark, sf):
    return winds(spark, sf).select("event_id", physics.stability_from_radiation(c("dir") - 60, c("speed")).alias("by_radiation"), physics.stability_from_length((c("dir") - 180) / 2500).alias("by_length"))


@query("M8_stability_at_height", "SELECT p_partkey, least(4, p_size % 4 + CAST(floor(p_size * 2 / 30.0) AS BIGINT)) AS cls FROM part")
def m8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", physics.stability_at_height(c("p_size") % 4, c("p_size") * 2).alias("cls"))


@query("M9_shortwave", f"WITH {WIND} SELECT event_id, round(greatest(0, dir * 2 - 100) * least(1, 0.2 + 2 / (own + 1)), 4) AS rad FROM wind")
def m9(spark, sf):
    return winds(spark, sf).select("event_id", r(physics.shortwave(c("dir") * 2 - 100, c("own"))).alias("rad"))


@query("M10_log_wind", f"WITH {WIND} SELECT event_id, round(speed * ln(greatest(heading, 2) / greatest(0.01, least(2, own / 10))) / ln(10 / 0.2), 4) AS speed FROM wind")
def m10(spark, sf):
    return winds(spark, sf).select("event_id", r(physics.log_wind(c("speed"), c("own") / 10, c("heading"))).alias("speed"))


@query("M13_temporal_profile", f"WITH {OBS} SELECT event_id, round((1 + 0.5 * sin(hour(ts) * pi() / 12)) * CASE WHEN dayofweek(ts) IN (0, 6) THEN 0.7 ELSE 1.0 END * CASE WHEN month(ts) IN (12, 1, 2) THEN 1.2 ELSE 1.0 END, 5) AS factor FROM obs")
def m13(spark, sf):
    diurnal = 1 + 0.5 * F.sin(F.hour("ts") * (lit(3.141592653589793) / 12))
    f = diurnal * F.when(F.dayofweek("ts").isin(1, 7), 0.7).otherwise(1.0) * F.when(F.month("ts").isin(12, 1, 2), 1.2).otherwise(1.0)
    return observations(spark, sf).select("event_id", r(f, 5).alias("factor"))


@query("M14_met_scaler", f"WITH {WIND} SELECT event_id, round(0.5 + 1.5 * power(greatest(0, least(1, speed / 10)), 0.8), 5) AS factor FROM wind")
def m14(spark, sf):
    return winds(spark, sf).select("event_id", r(geo.curve(c("speed"), 0.0, 10.0, 0.5, 2.0, 0.8), 5).alias("factor"))


@query("M17_nox_split", f"WITH {EMISSIONS} SELECT cat, round(sum(rate) * 0.85, 2) AS no2, round(sum(rate) * 0.15, 2) AS no, round(sum(rate) * -0.65, 2) AS o3 FROM emissions GROUP BY cat")
def m17(spark, sf):
    no2, no, o3 = physics.nox_split(c("x"))
    return emissions(spark, sf).groupBy("cat").agg(F.sum("rate").alias("x")).select("cat", r(no2, 2).alias("no2"), r(no, 2).alias("no"), r(o3, 2).alias("o3"))


@query("M20_decay", f"WITH {WIND} SELECT event_id, round(exp(-0.02 * speed), 6) AS kept FROM wind")
def m20(spark, sf):
    return winds(spark, sf).select("event_id", r(F.exp(-0.02 * c("speed")), 6).alias("kept"))


@query("M21_dispersion", "SELECT p_partkey, round(0.16 * x * power(1 + 0.0004 * x, -0.5), 4) AS sigma_y, round(0.14 * x * power(1 + 0.003 * x, -0.5), 4) AS sigma_z FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def m21(spark, sf):
    x = c("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", r(physics.sigma_y(x, "D")).alias("sigma_y"), r(physics.sigma_z(x, "D")).alias("sigma_z"))


@query("M22_vertical_terms", """WITH s AS (SELECT p_partkey, power(0.14 * p_retailprice * power(1 + 0.003 * p_retailprice, -0.5), 2) / 2 AS rz, CAST(p_size AS DOUBLE) AS h FROM part)
SELECT p_partkey, round(exp(-power(2 - h, 2) / 4 / rz) + exp(-power(2 + h, 2) / 4 / rz), 6) AS free,
round((0.5 + cos(pi() / 300 * 2) * cos(pi() / 300 * h) * exp(-rz * power(pi() / 300, 2)) + cos(2 * pi() / 300 * 2) * cos(2 * pi() / 300 * h) * exp(-rz * power(2 * pi() / 300, 2)) + cos(3 * pi() / 300 * 2) * cos(3 * pi() / 300 * h) * exp(-rz * power(3 * pi() / 300, 2))) / 300, 8) AS lid,
round(exp(0.02 * (2 - h) / -10 - 0.0004 * rz / 100), 6) AS settling FROM s""")
def m22(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", (F.pow(physics.sigma_z(c("p_retailprice"), "D"), 2) / 2).alias("rz"), c("p_size").cast("double").alias("h"))
    z = lit(2.0)
    return s.select("p_partkey", r(physics.reflection(c("rz"), z, c("h")), 6).alias("free"), r(physics.lid_series(c("rz"), z, c("h"), lit(300.0), 3), 8).alias("lid"), r(physics.settling(c("rz"), z, c("h")), 6).alias("settling"))


@query("M25_wind_fan", f"WITH {WIND}, f AS (SELECT event_id, unnest(CASE WHEN speed <= 0.3 THEN [0.0, 60, 120, 180, 240, 300] WHEN speed <= 0.6 THEN [dir, (dir + 30) % 360, (dir + 330) % 360] WHEN speed <= 0.8 THEN [(dir + 350) % 360, (dir + 10) % 360] ELSE [dir] END) AS dir FROM wind) SELECT event_id, CAST(dir AS DOUBLE) AS dir FROM f")
def m25(spark, sf):
    return winds(spark, sf).select("event_id", F.explode(physics.wind_fan(c("dir"), c("speed"))).alias("dir"))


@query("M26_distance_ramp", "SELECT p_partkey, round(CASE WHEN p_size - 5 <= 0 THEN 1 ELSE least(greatest(p_retailprice / 100, 1), p_size - 5) / (p_size - 5) END, 7) AS ramp FROM part")
def m26(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(physics.distance_ramp((c("p_size") - 5).cast("double"), c("p_retailprice") / 100), 7).alias("ramp"))


@query("M27_transport_wind", f"WITH {WIND} SELECT event_id, round(greatest(0.4, least(0.8, heading * 2 / 500)) * speed + (1 - greatest(0.4, least(0.8, heading * 2 / 500))) * own, 5) AS speed FROM wind")
def m27(spark, sf):
    return winds(spark, sf).select("event_id", r(physics.transport_wind(c("speed"), c("own"), c("heading") * 2), 5).alias("speed"))


@query("G18_colours", "WITH k AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS rgb FROM part), c AS (SELECT p_partkey, rgb // 65536 % 256 AS r, rgb // 256 % 256 AS g, rgb % 256 AS b FROM k), m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM c) SELECT p_partkey, round(CASE WHEN d = 0 THEN 0 WHEN r = t THEN ((g - b) / d * 60 + 360) % 360 WHEN g = t THEN 120 + (b - r) / d * 60 ELSE 240 + (r - g) / d * 60 END, 4) AS hue, round(CASE WHEN t = 0 THEN 0 ELSE d / t END, 6) AS saturation, round(t / 255, 6) AS brightness FROM m")
def g18(spark, sf):
    h, s, b = color.hsb(*color.channels((c("p_partkey") * 7919) % 16777216))
    return table(spark, sf, "part").select("p_partkey", r(h).alias("hue"), r(s, 6).alias("saturation"), r(b, 6).alias("brightness"))


@query("S24_unit_conversion", f"WITH {OBS} SELECT event_id, round(value * CASE maturity WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 46.0055 END, 3) AS ug FROM obs")
def s24(spark, sf):
    return observations(spark, sf).select("event_id", r(c("value") * F.when(c("maturity") == 0, 1.0).when(c("maturity") == 1, 1000.0).otherwise(46.0055), 3).alias("ug"))
