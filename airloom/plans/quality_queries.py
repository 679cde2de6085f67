"""Queries for filters (F), deduplication (D), aggregation (A), top-k (T) and set operations (U)."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from airloom.operators import quality as q
from airloom.sources.adapters import CELLS, EMISSIONS, OBS, STATIONS, emissions, grid_cells, observations, stations, table
from airloom.sources.store import written

from .base import TIE, query

LO, HI = 0.0, 300.0
HOURLY = (
    OBS
    + """,
classes AS (SELECT var, source_id, sys_hour, maturity, sum(value) AS s, count(*) AS n FROM obs WHERE value BETWEEN 0 AND 300 GROUP BY ALL),
hourly AS (SELECT var, source_id, sys_hour, min(maturity) AS maturity, arg_min(s / n, maturity) AS value, arg_min(n, maturity) AS n FROM classes GROUP BY ALL)"""
)


def hourly(spark, sf):
    """Accepted observations, one for each series and hour."""
    return q.slots(q.accepted(observations(spark, sf), LO, HI).filter("accepted"))


@query("F1_value_acceptance", f"WITH {OBS} SELECT event_id, var, greatest(value, 0) AS value, greatest(value, 0) BETWEEN 0 AND 300 AS accepted FROM obs")
def f1(spark, sf):
    return q.accepted(observations(spark, sf), LO, HI).select("event_id", "var", "value", "accepted")


@query("F2_grid_acceptance", f"WITH {CELLS} SELECT h, count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(*) > 0 AND min(value) >= 900 AND max(value) <= 1900 AS acceptable FROM cells GROUP BY h")
def f2(spark, sf):
    v = F.col("value")
    g = grid_cells(spark, sf).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), 4).alias("lo"), F.round(F.max(v), 4).alias("hi"), F.count_if(v.isNull() | F.isnan(v)).alias("bad"))
    return g.select("h", "n", "lo", "hi", ((F.col("n") > 0) & (F.col("bad") == 0) & (F.col("lo") >= 900) & (F.col("hi") <= 1900)).alias("acceptable"))


@query("F3_rule_search", f"WITH {OBS} SELECT event_id, var, source_id FROM obs WHERE hour(ts) IN (6, 7, 8, 16, 17) AND month(ts) IN (1, 2) AND dayofweek(ts) + 1 IN (2, 3, 4, 5, 6) AND value BETWEEN 10 AND 200")
def f3(spark, sf):
    o = observations(spark, sf)
    return o.filter(F.hour("ts").isin(6, 7, 8, 16, 17) & F.month("ts").isin(1, 2) & F.dayofweek("ts").isin(2, 3, 4, 5, 6) & F.col("value").between(10, 200)).select("event_id", "var", "source_id")


@query("F4_source_search", f"WITH {OBS} SELECT source_id, count(*) AS n FROM obs WHERE hour(ts) IN (0, 1, 2) GROUP BY source_id")
def f4(spark, sf):
    return observations(spark, sf).filter(F.hour("ts").isin(0, 1, 2)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("F5_box_containment", f"WITH {STATIONS} SELECT station, lat BETWEEN 60.1 AND 60.3 AND lon BETWEEN 24.2 AND 24.6 AS inside FROM stations")
def f5(spark, sf):
    return stations(spark, sf).select("station", (F.col("lat").between(60.1, 60.3) & F.col("lon").between(24.2, 24.6)).alias("inside"))


@query("F6_box_overlap", f"WITH {STATIONS} SELECT station, lat <= 60.25 AND lat + 0.05 >= 60.2 AND lon <= 24.5 AND lon + 0.05 >= 24.4 AS overlaps FROM stations")
def f6(spark, sf):
    return stations(spark, sf).select("station", ((F.col("lat") <= 60.25) & (F.col("lat") + 0.05 >= 60.2) & (F.col("lon") <= 24.5) & (F.col("lon") + 0.05 >= 24.4)).alias("overlaps"))


@query("F7_box_full_containment", f"WITH {STATIONS} SELECT station, lat - 0.05 >= 60 AND lat + 0.05 <= 60.4 AND lon - 0.05 >= 24 AND lon + 0.05 <= 24.8 AS contained FROM stations")
def f7(spark, sf):
    return stations(spark, sf).select("station", ((F.col("lat") - 0.05 >= 60) & (F.col("lat") + 0.05 <= 60.4) & (F.col("lon") - 0.05 >= 24) & (F.col("lon") + 0.05 <= 24.8)).alias("contained"))


@query("F8_open_containment", f"WITH {STATIONS} SELECT station FROM stations WHERE lat > 60.005 AND lat < 60.395 AND lon > 24.005 AND lon < 24.705")
def f8(spark, sf):
    return stations(spark, sf).filter("lat > 60.005 and lat < 60.395 and lon > 24.005 and lon < 24.705").select("station")


@query("F11_source_bans", f"WITH {OBS}, bans AS (SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS source_id FROM supplier WHERE s_acctbal < 0) SELECT event_id FROM obs WHERE source_id NOT IN (SELECT source_id FROM bans)")
def f11(spark, sf):
    bans = stations(spark, sf).filter("s_acctbal < 0").select(F.col("alias1").alias("source_id")).distinct()
    return observations(spark, sf).join(bans, "source_id", "left_anti").select("event_id")


@query("F12_emitter_relevance", f"""WITH {EMISSIONS} SELECT emitter, CASE WHEN max(rate) <= 0 THEN 'zero' WHEN min(h) > 30 OR max(h) < 5 THEN 'outside' WHEN max(day) < DATE '1996-01-01' THEN 'past' ELSE 'relevant' END AS reason FROM emissions GROUP BY emitter""")
def f12(spark, sf):
    e = emissions(spark, sf).groupBy("emitter").agg(F.max("rate").alias("r"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("day").alias("day"))
    why = F.when(F.col("r") <= 0, "zero").when((F.col("lo") > 30) | (F.col("hi") < 5), "outside").when(F.col("day") < F.lit("1996-01-01").cast("date"), "past").otherwise("relevant")
    return e.select("emitter", why.alias("reason"))


@query("F13_load_span", f"WITH {OBS} SELECT event_id FROM obs WHERE sys_hour BETWEEN 473400 AND 473800")
def f13(spark, sf):
    return observations(spark, sf).filter(F.col("sys_hour").between(473400, 473800)).select("event_id")


@query("F14_quality_limit", f"WITH {STATIONS} SELECT station FROM stations WHERE imprecision < 4")
def f14(spark, sf):
    return stations(spark, sf).filter("imprecision < 4").select("station")


@query("F15_nested_box_keep", f"WITH {CELLS} SELECT p_partkey, CASE WHEN h BETWEEN 10 AND 20 AND w BETWEEN 10 AND 40 THEN 'inner' WHEN h BETWEEN 5 AND 30 AND w BETWEEN 5 AND 45 AND value > 1200 THEN 'outer' ELSE 'discard' END AS zone FROM cells")
def f15(spark, sf):
    inner = F.col("h").between(10, 20) & F.col("w").between(10, 40)
    outer = F.col("h").between(5, 30) & F.col("w").between(5, 45) & (F.col("value") > 1200)
    return grid_cells(spark, sf).select("p_partkey", F.when(inner, "inner").when(outer, "outer").otherwise("discard").alias("zone"))


@query("F16_stationary", f"WITH {OBS} SELECT source_id, max(lat) - min(lat) < 0.001 AND max(lon) - min(lon) < 0.001 AS stationary FROM obs GROUP BY source_id")
def f16(spark, sf):
    return q.stationary(observations(spark, sf))


@query("F17_grid_to_points", f"WITH {CELLS} SELECT round(61.0 - h * 0.01, 4) AS lat, round(24.0 + w * 0.02, 4) AS lon, value FROM cells")
def f17(spark, sf):
    return grid_cells(spark, sf).select(F.round(61.0 - F.col("h") * 0.01, 4).alias("lat"), F.round(24.0 + F.col("w") * 0.02, 4).alias("lon"), "value")


@query("F18_points_to_grid", f"WITH {OBS} SELECT sid AS h, sys_hour % 24 AS w, arg_max(value, event_id) AS value FROM obs GROUP BY ALL")
def f18(spark, sf):
    return observations(spark, sf).groupBy(F.col("sid").alias("h"), (F.col("sys_hour") % 24).alias("w")).agg(F.max_by("value", "event_id").alias("value"))


@query("F19_grid_add", f"WITH {EMISSIONS} SELECT h, w, round(sum(rate), 3) AS total FROM emissions WHERE h BETWEEN 0 AND 29 AND w BETWEEN 0 AND 29 GROUP BY h, w")
def f19(spark, sf):
    return emissions(spark, sf).filter(F.col("h").between(0, 29) & F.col("w").between(0, 29)).groupBy("h", "w").agg(F.round(F.sum("rate"), 3).alias("total"))


@query("F20_grid_flip", f"WITH {CELLS} SELECT (SELECT max(h) FROM cells) - h AS h, w, round(value * 0.5, 4) AS value FROM cells")
def f20(spark, sf):
    g = grid_cells(spark, sf)
    top = g.agg(F.max("h")).first()[0] or 0
    return g.select((F.lit(top) - F.col("h")).alias("h"), "w", F.round(F.col("value") * 0.5, 4).alias("value"))


@query("D1_slot_dedupe", f"WITH {HOURLY} SELECT var, source_id, sys_hour, maturity, round(value, 4) AS value, n FROM hourly")
def d1(spark, sf):
    return hourly(spark, sf).withColumn("value", F.round("value", 4))


@query("D2_grid_slot_dedupe", f"WITH {OBS} SELECT var, sys_hour, min(maturity) AS maturity, arg_min(event_id, maturity * 1000000000 + event_id) AS event_id FROM obs GROUP BY var, sys_hour")
def d2(spark, sf):
    rows = observations(spark, sf).select("var", "sys_hour", "maturity", "event_id")
    return q.first_of_slot(rows, ["var", "sys_hour"], ["maturity", "event_id"])


@query("D3_once_an_hour", f"WITH {OBS} SELECT DISTINCT var, sys_hour FROM obs")
def d3(spark, sf):
    return observations(spark, sf).select("var", "sys_hour").dropDuplicates()


@query("A1_moments", f"WITH {HOURLY} SELECT var, source_id, round(avg(value) + {TIE}, 4) AS mean, round(var_pop(value), 3) AS variance, round(stddev_pop(value), 4) AS std FROM hourly GROUP BY var, source_id")
def a1(spark, sf):
    return hourly(spark, sf).groupBy("var", "source_id").agg(F.round(F.avg("value") + TIE, 4).alias("mean"), F.round(F.var_pop("value"), 3).alias("variance"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query("A2_min_max_mean", f"WITH {CELLS} SELECT round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(avg(value), 4) AS mean FROM cells")
def a2(spark, sf):
    return grid_cells(spark, sf).agg(F.round(F.min("value"), 4).alias("lo"), F.round(F.max("value"), 4).alias("hi"), F.round(F.avg("value"), 4).alias("mean"))


@query("A3_lagged_covariance", f"WITH {HOURLY}, lags AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS lag) SELECT a.var, a.source_id, CAST(lag AS BIGINT) AS lag, round(avg((b.value - a.value) * (b.value - a.value)), 2) AS covar FROM hourly a CROSS JOIN lags JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour + lag GROUP BY ALL")
def a3(spark, sf):
    s = hourly(spark, sf)
    later = s.select(*q.SERIES, "sys_hour", F.col("value").alias("other"))
    early = s.select(*q.SERIES, "value", F.posexplode(F.sequence(F.col("sys_hour") + 1, F.col("sys_hour") + 6)).alias("lag", "sys_hour"))
    pairs = early.join(later, [*q.SERIES, "sys_hour"])
    return pairs.groupBy(*q.SERIES, (F.col("lag") + 1).cast("long").alias("lag")).agg(F.round(F.avg(F.pow(F.col("other") - F.col("value"), 2)), 2).alias("covar"))


COVAR = """pairs AS (SELECT a.var, a.source_id, a.sys_hour, (b.value - a.value) * (b.value - a.value) AS sq FROM hourly a JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour + 1),
both_ways AS (SELECT var, source_id, sys_hour % 24 AS hour, sq AS pos, NULL AS neg FROM pairs UNION ALL SELECT var, source_id, (sys_hour + 1) % 24, NULL, sq FROM pairs),
sums AS (SELECT var, source_id, hour, coalesce(sum(pos), 0) / (count(pos) + 0.0001) AS pos, coalesce(sum(neg), 0) / (count(neg) + 0.0001) AS neg, count(neg) AS n_neg FROM both_ways GROUP BY ALL),
covar AS (SELECT var, source_id, hour, CASE WHEN n_neg = 0 OR pos < neg THEN pos ELSE neg END AS covar FROM sums),
overall AS (SELECT var, source_id, avg(sq) AS overall FROM pairs GROUP BY ALL)"""


@query("A4_diurnal_covariance", f"WITH {HOURLY}, {COVAR} SELECT var, source_id, hour, round(covar, 3) AS covar FROM covar")
def a4(spark, sf):
    return q.hour_covariance(hourly(spark, sf)).withColumn("covar", F.round("covar", 3))


@query("A5_overall_covariance", f"WITH {HOURLY}, {COVAR} SELECT var, source_id, round(overall, 3) AS overall FROM overall")
def a5(spark, sf):
    return q.overall_covariance(hourly(spark, sf)).withColumn("overall", F.round("overall", 3))


@query("A6_covariance_fallback", f"WITH {HOURLY}, {COVAR}, spread AS (SELECT var, source_id, var_pop(value) AS variance FROM hourly GROUP BY ALL) SELECT s.var, s.source_id, CAST(h.hour AS BIGINT) AS hour, round(coalesce(c.covar, o.overall, s.variance), 3) AS covar FROM spread s CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN covar c ON c.var = s.var AND c.source_id = s.source_id AND c.hour = h.hour LEFT JOIN overall o ON o.var = s.var AND o.source_id = s.source_id")
def a6(spark, sf):
    s = written(hourly(spark, sf))
    base = s.groupBy(*q.SERIES).agg(F.var_pop("value").alias("variance")).withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    found = base.join(q.hour_covariance(s), [*q.SERIES, "hour"], "left").join(q.overall_covariance(s), q.SERIES, "left")
    return found.select(*q.SERIES, "hour", F.round(F.coalesce("covar", "overall", "variance"), 3).alias("covar"))


METRES = "6371000.0 * 2 * pi() / 360"


@query("A7_max_within_distance", f"WITH {OBS} SELECT var, sys_hour, max(value) AS hi FROM obs WHERE sqrt(power(lat - 60.12, 2) + power(cos(radians(60.12)) * (lon - 24.72), 2)) * {METRES} < 4000 GROUP BY ALL")
def a7(spark, sf):
    from airloom.functions.geo import distance_m

    near = distance_m(F.col("lat"), F.col("lon"), F.lit(60.12), F.lit(24.72)) < 4000
    return observations(spark, sf).filter(near).groupBy("var", "sys_hour").agg(F.max("value").alias("hi"))


@query("A8_range_in_box", f"WITH {OBS} SELECT var, min(value) AS lo, max(value) AS hi FROM obs WHERE lat BETWEEN 60.11 AND 60.19 AND sys_hour BETWEEN 473400 AND 473900 GROUP BY var")
def a8(spark, sf):
    return observations(spark, sf).filter(F.col("lat").between(60.11, 60.19) & F.col("sys_hour").between(473400, 473900)).groupBy("var").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("A9_span_and_bounds", f"WITH {OBS} SELECT var, min(sec) AS first_sec, max(sec) AS last_sec, round(min(lat), 4) AS latmin, round(max(lat), 4) AS latmax, round(min(lon), 4) AS lonmin, round(max(lon), 4) AS lonmax FROM obs GROUP BY var")
def a9(spark, sf):
    r = lambda f, c: F.round(f(c), 4)
    return observations(spark, sf).groupBy("var").agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), r(F.min, "lat").alias("latmin"), r(F.max, "lat").alias("latmax"), r(F.min, "lon").alias("lonmin"), r(F.max, "lon").alias("lonmax"))


@query("A10_distinct_coordinates", f"WITH {OBS} SELECT DISTINCT round(lat, 4) AS lat, round(lon, 4) AS lon FROM obs")
def a10(spark, sf):
    return observations(spark, sf).select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).distinct()


@query("A11_percentile_cap", f"WITH {CELLS}, ranked AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM cells), cut AS (SELECT max(value) AS top FROM ranked WHERE k = CAST(floor(n * 0.95) AS BIGINT)) SELECT p_partkey, least(value, (SELECT top FROM cut)) AS capped FROM cells")
def a11(spark, sf):
    return q.capped_at_percentile(grid_cells(spark, sf), 0.95).select("p_partkey", "capped")


@query("A12_display_range", f"WITH {CELLS}, {OBS} SELECT round((SELECT min(value) FROM cells), 4) AS lo, round(greatest((SELECT quantile_disc(value, 0.998) FROM cells), (SELECT quantile_disc(value, 0.96) FROM obs)), 4) AS hi")
def a12(spark, sf):
    cells, at = grid_cells(spark, sf), lambda p: lambda n: max(0, math.ceil(n * p) - 1)
    tops = [x for x in (q.value_at(cells, at(0.998)), q.value_at(observations(spark, sf), at(0.96))) if x is not None]
    return cells.agg(F.round(F.min("value"), 4).alias("lo")).withColumn("hi", F.round(F.lit(max(tops, default=None)).cast("double"), 4))


@query("A14_weight_percent", f"WITH {STATIONS} SELECT station, round(100 * (1 / imprecision) / (SELECT sum(1 / imprecision) FROM stations), 6) AS percent FROM stations")
def a14(spark, sf):
    s = stations(spark, sf).withColumns({"w": 1 / F.col("imprecision"), "all": F.lit(1)})
    return q.with_share(s, "w", ["all"]).select("station", F.round(100 * F.col("share"), 6).alias("percent"))


@query("A15_variance_of_new_station", f"WITH {STATIONS}, t AS (SELECT sum(1 / (imprecision + 0.001)) AS w FROM stations) SELECT s.station, round(1 / (t.w + 1 / (s.imprecision + 0.001)), 8) AS variance FROM stations s, t")
def a15(spark, sf):
    s = stations(spark, sf).select("station", (1 / (F.col("imprecision") + 0.001)).alias("w"), F.lit(1).alias("one"))
    return s.join(s.groupBy("one").agg(F.sum("w").alias("all")), "one").select("station", F.round(1 / (F.col("all") + F.col("w")), 8).alias("variance"))


@query("A18_sparse_accumulate", f"WITH {OBS} SELECT (sec // 10800) * 10800 AS t_key, sid AS h, sys_hour % 7 AS w, round(sum(value), 3) AS total FROM obs GROUP BY ALL")
def a18(spark, sf):
    return observations(spark, sf).groupBy((F.floor(F.col("sec") / 10800) * 10800).alias("t_key"), F.col("sid").alias("h"), (F.col("sys_hour") % 7).alias("w")).agg(F.round(F.sum("value"), 3).alias("total"))


@query("A19_sparse_totals", f"WITH {OBS} SELECT var, sid, round(sum(value), 2) AS total FROM obs GROUP BY ROLLUP (var, sid)")
def a19(spark, sf):
    return observations(spark, sf).rollup("var", "sid").agg(F.round(F.sum("value"), 2).alias("total"))


@query("A20_hourly_profile", f"WITH {HOURLY} SELECT var, sys_hour % 24 AS hour, round(avg(value) + {TIE}, 4) AS mean FROM hourly GROUP BY ALL")
def a20(spark, sf):
    return hourly(spark, sf).groupBy("var", (F.col("sys_hour") % 24).alias("hour")).agg(F.round(F.avg("value") + TIE, 4).alias("mean"))


@query("A21_category_sum", f"WITH {EMISSIONS} SELECT pollutant, round(sum(rate), 2) AS total FROM emissions GROUP BY pollutant")
def a21(spark, sf):
    return emissions(spark, sf).groupBy("pollutant").agg(F.round(F.sum("rate"), 2).alias("total"))


@query("A22_contribution_percent", f"WITH {EMISSIONS}, s AS (SELECT pollutant, cat, sum(rate) AS r FROM emissions GROUP BY ALL) SELECT pollutant, cat, round(100 * r / sum(r) OVER (PARTITION BY pollutant), 4) AS percent FROM s")
def a22(spark, sf):
    s = emissions(spark, sf).groupBy("pollutant", "cat").agg(F.sum("rate").alias("r"))
    return q.with_share(s, "r", ["pollutant"]).select("pollutant", "cat", F.round(100 * F.col("share"), 4).alias("percent"))


@query("A23_total_emissions", f"WITH {EMISSIONS} SELECT cat, pollutant, round(sum(rate) * 1e-6 / 3600, 8) AS g_per_s FROM emissions GROUP BY ALL")
def a23(spark, sf):
    return emissions(spark, sf).groupBy("cat", "pollutant").agg(F.round(F.sum("rate") * 1e-6 / 3600, 8).alias("g_per_s"))


@query("A24_annual_normalization", f"WITH {EMISSIONS}, y AS (SELECT cat, sum(rate * share) AS total FROM emissions GROUP BY cat) SELECT e.cat, e.h, e.w, round(sum(e.rate * e.share) * 1000 / any_value(y.total), 6) AS normalized FROM emissions e JOIN y USING (cat) GROUP BY e.cat, e.h, e.w")
def a24(spark, sf):
    cells = emissions(spark, sf).groupBy("cat", "h", "w").agg(F.sum(F.col("rate") * F.col("share")).alias("r"))
    return q.with_share(cells, "r", ["cat"]).select("cat", "h", "w", F.round(1000 * F.col("share"), 6).alias("normalized"))


@query("A25_completeness", f"WITH {HOURLY} SELECT var, source_id, count(value) AS available, 720 - count(value) AS missing, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(avg(value) + {TIE}, 4) AS mean, count(value) > 10 AND min(value) = max(value) AS constant FROM hourly WHERE sys_hour BETWEEN 473352 AND 474071 GROUP BY ALL")
def a25(spark, sf):
    c = q.completeness(hourly(spark, sf), 473352, 474071)
    return c.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4), "mean": F.round(F.col("mean") + TIE, 4)})


@query("A26_severity", f"WITH {HOURLY}, c AS (SELECT var, source_id, count(*) AS n FROM hourly GROUP BY ALL) SELECT var, count(*) AS sources, CASE WHEN min(n) >= 200 THEN 'ok' WHEN avg(n) >= 100 THEN 'warning' ELSE 'severe' END AS severity FROM c GROUP BY var")
def a26(spark, sf):
    c = hourly(spark, sf).groupBy("var", "source_id").agg(F.count(F.lit(1)).alias("n")).groupBy("var").agg(F.count(F.lit(1)).alias("sources"), F.min("n").alias("lo"), F.avg("n").alias("mean"))
    return c.select("var", "sources", F.when(F.col("lo") >= 200, "ok").when(F.col("mean") >= 100, "warning").otherwise("severe").alias("severity"))


@query("A27_weekly_mean", f"WITH {HOURLY} SELECT var, sys_hour // 168 AS week, round(avg(value) + {TIE}, 4) AS mean FROM hourly GROUP BY ALL")
def a27(spark, sf):
    return hourly(spark, sf).groupBy("var", F.floor(F.col("sys_hour") / 168).alias("week")).agg(F.round(F.avg("value") + TIE, 4).alias("mean"))


@query("A28_acts_last_hours", f"WITH {OBS}, acts AS (SELECT var, sys_hour, count(DISTINCT source_id) AS n FROM obs GROUP BY ALL) SELECT a.var, a.sys_hour, CAST(sum(b.n) AS BIGINT) AS acts FROM acts a JOIN acts b ON a.var = b.var AND b.sys_hour BETWEEN a.sys_hour - 5 AND a.sys_hour GROUP BY ALL")
def a28(spark, sf):
    acts = observations(spark, sf).groupBy("var", "sys_hour").agg(F.count_distinct("source_id").alias("n"))
    spread = acts.select("var", F.explode(F.sequence("sys_hour", F.col("sys_hour") + 5)).alias("sys_hour"), "n").groupBy("var", "sys_hour").agg(F.sum("n").alias("acts"))
    return spread.join(acts.select("var", "sys_hour"), ["var", "sys_hour"])


@query("A29_daily_average", f"WITH {OBS}, d AS (SELECT var, sys_hour // 24 AS day, sum(value) AS v FROM obs GROUP BY ALL) SELECT var, CAST((day + 4) % 7 + 1 AS BIGINT) AS dow, round(avg(v) + {TIE}, 1) AS mean FROM d GROUP BY ALL")
def a29(spark, sf):
    d = observations(spark, sf).groupBy("var", F.floor(F.col("sys_hour") / 24).alias("day")).agg(F.sum("value").alias("v"))
    return d.groupBy("var", ((F.col("day") + 4) % 7 + 1).alias("dow")).agg(F.round(F.avg("v") + TIE, 1).alias("mean"))


@query("A30_mass_balance", f"WITH {EMISSIONS} SELECT cat, round(sum(rate), 2) AS released, round(sum(rate * (1 - share)), 2) AS airborne FROM emissions WHERE cat <> 1 GROUP BY cat")
def a30(spark, sf):
    return emissions(spark, sf).filter("cat <> 1").groupBy("cat").agg(F.round(F.sum("rate"), 2).alias("released"), F.round(F.sum(F.col("rate") * (1 - F.col("share"))), 2).alias("airborne"))


@query("A31_seasonal", f"WITH {EMISSIONS} SELECT CASE WHEN month(day) IN (12, 1, 2, 3) THEN 'winter' WHEN month(day) IN (4, 5) THEN 'spring' WHEN month(day) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, round(avg(rate), 4) AS mean FROM emissions GROUP BY ALL")
def a31(spark, sf):
    m = F.month("day")
    season = F.when(m.isin(12, 1, 2, 3), "winter").when(m.isin(4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    return emissions(spark, sf).groupBy(season.alias("season")).agg(F.round(F.avg("rate"), 4).alias("mean"))


@query("T1_layers_by_time", f"WITH {HOURLY} SELECT var, source_id, sys_hour, row_number() OVER (PARTITION BY var, source_id ORDER BY sys_hour) AS k FROM hourly")
def t1(spark, sf):
    return hourly(spark, sf).select("var", "source_id", "sys_hour", F.row_number().over(Window.partitionBy("var", "source_id").orderBy("sys_hour")).cast("long").alias("k"))


@query("T3_least_emitters", f"WITH {EMISSIONS}, s AS (SELECT emitter, cat, sum(rate) AS r FROM emissions GROUP BY ALL), k AS (SELECT *, percent_rank() OVER (PARTITION BY cat ORDER BY r, emitter) AS p FROM s) SELECT emitter, cat FROM k WHERE p >= 0.8")
def t3(spark, sf):
    s = emissions(spark, sf).groupBy("emitter", "cat").agg(F.sum("rate").alias("r"))
    k = q.ranked(s, "cat", ["r", "emitter"]).withColumn("p", F.coalesce(F.col("rank") / F.nullif(F.col("size") - 1, F.lit(0)), F.lit(0.0)))
    return k.filter("p >= 0.8").select("emitter", "cat")


@query("T4_best_source", f"WITH {OBS} SELECT var, sys_hour, arg_min(source_id, maturity * 10000000000 + event_id) AS source_id FROM obs GROUP BY ALL")
def t4(spark, sf):
    return observations(spark, sf).groupBy("var", "sys_hour").agg(F.min_by("source_id", F.col("maturity") * 10000000000 + F.col("event_id")).alias("source_id"))


@query("T5_top_contributor", f"WITH {EMISSIONS}, s AS (SELECT h, w, emitter, round(sum(rate), 3) AS r FROM emissions WHERE cat = 2 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY h, w ORDER BY r DESC, emitter DESC) AS k FROM s) SELECT h, w, emitter, r FROM k WHERE k = 1")
def t5(spark, sf):
    """The emitter that contributes most to each cell in one category; of equal ones the last by name."""
    s = emissions(spark, sf).filter("cat = 2").groupBy("h", "w", "emitter").agg(F.round(F.sum("rate"), 3).alias("r"))
    return s.groupBy("h", "w").agg(F.max(F.struct("r", "emitter")).alias("m")).select("h", "w", "m.emitter", "m.r")


@query("T6_printout_limit", f"WITH {OBS} SELECT event_id, var FROM obs ORDER BY sec DESC, event_id DESC LIMIT 8690")
def t6(spark, sf):
    """A printout of the newest rows; the limit is the feature."""
    return observations(spark, sf).orderBy(F.desc("sec"), F.desc("event_id")).limit(8690).select("event_id", "var")


@query("T7_latest_file", f"WITH {OBS}, k AS (SELECT var, source_id, event_id, sec, row_number() OVER (PARTITION BY var ORDER BY sec DESC, event_id DESC) AS k FROM obs) SELECT var, source_id, event_id, sec FROM k WHERE k = 1")
def t7(spark, sf):
    """The most recent entry of each feed."""
    newest = observations(spark, sf).groupBy("var").agg(F.max(F.struct("sec", "event_id", "source_id")).alias("m"))
    return newest.select("var", "m.source_id", "m.event_id", "m.sec")


@query("U1_union_then_dedupe", f"WITH {OBS}, two AS (SELECT var, source_id, sys_hour, maturity, value FROM obs UNION ALL SELECT var, source_id, sys_hour, maturity + 1, value * 2 FROM obs), c AS (SELECT var, source_id, sys_hour, maturity, avg(value) AS v FROM two GROUP BY ALL) SELECT var, source_id, sys_hour, round(arg_min(v, maturity), 4) AS value FROM c GROUP BY ALL")
def u1(spark, sf):
    o = observations(spark, sf).select("var", "source_id", "sys_hour", "maturity", "value")
    two = o.unionByName(o.withColumns({"maturity": F.col("maturity") + 1, "value": F.col("value") * 2}))
    return q.slots(two).select("var", "source_id", "sys_hour", F.round("value", 4).alias("value"))


@query("U2_union_distinct", f"WITH {EMISSIONS} SELECT emitter FROM emissions WHERE cat = 1 UNION SELECT emitter FROM emissions WHERE cat = 2")
def u2(spark, sf):
    e = emissions(spark, sf)
    return e.filter("cat = 1").select("emitter").union(e.filter("cat = 2").select("emitter")).distinct()


@query("U3_set_difference", f"WITH {CELLS} SELECT h, w FROM cells WHERE NOT (h BETWEEN 10 AND 14 AND w BETWEEN 10 AND 14)")
def u3(spark, sf):
    c = grid_cells(spark, sf).select("h", "w")
    return c.join(c.filter(F.col("h").between(10, 14) & F.col("w").between(10, 14)), ["h", "w"], "left_anti")


@query("J19_merge_packs", f"WITH {OBS}, packs AS (SELECT var, source_id, sys_hour, maturity, value FROM obs WHERE sid < 4 UNION ALL SELECT var, source_id, sys_hour, maturity + 1, value FROM obs WHERE sid > 2), c AS (SELECT var, source_id, sys_hour, maturity, avg(value) AS v FROM packs GROUP BY ALL) SELECT var, source_id, sys_hour, round(arg_min(v, maturity), 4) AS value FROM c GROUP BY ALL")
def j19(spark, sf):
    """Two packs of sources, some of them in both: their union by id, one value a slot; the second pack is less mature."""
    o = observations(spark, sf).select("var", "source_id", "sid", "sys_hour", "maturity", "value")
    both = o.filter("sid < 4").unionByName(o.filter("sid > 2").withColumn("maturity", F.col("maturity") + 1))
    return q.slots(both).select("var", "source_id", "sys_hour", F.round("value", 4).alias("value"))


@query("S25_scale_offset", "SELECT c_custkey, round(c_acctbal * 0.1 + 273.15, 4) AS value FROM customer")
def s25(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 0.1 + 273.15, 4).alias("value"))
