"""Queries for as-of joins (J5 to J9, J16) and temporal operators (W)."""

from pyspark.sql import functions as F

from airloom.functions import geo
from airloom.operators import quality as q
from airloom.operators import temporal as t
from airloom.sources.adapters import OBS, observations

from .base import TIE, query
from .quality_queries import HOURLY, hourly

c = F.col
SPINE = "ends AS (SELECT var, source_id, min(sys_hour) AS a, max(sys_hour) AS b FROM hourly GROUP BY ALL), spine AS (SELECT var, source_id, unnest(range(a, b + 1)) AS sys_hour FROM ends)"




def joined_sql(offsets):
    """Left joins of each offset, and the coalesce over them."""
    joins = " ".join(f"LEFT JOIN hourly x{k} ON x{k}.var = s.var AND x{k}.source_id = s.source_id AND x{k}.sys_hour = s.sys_hour + ({o})" for k, o in enumerate(offsets))
    value = "coalesce(" + ", ".join(f"x{k}.value" for k in range(len(offsets))) + ")"
    hour = "coalesce(" + ", ".join(f"x{k}.sys_hour" for k in range(len(offsets))) + ")"
    return joins, value, hour


J5 = joined_sql(t.nearest_first(4))
J6B, J6F = joined_sql([0, -1, -2, -3]), joined_sql([1, 2, 3])


@query("J5_asof_nearest", f"WITH {HOURLY}, {SPINE} SELECT s.var, s.source_id, s.sys_hour, round({J5[1]}, 4) AS near, {J5[2]} AS near_hour FROM spine s {J5[0]}")
def j5(spark, sf):
    s = hourly(spark, sf)
    return t.asof(t.spine(s), s, t.nearest_first(4), "near").withColumn("near", F.round("near", 4))


@query("J6_asof_backward", f"WITH {HOURLY}, {SPINE} SELECT s.var, s.source_id, s.sys_hour, round({J6B[1]}, 4) AS back, {J6B[2]} AS back_hour FROM spine s {J6B[0]}")
def j6(spark, sf):
    s = hourly(spark, sf)
    return t.asof(t.spine(s), s, [0, -1, -2, -3], "back").withColumn("back", F.round("back", 4))


@query("J6_asof_forward", f"WITH {HOURLY}, {SPINE} SELECT s.var, s.source_id, s.sys_hour, round({J6F[1]}, 4) AS ahead, {J6F[2]} AS ahead_hour FROM spine s {J6F[0]}")
def j6f(spark, sf):
    s = hourly(spark, sf)
    return t.asof(t.spine(s), s, [1, 2, 3], "ahead").withColumn("ahead", F.round("ahead", 4))


J7B, J7F = joined_sql([0, -1, -2, -3, -4, -5]), joined_sql([0, 1, 2, 3, 4, 5])


@query("J7_previous_and_next", f"WITH {HOURLY}, {SPINE}, p AS (SELECT s.*, {J7B[1]} AS prev FROM spine s {J7B[0]}), n AS (SELECT s.*, {J7F[1]} AS next FROM spine s {J7F[0]}) SELECT p.var, p.source_id, p.sys_hour, round(p.prev, 4) AS prev, round(n.next, 4) AS next FROM p JOIN n USING (var, source_id, sys_hour)")
def j7(spark, sf):
    s = hourly(spark, sf)
    both = t.asof(t.asof(t.spine(s), s, [-k for k in range(6)], "prev"), s, range(6), "next")
    return both.select("var", "source_id", "sys_hour", F.round("prev", 4).alias("prev"), F.round("next", 4).alias("next"))


@query("J8_hour_offset_lookup", f"WITH {HOURLY} SELECT a.var, a.source_id, a.sys_hour, round(b.value - a.value, 4) AS change FROM hourly a JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour + 2")
def j8(spark, sf):
    return q.shifted(hourly(spark, sf), 2).select("var", "source_id", "sys_hour", F.round(c("other") - c("value"), 4).alias("change"))


@query("J9_component_join", f"WITH {HOURLY} SELECT a.source_id, a.sys_hour, round(sqrt(a.value * a.value + b.value * b.value), 4) AS speed FROM hourly a JOIN hourly b ON a.source_id = b.source_id AND a.sys_hour = b.sys_hour WHERE a.var = 'view' AND b.var = 'click'")
def j9(spark, sf):
    p = hourly(spark, sf).groupBy("source_id", "sys_hour").pivot("var", ["view", "click"]).agg(F.first("value")).dropna(subset=["view", "click"])
    return p.select("source_id", "sys_hour", F.round(F.sqrt(c("view") * c("view") + c("click") * c("click")), 4).alias("speed"))


@query("J16_quarter_hour_adjustment", f"WITH {HOURLY}, o AS (SELECT event_id, var, source_id, sys_hour, CASE WHEN minute(ts) >= 45 THEN 0.75 WHEN minute(ts) >= 30 THEN 0.5 WHEN minute(ts) >= 15 THEN 0.25 ELSE 0 END AS share FROM obs) SELECT o.event_id, round(a.value * (1 - share) + coalesce(b.value, a.value) * share, 6) AS factor FROM o JOIN hourly a USING (var, source_id, sys_hour) LEFT JOIN hourly b ON b.var = o.var AND b.source_id = o.source_id AND b.sys_hour = o.sys_hour + 1")
def j16(spark, sf):
    s = hourly(spark, sf)
    now, nxt = s.select("var", "source_id", "sys_hour", "value"), s.select("var", "source_id", (c("sys_hour") - 1).alias("sys_hour"), c("value").alias("nx"))
    o = observations(spark, sf).select("event_id", "var", "source_id", "sys_hour", t.quarter_share(F.minute("ts")).alias("share"))
    rows = o.join(now, ["var", "source_id", "sys_hour"]).join(nxt, ["var", "source_id", "sys_hour"], "left")
    return rows.select("event_id", F.round(c("value") * (1 - c("share")) + F.coalesce("nx", "value") * c("share"), 6).alias("factor"))


W1B, W1F = joined_sql([0, -1, -2]), joined_sql([1, 2])
W1_SQL = f"WITH {HOURLY}, {SPINE}, b AS (SELECT s.*, {W1B[1]} AS back, {W1B[2]} AS bh FROM spine s {W1B[0]}), f AS (SELECT s.*, {W1F[1]} AS ahead, {W1F[2]} AS ah FROM spine s {W1F[0]}), w1 AS (SELECT var, source_id, sys_hour, CASE WHEN ahead IS NULL OR bh = sys_hour THEN back WHEN back IS NOT NULL THEN back * (1 - (sys_hour - bh) / (ah - bh)) + ahead * (sys_hour - bh) / (ah - bh) END AS value FROM b JOIN f USING (var, source_id, sys_hour))"


@query("W1_interpolated_series", W1_SQL + " SELECT var, source_id, sys_hour, round(value, 6) AS value FROM w1")
def w1(spark, sf):
    return t.interpolated(hourly(spark, sf)).withColumn("value", F.round("value", 6))


FILLED = "r AS (SELECT s.var, s.source_id, s.sys_hour, h.value, CASE WHEN h.value IS NOT NULL THEN s.sys_hour END AS at_hour FROM spine s LEFT JOIN hourly h USING (var, source_id, sys_hour)), f AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS bv, last_value(at_hour IGNORE NULLS) OVER w AS bh, first_value(value IGNORE NULLS) OVER v AS nv, first_value(at_hour IGNORE NULLS) OVER v AS nh FROM r WINDOW w AS (PARTITION BY var, source_id ORDER BY sys_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY var, source_id ORDER BY sys_hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("W3_gap_fill", f"WITH {HOURLY}, {SPINE}, {FILLED} SELECT var, source_id, sys_hour, round(CASE WHEN nh = bh THEN value ELSE (bv * (nh - sys_hour) + nv * (sys_hour - bh)) / (nh - bh) END, 8) AS value FROM f")
def w3(spark, sf):
    return t.filled_between(hourly(spark, sf)).withColumn("value", F.round("value", 8))


@query("W4_smoothing", f"WITH {HOURLY}, {SPINE}, {FILLED}, g AS (SELECT *, lag(bv) OVER w AS p, lead(value) OVER w AS nx, lag(sys_hour) OVER w IS NULL OR lead(sys_hour) OVER w IS NULL AS edge FROM f WINDOW w AS (PARTITION BY var, source_id ORDER BY sys_hour)) SELECT var, source_id, sys_hour, round(CASE WHEN value IS NULL THEN bv WHEN edge THEN value WHEN nx IS NULL THEN 0.3 * p + 0.7 * value ELSE 0.25 * p + 0.5 * value + 0.25 * nx END, 6) AS value FROM g")
def w4(spark, sf):
    return t.smoothed(hourly(spark, sf)).withColumn("value", F.round("value", 6))


#: A day ahead reads only hours that are known: the same hour of up to three days before.
FORECAST = """last_hour AS (SELECT var, source_id, max(sys_hour) AS last, arg_max(value, sys_hour) AS v FROM hourly GROUP BY ALL), steps AS (SELECT *, greatest(0.0, 1 - k / 12.0) AS lf FROM (SELECT unnest(range(1, 25)) AS k)),
recent AS (SELECT l.var, l.source_id, avg(h.value) AS m FROM last_hour l JOIN hourly h ON h.var = l.var AND h.source_id = l.source_id AND h.sys_hour BETWEEN l.last - 47 AND l.last - 1 GROUP BY ALL),
diurnal AS (SELECT l.var, l.source_id, k, avg(h.value) AS m FROM last_hour l CROSS JOIN steps JOIN hourly h ON h.var = l.var AND h.source_id = l.source_id AND h.sys_hour IN (l.last + k - 24, l.last + k - 48, l.last + k - 72) GROUP BY ALL),
forecast AS (SELECT l.var, l.source_id, l.last + steps.k AS sys_hour, v * lf + coalesce(d.m, 0) * 0.4 * (1 - lf) + coalesce(r.m, v) * (0.6 * (1 - lf) + CASE WHEN d.m IS NULL THEN 0.4 * (1 - lf) ELSE 0 END) AS value FROM last_hour l CROSS JOIN steps LEFT JOIN recent r ON r.var = l.var AND r.source_id = l.source_id LEFT JOIN diurnal d ON d.var = l.var AND d.source_id = l.source_id AND d.k = steps.k)"""


@query("W5_forecast_fill", f"WITH {HOURLY}, {FORECAST} SELECT var, source_id, sys_hour, round(value + {TIE}, 5) AS value FROM forecast")
def w5(spark, sf):
    return t.forecast_filled(hourly(spark, sf)).withColumn("value", F.round(c("value") + TIE, 5))


@query("W6_quarter_weight", f"WITH {OBS} SELECT event_id, CAST(CASE WHEN minute(ts) >= 45 THEN 0.75 WHEN minute(ts) >= 30 THEN 0.5 WHEN minute(ts) >= 15 THEN 0.25 ELSE 0 END AS DOUBLE) AS share FROM obs")
def w6(spark, sf):
    return observations(spark, sf).select("event_id", t.quarter_share(F.minute("ts")).alias("share"))


@query("W7_met_history", f"WITH {HOURLY}, k AS (SELECT unnest([3, 6, 9, 12]) AS back) SELECT a.var, a.source_id, a.sys_hour, count(b.value) AS n, round(avg(b.value), 6) AS mean FROM hourly a CROSS JOIN k LEFT JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour - back GROUP BY ALL")
def w7(spark, sf):
    s = hourly(spark, sf)
    asked = s.select("var", "source_id", "sys_hour", F.explode(F.array(*[c("sys_hour") - k for k in (3, 6, 9, 12)])).alias("at"))
    have = s.select("var", "source_id", c("sys_hour").alias("at"), c("value").alias("v"))
    return asked.join(have, ["var", "source_id", "at"], "left").groupBy("var", "source_id", "sys_hour").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("W8_wind_interpolation", f"""WITH {OBS}, m AS (SELECT event_id, minute(ts) / 60.0 AS f, CAST(event_id % 36 AS DOUBLE) * 10 + 0.5 AS d0, CAST(event_id % 36 AS DOUBLE) * 10 + 30.5 AS d1 FROM obs),
v AS (SELECT event_id, -((1 - f) * 4 * cos(radians(d0)) + f * 6 * cos(radians(d1))) AS n, -((1 - f) * 4 * sin(radians(d0)) + f * 6 * sin(radians(d1))) AS e FROM m) SELECT event_id, round((degrees(atan2(-e, -n)) + 360) % 360, 6) AS dir, round(greatest(0.1, sqrt(n * n + e * e)), 4) AS speed FROM v""")
def w8(spark, sf):
    f, d0 = F.minute("ts") / 60.0, (c("event_id") % 36).cast("double") * 10 + 0.5
    part = lambda g: -((1 - f) * 4 * g(F.radians(d0)) + f * 6 * g(F.radians(d0 + 30)))
    n, e = part(F.cos), part(F.sin)
    return observations(spark, sf).select("event_id", F.round(geo.wind_direction(n, e), 6).alias("dir"), F.round(geo.wind_speed(n, e), 4).alias("speed"))


@query("W9_flow_interpolation", f"WITH {HOURLY}, p AS (SELECT sys_hour % 24 AS hour, avg(value) AS v FROM hourly GROUP BY ALL), o AS (SELECT event_id, sys_hour % 24 AS hour, minute(ts) / 60.0 AS f FROM obs) SELECT event_id, round(a.v * (1 - f) + b.v * f + {TIE}, 4) AS flow FROM o JOIN p a USING (hour) JOIN p b ON b.hour = (o.hour + 1) % 24")
def w9(spark, sf):
    p = hourly(spark, sf).groupBy((c("sys_hour") % 24).alias("hour")).agg(F.avg("value").alias("v"))
    p = p.select("hour", "v").join(p.select(((c("hour") + 23) % 24).alias("hour"), c("v").alias("nx")), "hour")  # 24 rows
    o = observations(spark, sf).select("event_id", (c("sys_hour") % 24).alias("hour"), (F.minute("ts") / 60.0).alias("f"))
    return o.join(F.broadcast(p), "hour").select("event_id", F.round(c("v") * (1 - c("f")) + c("nx") * c("f") + TIE, 4).alias("flow"))


@query("W10_frames", f"WITH {HOURLY} SELECT a.var, a.source_id, a.sys_hour * 4 + k AS frame, round(a.value + (b.value - a.value) * k / 4, 6) AS value FROM hourly a JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour + 1 CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)")
def w10(spark, sf):
    pairs = q.shifted(hourly(spark, sf), 1).select("var", "source_id", "sys_hour", "value", "other", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("k"))
    return pairs.select("var", "source_id", (c("sys_hour") * 4 + c("k")).alias("frame"), F.round(c("value") + (c("other") - c("value")) * c("k") / 4, 6).alias("value"))


@query("W11_time_buckets", f"WITH {OBS} SELECT event_id, sec // 300 * 300 AS m5, sec // 900 * 900 AS m15, sec // 3600 * 3600 AS m60, sec // 10800 * 10800 AS m180, sec // 86400 * 86400 AS m1440 FROM obs")
def w11(spark, sf):
    return observations(spark, sf).select("event_id", *[t.bucket(c("sec"), m).alias(f"m{m}") for m in (5, 15, 60, 180, 1440)])


@query("W12_closest_key", f"WITH {HOURLY}, b AS (SELECT var, min(sys_hour) AS a, max(sys_hour) AS z FROM hourly GROUP BY var) SELECT var, h AS hour, greatest(a, least(z, h)) AS key FROM b CROSS JOIN (SELECT unnest(range(473300, 474200, 50)) AS h)")
def w12(spark, sf):
    b = hourly(spark, sf).groupBy("var").agg(F.min("sys_hour").alias("a"), F.max("sys_hour").alias("z"))
    return b.select("*", F.explode(F.sequence(F.lit(473300).cast("long"), F.lit(474150).cast("long"), F.lit(50).cast("long"))).alias("hour")).select("var", "hour", F.greatest("a", F.least("z", "hour")).alias("key"))


@query("W13_first_missing_hour", f"WITH {HOURLY} SELECT a.var, a.source_id, min(a.sys_hour) + 1 AS first_missing FROM hourly a ANTI JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour + 1 GROUP BY ALL")
def w13(spark, sf):
    s = hourly(spark, sf).select("var", "source_id", "sys_hour")
    after = s.select("var", "source_id", (c("sys_hour") - 1).alias("sys_hour"))
    return s.join(after, ["var", "source_id", "sys_hour"], "left_anti").groupBy("var", "source_id").agg((F.min("sys_hour") + 1).alias("first_missing"))


@query("W14_dust_memory", f"WITH {HOURLY} SELECT a.var, a.source_id, a.sys_hour, round((a.value + coalesce(b.value, a.value)) / 2, 4) AS mean FROM hourly a LEFT JOIN hourly b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour - 2")
def w14(spark, sf):
    s = hourly(spark, sf)
    before = s.select("var", "source_id", (c("sys_hour") + 2).alias("sys_hour"), c("value").alias("b"))
    return s.join(before, ["var", "source_id", "sys_hour"], "left").select("var", "source_id", "sys_hour", F.round((c("value") + F.coalesce("b", "value")) / 2, 4).alias("mean"))


@query("W15_half_hours", f"WITH {HOURLY}, p AS (SELECT var, sys_hour % 24 AS hour, avg(value) AS v FROM hourly GROUP BY ALL) SELECT a.var, a.hour * 2 + k AS slot, round(CASE WHEN k = 0 THEN a.v ELSE (a.v + b.v) / 2 END + {TIE}, 4) AS value FROM p a JOIN p b ON a.var = b.var AND b.hour = least(a.hour + 1, 23) CROSS JOIN (SELECT unnest([0, 1]) AS k)")
def w15(spark, sf):
    p = hourly(spark, sf).groupBy("var", (c("sys_hour") % 24).alias("hour")).agg(F.avg("value").alias("v"))
    full = p.groupBy("var").agg(F.array_sort(F.collect_list(F.struct("hour", "v"))).alias("a"))  # 24 entries at most
    return full.select("var", F.posexplode(t.half_hours(F.col("a.v"))).alias("slot", "value")).select("var", c("slot").cast("long").alias("slot"), F.round(c("value") + TIE, 4).alias("value"))
