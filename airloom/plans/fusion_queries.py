"""Queries for fusion inputs, factors, validation, learning, proxies and statistics (X30 to X42, X55, K, M28, M32)."""

from pyspark.sql import functions as F

from airloom.functions import geo, physics, text
from airloom.operators import fusion as f
from airloom.operators import quality as q
from airloom.operators import temporal as t
from airloom.sources import sinks
from airloom.sources.adapters import EMISSIONS, OBS, emissions, observations
from airloom.sources.store import written

from .base import TIE, query
from .map_queries import FOOT, STATION_PARTS, station_parts
from .quality_queries import COVAR, HOURLY, hourly
from .time_queries import FILLED, FORECAST, SPINE

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x, n)
N_CAT = 4


GROUPS = "groups AS (SELECT source_id, " + ", ".join(f"sum(CASE WHEN cat % 3 = {k} THEN 1e6 * v ELSE 0 END) AS g{k}" for k in range(3)) + ", sum(1e6 * v) AS v FROM parts GROUP BY source_id), grouped AS (SELECT source_id, " + ", ".join(f"g{k} * (SELECT 20 / avg(v) FROM groups) AS p{k + 1}" for k in range(3)) + " FROM groups)"
#: What the model expects at a station and hour: a regional background, half of the least value around, and the plumes of three groups of
#: categories upwind, scaled to 20 on average and by the hour of the day.
COMPONENTS = f"{HOURLY}, {EMISSIONS}, {FOOT}, {STATION_PARTS}, {GROUPS}, base AS (SELECT var, sys_hour, 0.5 * min(value) AS p0 FROM hourly GROUP BY ALL), comp AS (SELECT h.*, b.p0, coalesce(g.p1, 0) * d AS p1, coalesce(g.p2, 0) * d AS p2, coalesce(g.p3, 0) * d AS p3 FROM (SELECT *, 1 + 0.3 * cos((sys_hour % 24) * pi() / 12) AS d FROM hourly) h JOIN base b USING (var, sys_hour) LEFT JOIN grouped g USING (source_id))"


def components(spark, sf):
    """``parts`` of each accepted hour: the background and the plumes of the emissions upwind by group of categories."""
    s = hourly(spark, sf)
    base = s.groupBy("var", "sys_hour").agg((0.5 * F.min("value")).alias("p0"))
    plumes = station_parts(spark, sf).withColumn("v", 1e6 * c("v"))
    by_station = plumes.groupBy("source_id").agg(*[F.sum(F.when(c("cat") % 3 == k, c("v")).otherwise(0.0)).alias(f"g{k}") for k in range(3)], F.sum("v").alias("v"))
    scale = by_station.agg((20 / F.avg("v")).alias("scale"))  # one row
    grouped = by_station.crossJoin(F.broadcast(scale)).select("source_id", *[(c(f"g{k}") * c("scale")).alias(f"p{k + 1}") for k in range(3)])  # a row for each station
    swing = 1 + 0.3 * F.cos((c("sys_hour") % 24) * lit(3.141592653589793) / 12)
    parts = F.array("p0", *[F.coalesce(f"p{k}", lit(0.0)) * swing for k in (1, 2, 3)])
    return s.join(base, ["var", "sys_hour"]).join(grouped, "source_id", "left").select("var", "source_id", "sys_hour", "value", "maturity", parts.alias("parts"))


def inputs(spark, sf):
    """This hour's observations and the hour before's, with the unsteadiness of their series."""
    x = components(spark, sf)
    both = x.withColumn("previous", lit(False)).unionByName(x.withColumns({"sys_hour": c("sys_hour") + 1, "previous": lit(True)}))
    hour = F.pmod("sys_hour", lit(24))
    covar = q.hour_covariance(hourly(spark, sf))
    rows = both.withColumn("hour", hour).join(covar, ["var", "source_id", "hour"], "left")
    return rows.select("var", "source_id", "sys_hour", "value", "parts", "previous", (1 + c("maturity")).cast("double").alias("imprecision"), F.coalesce("covar", lit(0.0)).alias("covar"))


@query("X31_fusion_inputs", f"WITH {HOURLY} SELECT var, sys_hour, count(*) AS n, round(sum(w), 4) AS weight FROM (SELECT var, sys_hour, 1.0 AS w FROM hourly UNION ALL SELECT var, sys_hour + 1, 0.4 FROM hourly) GROUP BY ALL")
def x31(spark, sf):
    return inputs(spark, sf).groupBy("var", "sys_hour").agg(F.count(lit(1)).alias("n"), r(F.sum(F.when(c("previous"), 0.4).otherwise(1.0))).alias("weight"))


@query("X32_fusion_weights", f"WITH {HOURLY}, {COVAR}, i AS (SELECT h.var, h.source_id, h.sys_hour, coalesce(c.covar, 0) AS ac, 1 + maturity AS imp FROM hourly h LEFT JOIN covar c ON c.var = h.var AND c.source_id = h.source_id AND c.hour = h.sys_hour % 24), m AS (SELECT *, avg(ac) OVER w AS mean FROM i WINDOW w AS (PARTITION BY var, sys_hour)), k AS (SELECT *, 1 / greatest(1e-9, imp * CASE WHEN ac > 0 THEN 0.7 * ac + 0.3 * mean ELSE 2 * mean END) AS k FROM m) SELECT var, source_id, sys_hour, round(k / sum(k) OVER (PARTITION BY var, sys_hour), 6) AS weight FROM k")
def x32(spark, sf):
    i = inputs(spark, sf).filter("not previous")
    mean = i.groupBy("var", "sys_hour").agg(F.avg("covar").alias("mean"))
    spread = F.when(c("covar") > 0, 0.7 * c("covar") + 0.3 * c("mean")).otherwise(2 * c("mean"))
    k = i.join(mean, ["var", "sys_hour"]).withColumn("k", 1 / F.greatest(lit(1e-9), c("imprecision") * spread))
    return q.with_share(k, "k", ["var", "sys_hour"]).select("var", "source_id", "sys_hour", r(c("share"), 6).alias("weight"))


@query("X33_search_ranges", f"WITH {COMPONENTS} SELECT var, sys_hour, round(least(0, min(value) - min(p0)), 4) + 0.0 AS low, round(greatest(0, min(value) - min(p0)) + 1, 4) AS high FROM comp GROUP BY var, sys_hour")
def x33(spark, sf):
    g = components(spark, sf).groupBy("var", "sys_hour").agg((F.min("value") - F.min(c("parts")[0])).alias("gap"))
    return g.select("var", "sys_hour", (r(F.least(lit(0.0), c("gap"))) + 0.0).alias("low"), r(F.greatest(lit(0.0), c("gap")) + 1).alias("high"))


@query("X34_X35_fusion_factors")
def x34(spark, sf):
    return f.fitted(inputs(spark, sf), N_CAT)


@query("X36_leave_one_out_fit")
def x36(spark, sf):
    return f.left_out(inputs(spark, sf), N_CAT)


@query("X37_M32_reliability")
def x37(spark, sf):
    fit = f.fitted(inputs(spark, sf), N_CAT)
    return fit.select("var", "sys_hour", F.explode(F.arrays_zip("stations", "classes", "permille")).alias("z")).select("var", "sys_hour", c("z.stations").alias("source_id"), c("z.classes").alias("cls"), c("z.permille").alias("permille"))


def adjustments(spark, sf):
    """Deterministic hourly factors by variable and category, for the operators after the fit."""
    s = hourly(spark, sf).groupBy("var", "sys_hour").agg(F.avg("value").alias("v"))
    k = F.explode(F.array(*[lit(i).cast("long") for i in range(N_CAT)]))
    return s.select("var", "sys_hour", "v", k.alias("cat")).select("var", "cat", "sys_hour", F.when(c("cat") == 0, c("v") / 10).otherwise(0.8 + c("v") / 200 / c("cat")).alias("factor"), lit(False).alias("filled"))


ADJUST = f"{HOURLY}, adj AS (SELECT var, cat, sys_hour, CASE WHEN cat = 0 THEN v / 10 ELSE 0.8 + v / 200 / cat END AS factor FROM (SELECT var, sys_hour, avg(value) AS v FROM hourly GROUP BY ALL), (SELECT unnest(range(0, 4)) AS cat))"
STEP = "CASE WHEN cat = 0 THEN {k} * factor + (1 - {k}) * {x} ELSE least(2.0, greatest(0.7, {x} * (1 + {k} * (factor - 1)))) END"


def fold_sql():
    """The fold over hours as a recursion: each row is one hour's state; a cell is the day type times 24 plus the hour."""
    kind = lambda h: f"CASE (({h}) // 24 + 3) % 7 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END"
    cell = lambda h: f"({kind(h)}) * 24 + ({h}) % 24"
    rate = lambda h, splash: f"(0.01 * CASE {kind(h)} WHEN 0 THEN 1.5 ELSE 4.0 END * {splash})"
    near = [("a.sys_hour", "1.0"), ("a.sys_hour + 1", "0.33"), ("a.sys_hour - 1", "0.33")]
    step = lambda k, x: STEP.format(k=k, x=x).replace("cat", "a.cat").replace("factor", "a.factor")
    cells = "CASE i - 1 " + " ".join(f"WHEN {cell(h)} THEN {step(rate(h, s), 'x')}" for h, s in near) + " ELSE x END"
    start = "CASE WHEN cat = 0 THEN 0.0 ELSE 1.0 END"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY var, cat ORDER BY sys_hour) AS k FROM adj),
fold AS (SELECT DISTINCT var, cat, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS last_hour, CAST({start} AS DOUBLE) AS master, list_transform(range(0, 72), lambda z: CAST({start} AS DOUBLE)) AS cells FROM adj
 UNION ALL SELECT a.var, a.cat, a.k, a.sys_hour, {step('0.001', 'f.master')}, list_transform(f.cells, lambda x, i: {cells}) FROM fold f JOIN numbered a ON a.var = f.var AND a.cat = f.cat AND a.k = f.k + 1)"""


@query("X38_persistent_learning", f"WITH RECURSIVE {ADJUST}, {fold_sql()}, done AS (SELECT var, cat, arg_max(master, k) AS master, arg_max(cells, k) AS cells, max(last_hour) AS last_hour FROM fold GROUP BY ALL) SELECT var, cat, last_hour, round(master, 6) AS master, slot, round(cells[slot + 1], 6) AS cell FROM done, (SELECT unnest(range(0, 72)) AS slot)")
def x38(spark, sf):
    return f.learned(adjustments(spark, sf)).select("var", "cat", "last_hour", r(c("master"), 6).alias("master"), F.posexplode("cells").alias("slot", "cell")).withColumns({"slot": c("slot").cast("long"), "cell": r(c("cell"), 6)})


SERIES_OF = "hourly AS (SELECT var, cat AS source_id, sys_hour, factor AS value FROM adj)"
SMOOTHED = f"WITH {SERIES_OF}, {SPINE}, {FILLED}, g AS (SELECT *, lag(bv) OVER w AS p, lead(value) OVER w AS nx, lag(sys_hour) OVER w IS NULL OR lead(sys_hour) OVER w IS NULL AS edge FROM f WINDOW w AS (PARTITION BY var, source_id ORDER BY sys_hour)) SELECT var, source_id AS cat, sys_hour, CASE WHEN value IS NULL THEN bv WHEN edge THEN value WHEN nx IS NULL THEN 0.3 * p + 0.7 * value ELSE 0.25 * p + 0.5 * value + 0.25 * nx END AS value, false AS filled FROM g"


def smoothed_and_filled(a):
    """Factors smoothed over the hours that they have, and 24 hours more."""
    a, by = a.withColumnRenamed("factor", "value"), ["var", "cat"]
    rows = t.smoothed(a, by).withColumn("filled", lit(False)).unionByName(t.forecast_filled(a, 24, by).withColumn("filled", lit(True)))
    return rows.withColumn("value", r(c("value") + TIE, 6))


@query("X39_adjustments_filled", f"WITH {ADJUST} SELECT var, cat, sys_hour, round(value + {TIE}, 6) AS value, filled FROM (({SMOOTHED}) UNION ALL (WITH {SERIES_OF}, {FORECAST} SELECT var, source_id AS cat, sys_hour, value, true AS filled FROM forecast))")
def x39(spark, sf):
    return smoothed_and_filled(adjustments(spark, sf))


EXPECTED = "greatest(0, p0 + 1.5 + p1 * 1.1 + p2 * 0.9 + p3)"


def expected(spark, sf):
    """The model's total with fixed factors: the background's is added, the others multiply."""
    p = c("parts")
    return components(spark, sf).withColumn("expected", F.greatest(lit(0.0), p[0] + 1.5 + p[1] * 1.1 + p[2] * 0.9 + p[3]))


@query("X30_receptor_expectation", f"WITH {COMPONENTS} SELECT var, source_id, sys_hour, round({EXPECTED}, 4) AS expected FROM comp")
def x30(spark, sf):
    return expected(spark, sf).select("var", "source_id", "sys_hour", r(c("expected")).alias("expected"))


@query("X40_proxy_variables", f"WITH {HOURLY}, p AS (SELECT source_id, sys_hour, max(CASE WHEN var = 'click' THEN value END) AS click, max(CASE WHEN var = 'view' THEN value END) AS view FROM hourly GROUP BY ALL) SELECT source_id, sys_hour, round(1.4 * least(click, 100) + 0.6 * view, 4) AS pm10 FROM p WHERE click IS NOT NULL AND view IS NOT NULL")
def x40(spark, sf):
    expr = text.affine("AFFINE<1.4*click+0.6*view>,click_MAX<100>")
    p = hourly(spark, sf).groupBy("source_id", "sys_hour").pivot("var", expr.variables).agg(F.first("value")).dropna(subset=expr.variables)
    return p.select("source_id", "sys_hour", r(expr(c)).alias("pm10"))


@query("X42_aqi_grid", f"WITH {EMISSIONS}, g AS (SELECT h, w, sum(CASE WHEN pollutant = 'N' THEN rate ELSE 0 END) / 20 AS a, sum(CASE WHEN pollutant = 'R' THEN rate ELSE 0 END) / 10 AS b FROM emissions GROUP BY ALL) SELECT h, w, round(greatest(1 + 4 * power(greatest(0, least(1, a / 200)), 1.3), 1 + 4 * power(greatest(0, least(1, b / 150)), 1.0)), 4) AS aqi FROM g")
def x42(spark, sf):
    part = lambda p: F.sum(F.when(c("pollutant") == p, c("rate")).otherwise(0.0))
    g = emissions(spark, sf).groupBy("h", "w").agg((part("N") / 20).alias("a"), (part("R") / 10).alias("b"))
    both = [physics.index_of(c("a"), 0.0, 200.0, 1.3), physics.index_of(c("b"), 0.0, 150.0, 1.0)]
    return g.select("h", "w", r(physics.combined_index(both, "max")).alias("aqi"))


@query("X55_prediction_at_observation", f"WITH {COMPONENTS}, e AS (SELECT *, {EXPECTED} AS expected FROM comp) SELECT a.var, a.source_id, a.sys_hour, round(a.value, 4) AS value, round(a.expected, 4) AS expected, round(a.p0, 4) AS background, round(a.p1 + a.p2 + a.p3, 4) AS plumes, round(b.expected, 4) AS day_before, round(a.expected - b.expected + {TIE}, 3) + 0.0 AS change FROM e a LEFT JOIN e b ON a.var = b.var AND a.source_id = b.source_id AND b.sys_hour = a.sys_hour - 24")
def x55(spark, sf):
    """At each measurement: the model's total and parts, and its total of the day before (the test of a forecast)."""
    p = c("parts")
    s = written(expected(spark, sf))
    before = s.select("var", "source_id", (c("sys_hour") + 24).alias("sys_hour"), c("expected").alias("b"))
    own = s.join(before, ["var", "source_id", "sys_hour"], "left")
    return own.select("var", "source_id", "sys_hour", r(c("value")).alias("value"), r(c("expected")).alias("expected"), r(p[0]).alias("background"), r(p[1] + p[2] + p[3]).alias("plumes"), r(c("b")).alias("day_before"), (r(c("expected") - c("b") + TIE, 3) + 0.0).alias("change"))


@query("K4_observation_statistics", f"WITH {COMPONENTS} SELECT var, source_id, count(*) AS n, round(avg(value - {EXPECTED}) + {TIE}, 4) AS bias, round(sqrt(avg(power(value - {EXPECTED}, 2))) + {TIE}, 4) AS rmse FROM comp GROUP BY ALL")
def k4(spark, sf):
    e = c("value") - c("expected")
    return expected(spark, sf).groupBy("var", "source_id").agg(F.count(lit(1)).alias("n"), r(F.avg(e) + TIE).alias("bias"), r(F.sqrt(F.avg(e * e)) + TIE).alias("rmse"))


@query("K6_override_series", f"WITH {HOURLY}, s AS (SELECT var, sys_hour, avg(value) AS v FROM hourly GROUP BY ALL) SELECT var, sys_hour, round(v / 10 + {TIE}, 4) AS c0, round(0.8 + v / 200 + {TIE}, 4) AS c1, round(0.8 + v / 400 + {TIE}, 4) AS c2, round(0.8 + v / 600 + {TIE}, 4) AS c3 FROM s")
def k6(spark, sf):
    p = adjustments(spark, sf).groupBy("var", "sys_hour").pivot("cat", list(range(N_CAT))).agg(F.first("factor"))
    return p.select("var", "sys_hour", *[r(c(str(k)) + TIE).alias(f"c{k}") for k in range(N_CAT)])


@query("K7_trust_series", f"WITH {OBS} SELECT source_id, sys_hour, round(1000 * CAST(sum(CASE WHEN maturity = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS permille FROM obs GROUP BY ALL")
def k7(spark, sf):
    return observations(spark, sf).groupBy("source_id", "sys_hour").agg(r(1000 * F.sum((c("maturity") == 0).cast("double")) / F.count(lit(1)), 3).alias("permille"))


@query("K8_multi_source_series", f"WITH {HOURLY} SELECT sys_hour, round(max(CASE WHEN source_id = 'S0' THEN value END), 4) AS s0, round(max(CASE WHEN source_id = 'S1' THEN value END), 4) AS s1, round(max(CASE WHEN source_id = 'S2' THEN value END), 4) AS s2 FROM hourly WHERE var = 'view' AND source_id IN ('S0', 'S1', 'S2') GROUP BY sys_hour")
def k8(spark, sf):
    s = hourly(spark, sf).filter((c("var") == "view") & c("source_id").isin("S0", "S1", "S2"))
    p = s.groupBy("sys_hour").pivot("source_id", ["S0", "S1", "S2"]).agg(F.first("value"))
    return p.select("sys_hour", *[r(c(x)).alias(x.lower()) for x in ("S0", "S1", "S2")])


@query("K9_new_stations", f"WITH {OBS} SELECT DISTINCT source_id FROM obs WHERE source_id NOT IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier)")
def k9(spark, sf):
    from airloom.sources.adapters import stations

    return sinks.new_rows(observations(spark, sf).select("source_id").distinct(), stations(spark, sf).select(c("alias1").alias("source_id")), ["source_id"])


@query("K13_weekly_master", f"WITH {HOURLY}, s AS (SELECT var, sys_hour, avg(value) AS v FROM hourly GROUP BY ALL) SELECT var, sys_hour // 168 AS week, round(avg(0.8 + v / 200), 4) AS master FROM s GROUP BY ALL")
def k13(spark, sf):
    return adjustments(spark, sf).filter("cat = 1").groupBy("var", F.floor(c("sys_hour") / 168).alias("week")).agg(r(F.avg("factor")).alias("master"))


@query("M28_blocker_strength", "SELECT p_partkey, round((1 - (d - 5) / 100) * greatest(0, least(1, (h - 3) / 14)), 5) AS strength, round(CASE WHEN d BETWEEN 10 AND 250 THEN 0.02 * (1 - (d - 5) / 100) * greatest(0, least(1, (h - 3) / 14)) * (250 - d) / 250 ELSE 0 END, 6) + 0.0 AS wall FROM (SELECT p_partkey, CAST(p_partkey % 100 + 5 AS DOUBLE) AS d, CAST(p_size AS DOUBLE) AS h FROM part)")
def m28(spark, sf):
    from airloom.sources.adapters import table

    p = table(spark, sf, "part").select("p_partkey", (c("p_partkey") % 100 + 5).cast("double").alias("d"), c("p_size").cast("double").alias("h"))
    strength = (1 - (c("d") - 5) / 100) * F.greatest(lit(0.0), F.least(lit(1.0), (c("h") - 3) / 14))
    wall = F.when(c("d").between(10, 250), 0.02 * strength * (250 - c("d")) / 250).otherwise(0.0)
    return p.select("p_partkey", r(strength, 5).alias("strength"), (r(wall, 6) + 0.0).alias("wall"))


@query("M29_wind_reversal", "SELECT p_partkey, round(base, 6) AS base, round(greatest(0.3, 1 - base), 6) AS kept FROM (SELECT p_partkey, CASE WHEN x < 0.05 THEN 0 ELSE least(1, x) END AS base FROM (SELECT p_partkey, greatest(0, 0.011 * p_size * (60 - p_partkey % 60) / 60.0) AS x FROM part))")
def m29(spark, sf):
    from airloom.sources.adapters import table

    x = F.greatest(lit(0.0), 0.011 * c("p_size") * (60 - c("p_partkey") % 60) / 60.0)
    base = F.when(c("x") < 0.05, 0.0).otherwise(F.least(lit(1.0), c("x")))
    return table(spark, sf, "part").select("p_partkey", x.alias("x")).select("p_partkey", r(base, 6).alias("base"), r(F.greatest(lit(0.3), 1 - base), 6).alias("kept"))
