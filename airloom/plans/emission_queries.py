"""Queries for emissions, plumes, puffs and chemistry (M16 to M24, X17 to X29, X41 to X54, J13)."""

from pyspark.sql import functions as F

from airloom.functions import physics
from airloom.operators import dispersion as d
from airloom.operators import quality as q
from airloom.sources.adapters import EMISSIONS, OBS, emissions, observations, table
from airloom.sources.store import written

from .base import TIE, query

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x, n)


@query("X17_emission_density", f"WITH {EMISSIONS} SELECT h, w, CAST(floor(height_m / 5) AS BIGINT) + 1000 * cat AS key, round(sum(rate) / 4, 1) AS density, min(height_m) AS height_m FROM emissions GROUP BY ALL")
def x17(spark, sf):
    key = F.floor(c("height_m") / 5) + 1000 * c("cat")
    return emissions(spark, sf).groupBy("h", "w", key.alias("key")).agg(r(F.sum("rate") / 4, 1).alias("density"), F.min("height_m").alias("height_m"))


PLUME = """plume AS (SELECT h, w, cat, pollutant, rate, dh, dw, height_m, power(0.16 * x * power(1 + 0.0004 * x, -0.5), 2) / 2 AS ry, power(0.14 * x * power(1 + 0.003 * x, -0.5), 2) / 2 AS rz, x, y FROM dense, foot),
w AS (SELECT *, sqrt(ry * rz) AS rr, exp(-y * y / (4 * ry)) AS side, greatest(0, least(1, x / 300 - 2)) AS share, exp(-power(2 - height_m, 2) / 4 / rz) + exp(-power(2 + height_m, 2) / 4 / rz) AS free,
 (0.5 + cos(pi() / 300 * 2) * cos(pi() / 300 * height_m) * exp(-rz * power(pi() / 300, 2)) + cos(2 * pi() / 300 * 2) * cos(2 * pi() / 300 * height_m) * exp(-rz * power(2 * pi() / 300, 2)) + cos(3 * pi() / 300 * 2) * cos(3 * pi() / 300 * height_m) * exp(-rz * power(3 * pi() / 300, 2))) / 300 AS lid FROM plume),
conc AS (SELECT h + dh AS h, w + dw AS w, cat, pollutant, rate * (share * side * lid / sqrt(pi() * rr) + (1 - share) * side * free / (4 * pi() * rr)) / 3 AS conc FROM w)"""
DENSE = f"{EMISSIONS}, dense AS (SELECT h, w, cat, pollutant, height_m, sum(rate) AS rate FROM emissions GROUP BY ALL), foot AS (SELECT dh, dw, dh * 250.0 AS x, dw * 250.0 AS y FROM (SELECT unnest(range(1, 5)) AS dh), (SELECT unnest(range(-4, 5)) AS dw))"


def plume_sql(dense, foot, tag):
    """The plume CTEs with other sources and footprint; the last is ``conc`` + tag."""
    text = PLUME.replace("FROM dense, foot", f"FROM {dense}, {foot}")
    for name in ("plume", "conc"):
        text = text.replace(f"{name} AS (", f"{name}{tag} AS (").replace(f"FROM {name})", f"FROM {name}{tag})")
    return text.replace("w AS (SELECT", f"w{tag} AS (SELECT").replace("FROM w)", f"FROM w{tag})")


@query("X20_receptor_footprint", f"WITH {DENSE}, {PLUME} SELECT h, w, cat, pollutant, round(sum(conc) * 1e6, 3) AS conc FROM conc GROUP BY ALL")
def x20(spark, sf):
    got = d.receptor_sums(emissions(spark, sf), d.footprint(spark, 4, 250.0))
    return got.select("h", "w", "cat", "pollutant", r(c("conc") * 1e6, 3).alias("conc"))


@query("J13_upwind_lookup", f"WITH {DENSE} SELECT h + dh AS h, w + dw AS w, count(*) AS n, round(sum(rate), 6) AS rate FROM dense, foot GROUP BY ALL")
def j13(spark, sf):
    dense = emissions(spark, sf).groupBy("h", "w", "cat", "pollutant", "height_m").agg(F.sum("rate").alias("rate"))
    up = dense.crossJoin(F.broadcast(d.footprint(spark, 4, 250.0)))  # 36 rows
    return up.groupBy((c("h") + c("dh")).alias("h"), (c("w") + c("dw")).alias("w")).agg(F.count(lit(1)).alias("n"), r(F.sum("rate"), 6).alias("rate"))


@query("M16_speed_emission", f"WITH {EMISSIONS}, e AS (SELECT emitter, CAST(floor(height_m / 10) AS BIGINT) AS bin, rate FROM emissions) SELECT emitter, round(sum(rate * CASE bin WHEN 0 THEN 1.8 WHEN 1 THEN 1.4 WHEN 2 THEN 1.1 WHEN 3 THEN 1.0 ELSE 0.9 END), 3) AS ug FROM e GROUP BY emitter")
def m16(spark, sf):
    bins = spark.createDataFrame([(0, 1.8), (1, 1.4), (2, 1.1), (3, 1.0), (4, 0.9)], "bin long, factor double")  # fixed values by 10 km/h
    e = emissions(spark, sf).withColumn("bin", F.least(lit(4).cast("long"), F.floor(c("height_m") / 10)))
    return e.join(F.broadcast(bins), "bin").groupBy("emitter").agg(r(F.sum(c("rate") * c("factor")), 3).alias("ug"))


COMPS = f"{EMISSIONS}, comps AS (SELECT h, w, cat, sum(CASE WHEN pollutant = 'A' THEN -rate * share * 4 ELSE rate * share END) AS v FROM emissions GROUP BY ALL)"


def comps(spark, sf):
    part = F.when(c("pollutant") == "A", -c("rate") * c("share") * 4).otherwise(c("rate") * c("share"))
    return emissions(spark, sf).groupBy("h", "w", "cat").agg(F.sum(part).alias("v"))


@query("M18_o3_balance", f"WITH {COMPS}, t AS (SELECT h, w, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS pos, sum(CASE WHEN v <= 0 THEN v ELSE 0 END) AS neg FROM comps GROUP BY ALL) SELECT h, w, cat, round(CASE WHEN pos + neg < 0 AND v < 0 THEN v * -pos / neg ELSE v END, 3) + 0.0 AS v FROM comps JOIN t USING (h, w)")
def m18(spark, sf):
    x = comps(spark, sf)
    t = x.groupBy("h", "w").agg(F.sum(F.when(c("v") > 0, c("v")).otherwise(0.0)).alias("pos"), F.sum(F.when(c("v") <= 0, c("v")).otherwise(0.0)).alias("neg"))
    v = F.when((c("pos") + c("neg") < 0) & (c("v") < 0), c("v") * -c("pos") / c("neg")).otherwise(c("v"))
    return x.join(t, ["h", "w"]).select("h", "w", "cat", (r(v, 3) + 0.0).alias("v"))


@query("M19_photochemistry", f"WITH {EMISSIONS}, n AS (SELECT h, w, cat, sum(rate) AS v FROM emissions WHERE cat > 1 GROUP BY ALL), t AS (SELECT h, w, sum(v) AS total FROM n GROUP BY ALL) SELECT h, w, cat, round(CASE WHEN total * 65 / 85.0 <= 60 THEN v ELSE v * (total - (total * 65 / 85.0 - 60)) / total END, 5) AS no2 FROM n JOIN t USING (h, w)")
def m19(spark, sf):
    """NO2 beyond what 60 units of background ozone can form is taken from all categories alike."""
    n = emissions(spark, sf).filter("cat > 1").groupBy("h", "w", "cat").agg(F.sum("rate").alias("v"))
    t = n.groupBy("h", "w").agg(F.sum("v").alias("total"))
    formed = c("total") * 65 / 85.0
    v = F.when(formed <= 60, c("v")).otherwise(c("v") * (c("total") - (formed - 60)) / c("total"))
    return n.join(t, ["h", "w"]).select("h", "w", "cat", r(v, 5).alias("no2"))


@query("M24_puff_at_point", "WITH p AS (SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS h, power(0.16 * p_retailprice * power(1 + 0.0004 * p_retailprice, -0.5), 2) / 2 AS ry, power(0.14 * p_retailprice * power(1 + 0.003 * p_retailprice, -0.5), 2) / 2 AS rz FROM part) SELECT p_partkey, round(1e9 * exp(-2500 / (4 * ry)) * (exp(-power(2 - h, 2) / 4 / rz) + exp(-power(2 + h, 2) / 4 / rz)) / (8 * power(pi() * sqrt(ry * rz), 1.5)), 4) AS conc FROM p")
def m24(spark, sf):
    conc = d.puff_concentration(lit(2500.0), c("p_retailprice"), c("p_size").cast("double"), lit(2.0))
    return table(spark, sf, "part").select("p_partkey", r(1e9 * conc).alias("conc"))


@query("M30_road_dust", f"WITH {OBS}, f AS (SELECT source_id, sys_hour, count(*) AS n FROM obs GROUP BY ALL) SELECT a.source_id, a.sys_hour, round(power((a.n + coalesce(b.n, 0)) / 2.0 * 1.3, 0.6) * 0.8, 5) AS dust FROM f a LEFT JOIN f b ON a.source_id = b.source_id AND b.sys_hour = a.sys_hour - 2")
def m30(spark, sf):
    f = observations(spark, sf).groupBy("source_id", "sys_hour").agg(F.count(lit(1)).alias("n"))
    before = f.select("source_id", (c("sys_hour") + 2).alias("sys_hour"), c("n").alias("b"))
    dust = F.pow((c("n") + F.coalesce("b", lit(0))) / 2.0 * 1.3, lit(0.6)) * 0.8
    return f.join(before, ["source_id", "sys_hour"], "left").select("source_id", "sys_hour", r(dust, 5).alias("dust"))


@query("X25_puff_release", f"WITH {EMISSIONS}, e AS (SELECT emitter, cat, h, w, sum(rate) AS rate FROM emissions GROUP BY ALL) SELECT cat, CAST(sum(greatest(1, ceil(rate / 20))) AS BIGINT) AS puffs, round(sum(rate), 2) AS mass FROM e GROUP BY cat")
def x25(spark, sf):
    e = emissions(spark, sf).groupBy("emitter", "cat", "h", "w").agg(F.sum("rate").alias("rate"), F.max("height_m").alias("height_m"))
    return d.released(e, 20.0).groupBy("cat").agg(F.count(lit(1)).alias("puffs"), r(F.sum("mass"), 2).alias("mass"))


def cell_sources(spark, sf):
    return emissions(spark, sf).groupBy("cat", "h", "w").agg(F.sum("rate").alias("rate"), F.max("height_m").alias("height_m")).withColumn("emitter", lit("C"))


PUFFS = f"{EMISSIONS}, e AS (SELECT cat, h, w, sum(rate) AS rate, max(height_m) AS h_m FROM emissions GROUP BY ALL), p AS (SELECT cat, h_m, h * 100.0 + 600 AS y_m, w * 100.0 + 300 AS x_m, rate * exp(-0.02 * 300 / 3600) AS mass FROM e)"


@query("X26_puff_advection", f"WITH {PUFFS} SELECT cat, y_m, x_m, round(sum(mass), 4) AS mass FROM p GROUP BY ALL")
def x26(spark, sf):
    p = d.advected(d.released(cell_sources(spark, sf), 1e9), 2.0, 1.0, 300.0, 0.02)
    return p.groupBy("cat", "y_m", "x_m").agg(r(F.sum("mass")).alias("mass"))


@query("X27_puff_merge", f"WITH {PUFFS} SELECT CASE WHEN h_m < 40 THEN 0 WHEN h_m < 80 THEN 1 ELSE 2 END AS band, CAST(floor(y_m / 500) AS BIGINT) AS cy, CAST(floor(x_m / 500) AS BIGINT) AS cx, cat, round(sum(mass), 4) AS mass, round(sum(y_m * mass) / sum(mass), 4) AS y_m FROM p GROUP BY ALL")
def x27(spark, sf):
    m = d.merged(d.advected(d.released(cell_sources(spark, sf), 1e9), 2.0, 1.0, 300.0, 0.02), 500.0)
    return m.select(d.height_band(c("h_m")).alias("band"), F.floor(c("y_m") / 500 + 1e-9).alias("cy"), F.floor(c("x_m") / 500 + 1e-9).alias("cx"), "cat", r(c("mass")).alias("mass"), r(c("y_m")).alias("y_m"))


def tick_sql(name, before, north, east, decay=0.02):
    """One tick in SQL: the puffs of ``before`` (or none) and fresh ones, moved and merged."""
    old = f"SELECT cat, h_m, y_m, x_m, dist_m, mass FROM {before} UNION ALL " if before else ""
    fresh = f"({old}SELECT cat, h_m, h * 100.0 AS y_m, w * 100.0 AS x_m, 0.0 AS dist_m, rate AS mass FROM e)"
    moved = f"SELECT cat, h_m, y_m + {north * 300.0} AS y_m, x_m + {east * 300.0} AS x_m, dist_m + {(north * north + east * east) ** 0.5 * 300.0!r} AS dist_m, mass * exp({-decay * 300 / 3600!r}) AS mass FROM {fresh}"
    keys = "CASE WHEN h_m < 40 THEN 0 WHEN h_m < 80 THEN 1 ELSE 2 END, CAST(floor(y_m / 500 + 1e-9) AS BIGINT), CAST(floor(x_m / 500 + 1e-9) AS BIGINT)"
    means = ", ".join(f"sum({c} * mass) / sum(mass) AS {c}" for c in ("h_m", "y_m", "x_m", "dist_m"))
    return f"{name} AS (SELECT cat, {means}, sum(mass) AS mass FROM ({moved}) GROUP BY cat, {keys})"


def layer_sql(puffs):
    return f"""r AS (SELECT *, 2 + CAST(floor(0.25 * dist_m / 500) AS BIGINT) AS rad, CAST(floor(y_m / 500 + 1e-9) AS BIGINT) AS ch, CAST(floor(x_m / 500 + 1e-9) AS BIGINT) AS cw, greatest(dist_m, 10) AS d FROM {puffs}),
g AS (SELECT *, power(0.16 * d * power(1 + 0.0004 * d, -0.5), 2) / 2 AS ry, power(0.14 * d * power(1 + 0.003 * d, -0.5), 2) / 2 AS rz FROM r),
y AS (SELECT *, unnest(range(-rad, rad + 1)) AS dh FROM g), x AS (SELECT *, unnest(range(-rad, rad + 1)) AS dw FROM y)
SELECT ch + dh AS h, cw + dw AS w, cat, round(1e6 * sum(mass * exp(-(power((ch + dh + 0.5) * 500 - y_m, 2) + power((cw + dw + 0.5) * 500 - x_m, 2)) / (4 * ry)) * (exp(-power(2 - h_m, 2) / 4 / rz) + exp(-power(2 + h_m, 2) / 4 / rz)) / (8 * power(pi() * sqrt(ry * rz), 1.5))), 3) AS conc FROM x GROUP BY ALL"""


CELL_SOURCES = f"{EMISSIONS}, e AS (SELECT cat, h, w, sum(rate) AS rate, max(height_m) AS h_m FROM emissions GROUP BY ALL)"
TICKS = ", ".join([tick_sql("t1", None, 2.0, 1.0), tick_sql("t2", "t1", 2.0, 0.5), tick_sql("t3", "t2", 1.5, -0.5)])


@query("X28_puff_layer", f"WITH {CELL_SOURCES}, {tick_sql('t0', None, 2.0, 1.0, 0.0)}, {layer_sql('t0')}")
def x28(spark, sf):
    return d.puff_layer(d.merged(d.advected(d.released(cell_sources(spark, sf), 1e9), 2.0, 1.0, 300.0), 500.0), 500.0).withColumn("conc", r(1e6 * c("conc"), 3))


@query("X24_puff_simulation", f"WITH {CELL_SOURCES}, {TICKS}, {layer_sql('t3')}")
def x24(spark, sf):
    puffs = d.simulated(cell_sources(spark, sf), [(2.0, 1.0), (2.0, 0.5), (1.5, -0.5)], 300.0, 500.0, 1e9, written)
    return d.puff_layer(puffs, 500.0).withColumn("conc", r(1e6 * c("conc"), 3))


@query("X41_emitter_proxy", f"WITH {EMISSIONS}, e AS (SELECT emitter, sum(CASE WHEN pollutant = 'N' THEN rate ELSE 0 END) AS n, sum(CASE WHEN pollutant = 'R' THEN rate ELSE 0 END) AS r FROM emissions GROUP BY ALL) SELECT emitter, round(CASE WHEN r = 0 THEN 0.3 * n ELSE r END, 3) AS r FROM e")
def x41(spark, sf):
    total = lambda p: F.sum(F.when(c("pollutant") == p, c("rate")).otherwise(0.0))
    e = emissions(spark, sf).groupBy("emitter").agg(total("N").alias("n"), total("R").alias("r"))
    return e.select("emitter", r(F.when(c("r") == 0, 0.3 * c("n")).otherwise(c("r")), 3).alias("r"))


#: Emission of vehicle classes by speed: middle and amplitude of a curve that is least at 55 km/h.
CLASSES = [(1, 0.9, 0.5), (2, 1.6, 0.7), (3, 4.0, 1.8), (4, 5.5, 2.5)]
FACTORS = "factors AS (SELECT cat, bin, mid + amp * power((bin - 5) / 5.0, 2) AS factor FROM (VALUES " + ", ".join(f"({k}, {m}, {a})" for k, m, a in CLASSES) + ") v(cat, mid, amp), (SELECT unnest(range(0, 13)) AS bin))"


@query("X43_traffic_emission", f"WITH {EMISSIONS}, {FACTORS}, road AS (SELECT emitter, cat, least(12, CAST(floor((20 + avg(height_m)) / 10 + 1e-9) AS BIGINT)) AS bin, sum(rate) AS flow FROM emissions WHERE cat <= 4 GROUP BY ALL), k AS (SELECT unnest(range(0, 24)) AS hour) SELECT emitter, hour, round(sum(flow * (1 + 0.6 * cos((hour - 8) * pi() / 12)) / 24 * factor), 4) AS ug FROM road JOIN factors USING (cat, bin) CROSS JOIN k GROUP BY ALL")
def x43(spark, sf):
    """Each road's emission by hour: flows of the vehicle classes, spread over the day, times the class's factor at the road's speed."""
    v = spark.createDataFrame(CLASSES, "cat long, mid double, amp double").withColumn("bin", F.explode(F.sequence(lit(0).cast("long"), lit(12).cast("long"))))
    factors = v.select("cat", "bin", (c("mid") + c("amp") * F.pow((c("bin") - 5) / 5.0, lit(2))).alias("factor"))
    bin_ = F.least(lit(12).cast("long"), F.floor((20 + F.avg("height_m")) / 10 + 1e-9))
    road = emissions(spark, sf).filter("cat <= 4").groupBy("emitter", "cat").agg(bin_.alias("bin"), F.sum("rate").alias("flow"))
    load = road.join(F.broadcast(factors), ["cat", "bin"]).groupBy("emitter").agg(F.sum(c("flow") * c("factor")).alias("load"))  # 52 factors
    hours = load.select("emitter", "load", F.explode(F.sequence(lit(0).cast("long"), lit(23).cast("long"))).alias("hour"))
    return hours.select("emitter", "hour", r(c("load") * (1 + 0.6 * F.cos((c("hour") - 8) * lit(3.141592653589793) / 12)) / 24).alias("ug"))


@query("X45_point_rates", f"WITH {EMISSIONS} SELECT emitter, pollutant, round(sum(rate) * 1.2 / 3600, 6) AS ug_s FROM emissions WHERE height_m > 30 GROUP BY ALL")
def x45(spark, sf):
    return emissions(spark, sf).filter("height_m > 30").groupBy("emitter", "pollutant").agg(r(F.sum("rate") * 1.2 / 3600, 6).alias("ug_s"))


TRACK = f"{OBS}, t AS (SELECT source_id AS vessel, sec, avg(value) * 20 AS y_m, CAST(min(event_id) % 1000 AS DOUBLE) * 5 AS x_m, max(value) AS rate FROM obs GROUP BY source_id, sec), legs AS (SELECT *, lead(sec) OVER w AS n_sec, lead(y_m) OVER w AS n_y, lead(x_m) OVER w AS n_x, lead(rate) OVER w AS n_rate FROM t WINDOW w AS (PARTITION BY vessel ORDER BY sec)), s AS (SELECT *, n_sec - sec AS dur, CAST(floor(1.2 * sqrt(power(n_y - y_m, 2) + power(n_x - x_m, 2)) / 500 + 1) AS BIGINT) AS steps FROM legs WHERE n_sec - sec > 0 AND n_sec - sec <= 7200 AND rate + n_rate > 0), k AS (SELECT *, unnest(range(0, steps + 1)) AS k FROM s)"


@query("X46_trajectory_raster", f"WITH {TRACK} SELECT vessel, CAST(floor((y_m + (n_y - y_m) * k / steps) / 500 + 1e-9) AS BIGINT) AS h, round(sum((rate + (n_rate - rate) * k / steps) * dur / (steps + 1)), 1) AS mass FROM k GROUP BY ALL")
def x46(spark, sf):
    t = observations(spark, sf).groupBy(c("source_id").alias("vessel"), "sec").agg((F.avg("value") * 20).alias("y_m"), ((F.min("event_id") % 1000).cast("double") * 5).alias("x_m"), F.max("value").alias("rate"))
    return d.trajectory_points(t, "vessel", 500.0).groupBy("vessel", F.floor(c("y_m") / 500 + 1e-9).alias("h")).agg(r(F.sum("mass"), 1).alias("mass"))


@query("X48_flow_estimate", "SELECT p_partkey, round(280 * power(p_size % 4 + 1, 1.3) * power(greatest(p_retailprice, 800) / 1000, 0.7) * sqrt(least(6, 1 + p_size % 3)) * sqrt(greatest(30, least(100, p_size * 3))), 3) AS flow FROM part")
def x48(spark, sf):
    size = c("p_size").cast("double")
    flow = 280 * F.pow(c("p_size") % 4 + 1, lit(1.3)) * F.pow(F.greatest(c("p_retailprice"), lit(800.0)) / 1000, lit(0.7)) * F.sqrt(F.least(lit(6.0), 1 + size % 3)) * F.sqrt(F.greatest(lit(30.0), F.least(lit(100.0), size * 3)))
    return table(spark, sf, "part").select("p_partkey", r(flow, 3).alias("flow"))


@query("X53_map_cell_profile", f"WITH {EMISSIONS}, s AS (SELECT h // 5 AS h, w // 5 AS w, cat, sum(rate) AS rate FROM emissions GROUP BY ALL) SELECT h, w, cat, round(rate * 300, 4) AS mass, round(100 * rate / sum(rate) OVER (PARTITION BY h, w), 4) AS percent FROM s")
def x53(spark, sf):
    s = emissions(spark, sf).groupBy(F.floor(c("h") / 5).alias("h"), F.floor(c("w") / 5).alias("w"), "cat").agg(F.sum("rate").alias("rate"))
    return q.with_share(s, "rate", ["h", "w"]).select("h", "w", "cat", r(c("rate") * 300, 4).alias("mass"), r(100 * c("share")).alias("percent"))


@query("X54_density_map", f"WITH {EMISSIONS} SELECT h, w, round(sum(rate) * 0.25, 4) AS density FROM emissions WHERE cat = 3 AND pollutant = 'N' GROUP BY h, w")
def x54(spark, sf):
    return emissions(spark, sf).filter("cat = 3 and pollutant = 'N'").groupBy("h", "w").agg(r(F.sum("rate") * 0.25).alias("density"))


@query("X58_flow_edits", f"WITH {EMISSIONS}, p AS (SELECT emitter, h, w, cat, dayofweek(day) AS dow, sum(rate) AS flow FROM emissions GROUP BY ALL), e AS (SELECT h, w, dow, flow * CASE cat WHEN 1 THEN 1.5 WHEN 2 THEN 0.8 ELSE 1 END * CASE WHEN dow IN (0, 6) THEN 0.7 ELSE 1 END AS flow FROM p) SELECT h, w, CAST(dow + 1 AS BIGINT) AS dow, count(*) AS pieces, round(sum(flow) + {TIE}, 3) AS flow FROM e GROUP BY h, w, dow")
def x58(spark, sf):
    """Flows edited by vehicle class and day of the week; parallel pieces of road in a cell are stacked."""
    p = emissions(spark, sf).groupBy("emitter", "h", "w", "cat", F.dayofweek("day").cast("long").alias("dow")).agg(F.sum("rate").alias("flow"))
    amplified = c("flow") * F.when(c("cat") == 1, 1.5).when(c("cat") == 2, 0.8).otherwise(1.0) * F.when(c("dow").isin(1, 7), 0.7).otherwise(1.0)
    return p.withColumn("flow", amplified).groupBy("h", "w", "dow").agg(F.count(lit(1)).alias("pieces"), r(F.sum("flow") + TIE, 3).alias("flow"))


@query("X64_temporal_audit", f"WITH {EMISSIONS}, e AS (SELECT cat, emitter, sum(rate) AS rate, avg(share) AS share FROM emissions GROUP BY ALL), k AS (SELECT unnest(range(0, 24)) AS hour) SELECT cat, emitter, hour, round(rate * (1 + share * cos((hour - 8) * pi() / 12)) / 24, 5) AS rate FROM e CROSS JOIN k")
def x64(spark, sf):
    """Every emitter at every hour of a day: its rate by its own daily swing."""
    e = emissions(spark, sf).groupBy("cat", "emitter").agg(F.sum("rate").alias("rate"), F.avg("share").alias("share"))
    hours = e.select("*", F.explode(F.sequence(lit(0).cast("long"), lit(23).cast("long"))).alias("hour"))
    return hours.select("cat", "emitter", "hour", r(c("rate") * (1 + c("share") * F.cos((c("hour") - 8) * lit(3.141592653589793) / 12)) / 24, 5).alias("rate"))


@query("X65_rain_slots", f"WITH {OBS} SELECT sec // 900 * 900 AS slot, round(avg(value), 4) AS rain FROM obs WHERE var = 'view' GROUP BY ALL")
def x65(spark, sf):
    return observations(spark, sf).filter("var = 'view'").groupBy((F.floor(c("sec") / 900) * 900).alias("slot")).agg(r(F.avg("value")).alias("rain"))
