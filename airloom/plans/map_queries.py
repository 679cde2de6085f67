"""Queries on areas, roads, rays, the sun and multi-range grids."""

import uuid

from pyspark.sql import functions as F

from airloom.functions import geo, physics, sun
from airloom.operators import dispersion as d
from airloom.operators import spatial as s
from airloom.operators import tiles
from airloom.operators import temporal as t
from airloom.sources import sinks
from airloom.sources.adapters import CELLS, EMISSIONS, OBS, STATIONS, emissions, grid_cells, observations, stations, table

from airloom.sources.store import scratch_folder

from .base import TIE, query
from .emission_queries import plume_sql
from .quality_queries import HOURLY, hourly
from .time_queries import FORECAST

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x, n)
M = "6371000.0 * 2 * pi() / 360"
#: The cells of a straight line from (h0, w0) to (h1, w1), by steps along its longer side.
LINE = "steps AS (SELECT *, greatest(abs(h1 - h0), abs(w1 - w0)) + 1 AS n FROM l), each AS (SELECT *, unnest(range(0, n)) AS k, greatest(1, n - 1) AS m FROM steps), line AS (SELECT * EXCLUDE (h0, h1, w0, w1), h0 + CAST(floor((2 * k * (h1 - h0) + m) / (2.0 * m)) AS BIGINT) AS h, w0 + CAST(floor((2 * k * (w1 - w0) + m) / (2.0 * m)) AS BIGINT) AS w FROM each)"
#: A test polygon (lat, lon), closed.
POLYGON = [(60.05, 24.05), (60.35, 24.1), (60.38, 24.55), (60.2, 24.7), (60.07, 24.4), (60.05, 24.05)]
CROSSINGS = " + ".join(
    f"CASE WHEN ({a} > lat) <> ({b} > lat) AND lon < ({bx} - {ax}) * (lat - {a}) / ({b} - {a}) + {ax} THEN 1 ELSE 0 END" for (a, ax), (b, bx) in zip(POLYGON, POLYGON[1:])
)


@query("F9_area_filter", f"WITH {STATIONS} SELECT station, ({CROSSINGS}) % 2 = 1 AND sqrt(power(lat - 60.2, 2) + power(cos(radians(60.2)) * (lon - 24.4), 2)) * {M} < 15000 AS included FROM stations")
def f9(spark, sf):
    crossings = lit(0)
    for (a, ax), (b, bx) in zip(POLYGON, POLYGON[1:]):
        hit = ((lit(a) > c("lat")) != (lit(b) > c("lat"))) & (c("lon") < (bx - ax) * (c("lat") - a) / (b - a) + ax)
        crossings = crossings + F.when(hit, 1).otherwise(0)
    near = geo.distance_m(c("lat"), c("lon"), lit(60.2), lit(24.4)) < 15000
    return stations(spark, sf).select("station", ((crossings % 2 == 1) & near).alias("included"))


@query("F10_road_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40 AND p_partkey % 5 <= 2 AND p_name NOT LIKE '%0' AND p_retailprice < 1500")
def f10(spark, sf):
    return table(spark, sf, "part").filter("p_size between 10 and 40 and p_partkey % 5 <= 2 and p_name not like '%0' and p_retailprice < 1500").select("p_partkey")


@query("J4_grid_alias_types", f"WITH {CELLS} SELECT a.h, a.w, round(a.value + 2 * b.value, 4) AS total FROM cells a JOIN cells b ON b.h = a.h // 2 AND b.w = a.w // 2")
def j4(spark, sf):
    g = grid_cells(spark, sf).select("h", "w", "value")
    b = g.select(c("h").alias("bh"), c("w").alias("bw"), c("value").alias("b"))
    a = g.withColumns({"bh": F.floor(c("h") / 2), "bw": F.floor(c("w") / 2)})
    return a.join(b, ["bh", "bw"]).select("h", "w", r(c("value") + 2 * c("b")).alias("total"))


@query("M11_roughness", f"WITH {CELLS} SELECT h, w, round(CASE size % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.03 WHEN 2 THEN 0.5 ELSE greatest(0.3, least(2, 0.1 * size)) END, 5) AS roughness FROM cells")
def m11(spark, sf):
    k = c("size") % 4
    rough = F.when(k == 0, 0.001).when(k == 1, 0.03).when(k == 2, 0.5).otherwise(F.greatest(lit(0.3), F.least(lit(2.0), 0.1 * c("size"))))
    return grid_cells(spark, sf).select("h", "w", r(rough, 5).alias("roughness"))


@query("M12_sun", f"""WITH {OBS}, a AS (SELECT event_id, lat, lon, sec / 86400.0 - 10957.5 AS d, (sec % 86400) / 3600.0 AS hh FROM obs),
b AS (SELECT *, 2.1429 - 0.0010394594 * d AS node, 6.24006 + 0.0172019699 * d AS m FROM a),
e AS (SELECT *, 4.895063 + 0.017202791698 * d + 0.03341607 * sin(m) + 0.00034894 * sin(2 * m) - 0.0001134 - 0.0000203 * sin(node) AS ecl, 0.4090928 - 6.214e-9 * d + 0.0000396 * cos(node) AS tilt FROM b),
f AS (SELECT *, asin(sin(tilt) * sin(ecl)) AS decl, radians((6.6974243242 + 0.0657098283 * d + hh) * 15 + lon) - atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ha, radians(lat) AS phi FROM e),
z AS (SELECT *, acos(cos(phi) * cos(ha) * cos(decl) + sin(decl) * sin(phi)) AS zen FROM f) SELECT event_id, round(90 - degrees(zen + 6371.01 / 149597890.0 * sin(zen)), 4) AS elevation FROM z""")
def m12(spark, sf):
    e, _ = sun.position(c("sec"), c("lat"), c("lon"))
    return observations(spark, sf).select("event_id", r(e).alias("elevation"))


@query("M15_profile_product", f"WITH {OBS} SELECT event_id, round((1 + 0.3 * cos(hour(ts) * pi() / 12)) * 1.7 * (0.5 + 1.5 * power(greatest(0, least(1, value / 300)), 0.8)) + 0.2 * CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END, 5) AS scaler FROM obs")
def m15(spark, sf):
    diurnal = 1 + 0.3 * F.cos(F.hour("ts") * (lit(3.141592653589793) / 12))
    met = geo.curve(c("value"), 0.0, 300.0, 0.5, 2.0, 0.8)
    return observations(spark, sf).select("event_id", r(diurnal * 1.7 * met + 0.2 * F.when(F.dayofweek("ts").isin(1, 7), 1).otherwise(0), 5).alias("scaler"))


@query("M23_plume_weight", """WITH s AS (SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS h, power(0.16 * p_retailprice * power(1 + 0.0004 * p_retailprice, -0.5), 2) / 2 AS ry, power(0.14 * p_retailprice * power(1 + 0.003 * p_retailprice, -0.5), 2) / 2 AS rz FROM part),
w AS (SELECT *, sqrt(ry * rz) AS rr, exp(-400 / (4 * ry)) AS side, greatest(0, least(1, x / 400 - 2)) AS share, exp(-power(2 - h, 2) / 4 / rz) + exp(-power(2 + h, 2) / 4 / rz) AS free, (0.5 + cos(pi() / 400 * 2) * cos(pi() / 400 * h) * exp(-rz * power(pi() / 400, 2)) + cos(2 * pi() / 400 * 2) * cos(2 * pi() / 400 * h) * exp(-rz * power(2 * pi() / 400, 2)) + cos(3 * pi() / 400 * 2) * cos(3 * pi() / 400 * h) * exp(-rz * power(3 * pi() / 400, 2))) / 400 AS lid FROM s)
SELECT p_partkey, round(1e6 * (share * side * lid / sqrt(pi() * rr) + (1 - share) * side * free / (4 * pi() * rr)) / 4, 4) AS weight FROM w""")
def m23(spark, sf):
    w = physics.plume(c("p_retailprice"), lit(20.0), lit(2.0), c("p_size").cast("double"), lit(4.0), lit(400.0), lit(3))
    return table(spark, sf, "part").select("p_partkey", r(1e6 * w).alias("weight"))


@query("X6_soft_refinement", f"WITH {CELLS} SELECT a.h, a.w, round(sum(b.value / power(greatest(0.25, power(a.h - b.h, 2) + power(a.w - b.w, 2)), 0.4)) / sum(1 / power(greatest(0.25, power(a.h - b.h, 2) + power(a.w - b.w, 2)), 0.4)), 3) AS value FROM cells a JOIN cells b ON b.h BETWEEN a.h - 1 AND a.h + 1 AND b.w BETWEEN a.w - 1 AND a.w + 1 GROUP BY a.h, a.w")
def x6(spark, sf):
    g = grid_cells(spark, sf).select("h", "w", "value")
    return tiles.windows(tiles.asked(g), 1, tiles.mean(1, lambda dh, dw: max(0.25, dh * dh + dw * dw) ** -0.4)).select("h", "w", r(c("value"), 3).alias("value"))


@query("X11_missing_puff_cells", f"WITH {CELLS}, have AS (SELECT * FROM cells WHERE size > 25), e AS (SELECT h, w FROM cells WHERE size <= 25) SELECT e.h, e.w, round(sum(b.value / greatest(2.25, power(e.h - b.h, 2) + power(e.w - b.w, 2))) / sum(1 / greatest(2.25, power(e.h - b.h, 2) + power(e.w - b.w, 2))), 3) AS value FROM e JOIN have b ON b.h BETWEEN e.h - 3 AND e.h + 3 AND b.w BETWEEN e.w - 3 AND e.w + 3 GROUP BY e.h, e.w")
def x11(spark, sf):
    g = grid_cells(spark, sf).select("h", "w", "value", "size")
    return s.filled_cells(g.filter("size > 25").select("h", "w", "value"), g.select("h", "w"), 3).withColumn("value", r(c("value"), 3))


FINE = f"{EMISSIONS}, dense AS (SELECT h, w, cat, pollutant, height_m, sum(rate) AS rate FROM emissions GROUP BY ALL), foot AS (SELECT dh, dw, dh * 250.0 AS x, dw * 250.0 AS y FROM (SELECT unnest(range(1, 5)) AS dh), (SELECT unnest(range(-4, 5)) AS dw))"
COARSE = "coarse AS (SELECT h // 4 AS h, w // 4 AS w, cat, pollutant, height_m, sum(rate) AS rate FROM dense GROUP BY ALL), wide AS (SELECT dh, dw, dh * 1000.0 AS x, dw * 1000.0 AS y FROM (SELECT unnest(range(2, 5)) AS dh), (SELECT unnest(range(-4, 5)) AS dw))"


@query("X22_two_ranges", f"WITH {FINE}, {COARSE}, {plume_sql('dense', 'foot', '_near')}, {plume_sql('coarse', 'wide', '_far')}, near AS (SELECT h, w, sum(conc) AS v FROM conc_near GROUP BY ALL), far AS (SELECT h AS ch, w AS cw, sum(conc) AS f FROM conc_far GROUP BY ALL) SELECT n.h, n.w, round(1e6 * (n.v + coalesce(f.f, 0)), 3) AS total FROM near n LEFT JOIN far f ON f.ch = CAST(floor(n.h / 4.0) AS BIGINT) AND f.cw = CAST(floor(n.w / 4.0) AS BIGINT)")
def x22(spark, sf):
    """Plumes of the near range on fine cells, and of the far range (beyond a coarse cell) on cells four times as wide."""
    e = emissions(spark, sf)
    total = lambda rows: rows.groupBy("h", "w").agg(F.sum("conc").alias("v"))
    near = total(d.receptor_sums(e, d.footprint(spark, 4, 250.0)))
    coarse = e.withColumns({"h": F.floor(c("h") / 4), "w": F.floor(c("w") / 4)})
    far = total(d.receptor_sums(coarse, d.footprint(spark, 4, 1000.0).filter("dh > 1"))).select(c("h").alias("ch"), c("w").alias("cw"), c("v").alias("f"))
    both = near.withColumns({"ch": F.floor(c("h") / 4), "cw": F.floor(c("w") / 4)}).join(far, ["ch", "cw"], "left")
    return both.select("h", "w", r(1e6 * (c("v") + F.coalesce("f", lit(0.0))), 3).alias("total"))


@query("X29_background_markers", f"WITH {OBS}, m AS (SELECT sid // 2 AS bh, (sys_hour % 7) // 2 AS bw, value, sec, row_number() OVER (PARTITION BY sid // 2, (sys_hour % 7) // 2 ORDER BY sec DESC, event_id DESC) AS k FROM obs), n AS (SELECT bh, bw, value, greatest(0, ((SELECT max(sec) FROM obs) - sec) / 3600.0 - 5) AS late FROM m WHERE k = 1), d AS (SELECT value, h, w, greatest(2, sqrt(power(h - 2 * bh - 0.5, 2) + power(w - 2 * bw - 0.5, 2)) + late) AS d FROM n, (SELECT unnest(range(0, 6)) AS h), (SELECT unnest(range(0, 7)) AS w)) SELECT h, w, round(sum(value / power(d, 2)) / sum(1 / power(d, 2)), 4) AS background FROM d GROUP BY h, w")
def x29(spark, sf):
    """The newest marker of each block of 2 x 2 cells, spread over the grid by inverse squared distance, 2 cells at least; a marker older than five
    hours counts as a cell farther for each hour."""
    o = observations(spark, sf).withColumns({"bh": F.floor(c("sid") / 2), "bw": F.floor((c("sys_hour") % 7) / 2)})
    newest = o.groupBy("bh", "bw").agg(F.max(F.struct("sec", "event_id", "value")).alias("m"))
    end = o.agg(F.max("sec").alias("end"))  # one row
    cells = spark.range(42).select(F.floor(c("id") / 7).alias("h"), (c("id") % 7).alias("w"))
    late = F.greatest(lit(0.0), (c("end") - c("m.sec")) / 3600.0 - 5)
    n = newest.crossJoin(F.broadcast(end)).crossJoin(F.broadcast(cells))  # 12 blocks by 42 cells
    dist = F.greatest(lit(2.0), F.sqrt(F.pow(c("h") - 2 * c("bh") - 0.5, 2) + F.pow(c("w") - 2 * c("bw") - 0.5, 2)) + late)
    return s.weighted(n.select("h", "w", c("m.value").alias("value"), dist.alias("d")), ["h", "w"], 1 / F.pow("d", lit(2))).select("h", "w", r(c("value")).alias("background"))


STATION_PARTS = f"st AS (SELECT DISTINCT source_id, CAST(sid * 5 + 6 AS BIGINT) AS h, CAST(sid * 6 + 5 AS BIGINT) AS w FROM obs), near_em AS (SELECT * FROM emissions SEMI JOIN (SELECT DISTINCT st.h - dh AS h, st.w - dw AS w FROM st, foot) q USING (h, w)), dense AS (SELECT h, w, cat, pollutant, height_m, sum(rate) AS rate FROM near_em GROUP BY ALL), {plume_sql('dense', 'foot', '')}, parts AS (SELECT source_id, cat, sum(conc) AS v FROM st JOIN conc USING (h, w) GROUP BY ALL)"
FOOT = "foot AS (SELECT dh, dw, dh * 250.0 AS x, dw * 250.0 AS y FROM (SELECT unnest(range(1, 5)) AS dh), (SELECT unnest(range(-4, 5)) AS dw))"


def station_parts(spark, sf):
    """``(source_id, cat, v)``: plumes of the emission cells upwind of each station; other cells are not worked out."""
    st = observations(spark, sf).select("source_id", (c("sid") * 5 + 6).alias("h"), (c("sid") * 6 + 5).alias("w")).distinct()
    foot = d.footprint(spark, 4, 250.0)
    asked = st.crossJoin(F.broadcast(foot.select("dh", "dw"))).select((c("h") - c("dh")).alias("h"), (c("w") - c("dw")).alias("w")).distinct()  # 36 cells a station
    conc = d.receptor_sums(emissions(spark, sf).join(asked, ["h", "w"], "left_semi"), foot)
    return st.join(conc, ["h", "w"]).groupBy("source_id", "cat").agg(F.sum("conc").alias("v"))


@query("X21_station_footprint", f"WITH {EMISSIONS}, {OBS}, {FOOT}, {STATION_PARTS} SELECT source_id, cat, round(1e6 * v, 3) AS v FROM parts")
def x21(spark, sf):
    return station_parts(spark, sf).withColumn("v", r(1e6 * c("v"), 3))


@query("X23_single_plumes", f"WITH {EMISSIONS}, e AS (SELECT emitter, max(h) AS h, max(w) AS w, sum(rate) AS rate FROM emissions GROUP BY emitter), p AS (SELECT emitter, rate, (45 - h) * 100.0 AS x, (w - 20) * 50.0 AS y FROM e), g AS (SELECT *, power(0.16 * x * power(1 + 0.0004 * x, -0.5), 2) / 2 AS ry, power(0.14 * x * power(1 + 0.003 * x, -0.5), 2) / 2 AS rz FROM p WHERE x > 0) SELECT emitter, round(1e6 * rate * exp(-y * y / (4 * ry)) * (exp(-power(2 - 30.0, 2) / 4 / rz) + exp(-power(2 + 30.0, 2) / 4 / rz)) / (4 * pi() * sqrt(ry * rz)) / 3, 3) AS conc FROM g")
def x23(spark, sf):
    e = emissions(spark, sf).groupBy("emitter").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.sum("rate").alias("rate"))
    p = e.select("emitter", "rate", ((45 - c("h")) * 100.0).alias("x"), ((c("w") - 20) * 50.0).alias("y")).filter("x > 0")
    conc = c("rate") * physics.plume(c("x"), c("y"), lit(2.0), lit(30.0), lit(3.0), lit(1e7), lit(3))
    return p.select("emitter", r(1e6 * conc, 3).alias("conc"))


@query("X44_road_dust_emission", f"WITH {EMISSIONS} SELECT emitter, round(power(sum(rate) / 2 * 1.3, 0.6) * 0.8 * CASE WHEN max(month(day)) IN (11, 12, 1, 2, 3) THEN 1.5 ELSE 1 END, 5) AS dust FROM emissions GROUP BY emitter")
def x44(spark, sf):
    g = emissions(spark, sf).groupBy("emitter").agg(F.sum("rate").alias("v"), F.max(F.month("day")).alias("m"))
    return g.select("emitter", r(F.pow(c("v") / 2 * 1.3, lit(0.6)) * 0.8 * F.when(c("m").isin(11, 12, 1, 2, 3), 1.5).otherwise(1.0), 5).alias("dust"))


@query("X49_line_grid", f"WITH {CELLS}, l AS (SELECT size AS flow, h AS h0, w AS w0, h + size % 5 AS h1, w + (3 * size) % 7 - 3 AS w1 FROM cells), {LINE} SELECT h, w, round(sum(flow / n), 4) AS flow FROM line GROUP BY ALL")
def x49(spark, sf):
    """Flows of straight roads on the cells that they cross, by the share of the road in each."""
    g = grid_cells(spark, sf).select(c("size").alias("flow"), c("h").alias("h0"), c("w").alias("w0"), (c("h") + c("size") % 5).alias("h1"), (c("w") + (3 * c("size")) % 7 - 3).alias("w1"))
    return d.line_cells(g).groupBy("h", "w").agg(r(F.sum(c("flow") / c("n"))).alias("flow"))


@query("X51_short_roads_merge", f"WITH {CELLS}, road AS (SELECT p_partkey, h * 10 AS y, w * 10 AS x, (p_partkey // 7) % 3 AS tier, value % 100 AS dir, size FROM cells) SELECT a.p_partkey, min(b.p_partkey) AS into_road FROM road a JOIN road b ON a.size < 5 AND b.p_partkey <> a.p_partkey AND b.y BETWEEN a.y - 10 AND a.y + 10 AND b.x BETWEEN a.x - 10 AND a.x + 10 AND power(a.y - b.y, 2) + power(a.x - b.x, 2) <= 121 AND a.tier = b.tier AND abs(a.dir - b.dir) < 25 GROUP BY a.p_partkey")
def x51(spark, sf):
    """Short pieces of road go into the first other piece within 11 m of the same tier and nearly the same direction, found by cells of 11 m."""
    g = grid_cells(spark, sf)
    road = g.select("p_partkey", (c("h") * 10).alias("y"), (c("w") * 10).alias("x"), (F.floor(c("p_partkey") / 7) % 3).alias("tier"), (c("value") % 100).alias("dir"), "size")
    road = road.withColumns({"by": F.floor(c("y") / 11), "bx": F.floor(c("x") / 11)})
    other = road.select(c("p_partkey").alias("other"), c("y").alias("oy"), c("x").alias("ox"), "tier", c("dir").alias("od"), "by", "bx")
    asked = road.filter("size < 5").drop("size").select("*", F.explode(s.around(1)).alias("dy")).select("*", F.explode(s.around(1)).alias("dx"))
    asked = asked.withColumns({"by": c("by") + c("dy"), "bx": c("bx") + c("dx")})
    near = (F.pow(c("y") - c("oy"), 2) + F.pow(c("x") - c("ox"), 2) <= 121) & (F.abs(c("dir") - c("od")) < 25) & (c("p_partkey") != c("other"))
    return asked.join(other, ["by", "bx", "tier"]).filter(near).groupBy("p_partkey").agg(F.min("other").alias("into_road"))


@query("X56_background_grids", f"WITH {OBS} SELECT sys_hour, sid AS h, round(min(value), 4) AS background FROM obs GROUP BY ALL")
def x56(spark, sf):
    return observations(spark, sf).groupBy("sys_hour", c("sid").alias("h")).agg(r(F.min("value")).alias("background"))


@query("X57_archive_slices", f"WITH {HOURLY} SELECT var, sys_hour, count(*) AS n, round(avg(value), 7) AS mean FROM hourly WHERE sys_hour BETWEEN 473500 AND 473700 GROUP BY ALL")
def x57(spark, sf):
    return hourly(spark, sf).filter(c("sys_hour").between(473500, 473700)).groupBy("var", "sys_hour").agg(F.count(lit(1)).alias("n"), r(F.avg("value"), 7).alias("mean"))


@query("X60_rays", f"WITH {CELLS}, ray AS (SELECT h, w, (size * 37) % 360 + 0.01 AS dir, unnest(range(1, 6)) AS k FROM cells), z AS (SELECT h, w, h - CAST(round(k * cos(radians(dir))) AS BIGINT) AS uh, w + CAST(round(k * sin(radians(dir))) AS BIGINT) AS uw, h - CAST(round((k - 3) * cos(radians(dir + 90))) AS BIGINT) AS oh, w + CAST(round((k - 3) * sin(radians(dir + 90))) AS BIGINT) AS ow FROM ray) SELECT z.h, z.w, count(u.value) AS n, round(max(u.value), 4) AS tallest, round(min(o.value), 4) AS beside FROM z LEFT JOIN cells u ON u.h = uh AND u.w = uw LEFT JOIN cells o ON o.h = oh AND o.w = ow GROUP BY z.h, z.w")
def x60(spark, sf):
    """The five cells upwind of each cell by its own wind, and the least value of the five across it."""
    g = grid_cells(spark, sf).select("h", "w", "value", ((c("size") * 37) % 360 + 0.01).alias("dir"))
    ray = g.select("h", "w", "dir", F.explode(F.sequence(lit(1).cast("long"), lit(5).cast("long"))).alias("k"))
    step = lambda n, f, a: F.round(n * f(F.radians(a))).cast("long")
    up, beside = c("k"), c("k") - 3
    ray = ray.select("h", "w", (c("h") - step(up, F.cos, c("dir"))).alias("uh"), (c("w") + step(up, F.sin, c("dir"))).alias("uw"), (c("h") - step(beside, F.cos, c("dir") + 90)).alias("oh"), (c("w") + step(beside, F.sin, c("dir") + 90)).alias("ow"))
    at = lambda k, v: g.select(c("h").alias(f"{k}h"), c("w").alias(f"{k}w"), c("value").alias(v))
    hit = ray.join(at("u", "up"), ["uh", "uw"], "left").join(at("o", "beside"), ["oh", "ow"], "left")
    return hit.groupBy("h", "w").agg(F.count("up").alias("n"), r(F.max("up")).alias("tallest"), r(F.min("beside")).alias("beside"))


@query("K1_hourly_archive", f"WITH {HOURLY} SELECT var, source_id, sys_hour, round(value, 4) AS value FROM hourly")
def k1(spark, sf):
    """An archive by day and variable: written, its newest days written again in place, and read back."""
    rows = hourly(spark, sf).select("var", "source_id", "sys_hour", r(c("value")).alias("value"))
    path = f"{scratch_folder(spark)}/archive-{uuid.uuid4().hex}"
    sinks.archive(rows, path)
    last = rows.agg(F.max("sys_hour")).first()[0]
    sinks.archive(rows.filter(F.floor(c("sys_hour") / 24) == lit(last // 24)), path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("K3_grid_rows", f"WITH {CELLS} SELECT h, count(*) AS n, round(list_sum(list(value ORDER BY w)), 2) AS total FROM cells GROUP BY h")
def k3(spark, sf):
    g = grid_cells(spark, sf).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("w", "value"))).alias("a"))  # one row of a grid
    return g.select("h", F.size("a").cast("long").alias("n"), r(F.aggregate("a", lit(0.0), lambda x, y: x + y["value"]), 2).alias("total"))


@query("K5_forecast_statistics", f"WITH {HOURLY}, {FORECAST} SELECT var, count(*) AS n, round(avg(value) + {TIE}, 5) AS mean FROM forecast GROUP BY var")
def k5(spark, sf):
    filled = t.forecast_filled(hourly(spark, sf))
    return filled.groupBy("var").agg(F.count(lit(1)).alias("n"), r(F.avg("value") + TIE, 5).alias("mean"))


@query("U5_concatenate", f"WITH {OBS} SELECT maturity AS part, event_id, var, round(value, 4) AS value FROM obs WHERE maturity < 2")
def u5(spark, sf):
    """Delimited files of one layout, each with a header, as one table: written, then read together without the headers."""
    rows = observations(spark, sf).filter("maturity < 2").select(c("maturity").alias("part"), "event_id", "var", r(c("value")).alias("value"))
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    for part in (0, 1):
        rows.filter(c("part") == part).write.mode("append").option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("T2_range_cut", "SELECT p_partkey FROM part WHERE sqrt(power(p_partkey // 50 - 20, 2) + power(p_partkey % 50 - 25, 2)) <= 12")
def t2(spark, sf):
    return grid_cells(spark, sf).filter(F.sqrt(F.pow(c("h") - 20, 2) + F.pow(c("w") - 25, 2)) <= 12).select("p_partkey")


@query("T8_ring_order", f"WITH {CELLS} SELECT h, w, CAST(dense_rank() OVER (ORDER BY (h - 20) * (h - 20) + (w - 25) * (w - 25)) AS BIGINT) AS ring FROM cells WHERE abs(h - 20) <= 5 AND abs(w - 25) <= 5")
def t8(spark, sf):
    """Rings of a box of fixed size around a cell: ranks of its few distinct distances are joined back."""
    from pyspark.sql import Window

    box = grid_cells(spark, sf).filter("abs(h - 20) <= 5 and abs(w - 25) <= 5").select("h", "w", ((c("h") - 20) * (c("h") - 20) + (c("w") - 25) * (c("w") - 25)).alias("d2"))
    rings = box.select("d2").distinct().withColumn("ring", F.row_number().over(Window.orderBy("d2")).cast("long"))
    return box.join(rings, "d2").select("h", "w", "ring")


@query("T9_sorted_markers", f"WITH {OBS} SELECT sid, max(sec) AS newest FROM obs GROUP BY sid ORDER BY newest DESC")
def t9(spark, sf):
    return observations(spark, sf).groupBy("sid").agg(F.max("sec").alias("newest")).orderBy(F.desc("newest"))


@query("E4_summer_time", f"WITH {EMISSIONS} SELECT DISTINCT day, day >= last_sunday(3) AND day < last_sunday(10) AS summer FROM emissions".replace("last_sunday(3)", "(make_date(year(day), 3, 31) - CAST(dayofweek(make_date(year(day), 3, 31)) AS INTEGER))").replace("last_sunday(10)", "(make_date(year(day), 10, 31) - CAST(dayofweek(make_date(year(day), 10, 31)) AS INTEGER))"))
def e4(spark, sf):
    """European summer time: from the last Sunday of March to that of October."""
    days = emissions(spark, sf).select("day").distinct()
    last = lambda m: F.expr(f"date_sub(make_date(year(day), {m}, 31), dayofweek(make_date(year(day), {m}, 31)) - 1)")
    return days.select("day", ((c("day") >= last(3)) & (c("day") < last(10))).alias("summer"))


@query("G12_elementary", f"WITH {OBS} SELECT event_id, round(exp(-value / 100), 6) AS e, round(sin(value), 6) + 0.0 AS s, round(acos(least(1, value / 500)), 6) AS a FROM obs")
def g12(spark, sf):
    return observations(spark, sf).select("event_id", r(F.exp(-c("value") / 100), 6).alias("e"), (r(F.sin("value"), 6) + 0.0).alias("s"), r(F.acos(F.least(lit(1.0), c("value") / 500)), 6).alias("a"))


@query("X47_static_line_raster", f"WITH {EMISSIONS}, l AS (SELECT emitter, min(h) AS h0, max(h) AS h1, min(w) AS w0, max(w) + min(h) % 5 AS w1, CASE WHEN max(height_m) < 40 THEN 0 WHEN max(height_m) < 80 THEN 1 ELSE 2 END AS band, sum(rate) AS flow FROM emissions GROUP BY emitter), {LINE} SELECT band, h, w, round(sum(flow / n), 3) AS rate FROM line GROUP BY ALL")
def x47(spark, sf):
    """Static lines in space as cells of a grid by height band; a line's rate is shared by its cells."""
    e = emissions(spark, sf).groupBy("emitter").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("w").alias("w0"), (F.max("w") + F.min("h") % 5).alias("w1"), d.height_band(F.max("height_m")).alias("band"), F.sum("rate").alias("rate"))
    return d.line_cells(e).groupBy("band", "h", "w").agg(r(F.sum(c("rate") / c("n")), 3).alias("rate"))


@query("X19_footprint_table", f"WITH f AS (SELECT dh, dw, dh * 25.0 AS x, dw * 25.0 AS y FROM (SELECT unnest(range(1, 41)) AS dh), (SELECT unnest(range(-40, 41)) AS dw)), dense AS (SELECT 0 AS h, 0 AS w, 0 AS cat, 'N' AS pollutant, 5.0 AS height_m, 1.0 AS rate), {plume_sql('dense', 'f', '')} SELECT h AS dh, w AS dw, round(1e6 * conc, 4) AS weight FROM conc")
def x19(spark, sf):
    w = physics.plume(c("x"), c("y"), lit(2.0), lit(5.0), lit(3.0), lit(300.0), lit(3))
    return d.footprint(spark, 40, 25.0).select("dh", "dw", r(1e6 * w).alias("weight"))
