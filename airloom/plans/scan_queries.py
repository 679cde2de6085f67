"""Queries on layered grids, forecast runs, point lists and numbered lines."""

from pyspark.sql import functions as F

from airloom.operators import spatial
from airloom.sources import files, layers, sinks
from airloom.sources.adapters import OBS, observations, table

from .base import TIE, query
from .source_queries import folder

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x, n)
BOX = (60.0, 60.4, 24.0, 24.6)
WIDE = "60.0 - 50000 / m AS b0, 60.4 + 50000 / m AS b1, 24.0 - 50000 / m / cos(radians(60.2)) AS b2, 24.6 + 50000 / m / cos(radians(60.2)) AS b3 FROM (SELECT CAST(6371000.0 AS DOUBLE) * 2 * pi() / 360 AS m)"
#: Orders as layers of three variables, of which the third lies far off; their lines as cells, every eleventh part missing.
LAYERS = f"""heads AS (SELECT o_orderkey AS grid_id, 'V' || CAST(o_orderkey % 3 AS VARCHAR) AS var, o_orderkey // 3 % 400 * 2 AS valid_hour, o_orderkey // 3 % 400 * 2 - o_custkey % 48 AS run_hour,
  CASE WHEN o_orderkey % 3 = 2 THEN 67.0 ELSE 59.4 + CAST(0.3 AS DOUBLE) * (o_custkey % 4) END AS latmin, 24.0 + CAST(0.1 AS DOUBLE) * (o_custkey % 5) AS lonmin FROM orders),
boxed AS (SELECT *, latmin + 0.6 AS latmax, lonmin + 0.8 AS lonmax FROM heads),
cells AS (SELECT l_orderkey AS grid_id, (l_linenumber - 1) // 4 AS h, (l_linenumber - 1) % 4 AS w, max(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END) AS value, bool_or(l_partkey % 11 = 0) AS hole FROM lineitem GROUP BY ALL),
wide AS (SELECT {WIDE}),
near AS (SELECT boxed.*, latmin <= b1 AND latmax >= b0 AND lonmin <= b3 AND lonmax >= b2 AS bounded FROM boxed, wide),
reach AS (SELECT * FROM near WHERE bounded OR var NOT IN (SELECT var FROM near WHERE bounded)),
rated AS (SELECT *, CASE WHEN grid_id IN (SELECT grid_id FROM cells WHERE hole) THEN 100 ELSE valid_hour - run_hour END AS maturity FROM reach),
chosen AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY var, valid_hour ORDER BY maturity, run_hour, grid_id) = 1),
own AS (SELECT var, valid_hour, grid_id, h, w, CASE WHEN hole THEN 0 ELSE value * 2 + 1 END AS value, maturity, latmax - (h + 0.5) * (latmax - latmin) / 2 AS lat, lonmin + (w + 0.5) * (lonmax - lonmin) / 4 AS lon, bounded FROM chosen JOIN cells USING (grid_id)),
kept AS (SELECT own.* FROM own, wide WHERE NOT bounded OR (lat BETWEEN b0 AND b1 AND lon BETWEEN b2 AND b3))"""


def tables(spark, sf):
    k, u = c("o_orderkey"), c("o_custkey")
    heads = table(spark, sf, "orders").select(
        k.alias("grid_id"), F.concat(lit("V"), (k % 3).cast("string")).alias("var"), (F.floor(k / 3) % 400 * 2).alias("valid_hour"), (F.floor(k / 3) % 400 * 2 - u % 48).alias("run_hour"),
        F.when(k % 3 == 2, 67.0).otherwise(59.4 + 0.3 * (u % 4)).alias("latmin"), (24.0 + 0.1 * (u % 5)).alias("lonmin"), lit(2).alias("n_rows"), lit(4).alias("n_columns"), lit(2.0).alias("scale"), lit(1.0).alias("offset"),
    )
    heads = heads.withColumns({"latmax": c("latmin") + 0.6, "lonmax": c("lonmin") + 0.8})
    line, hole = c("l_linenumber").cast("long") - 1, c("l_partkey") % 11 == 0
    lines = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("grid_id"), F.floor(line / 4).alias("h"), (line % 4).alias("w"))
    return heads, lines.agg(F.max("l_quantity").alias("q"), F.max(hole).alias("hole")).select("grid_id", "h", "w", F.when(~c("hole"), c("q")).alias("value"))


@query("S8_layered_cells", f"WITH {LAYERS} SELECT var, valid_hour, grid_id, h, w, round(lat + {TIE}, 5) AS lat, round(lon + {TIE}, 5) AS lon, round(value, 4) AS value, maturity FROM kept")
def s8_layers(spark, sf):
    """Of all layers that an hour has, the least mature whole one, cut by the box widened by 50 km; a variable with nothing there is read everywhere."""
    heads, cells = tables(spark, sf)
    rows = layers.layered_cells(layers.layers(heads, cells, BOX), cells, BOX)
    return rows.select("var", "valid_hour", "grid_id", "h", "w", r(c("lat") + TIE, 5).alias("lat"), r(c("lon") + TIE, 5).alias("lon"), r(c("value")).alias("value"), "maturity")


HOURS = """pairs AS (SELECT var, valid_hour AS a, grid_id AS before, lead(valid_hour) OVER w AS b, lead(grid_id) OVER w AS after FROM chosen WINDOW w AS (PARTITION BY var ORDER BY valid_hour)),
gaps AS (SELECT *, unnest(range(a + 1, b)) AS valid_hour FROM pairs WHERE b > a + 1),
made AS (SELECT g.var, g.valid_hour, x.h, x.w, x.value * (1 - (g.valid_hour - a) / (b - a)) + y.value * ((g.valid_hour - a) / (b - a)) AS value, true AS filled FROM gaps g JOIN kept x ON x.grid_id = before JOIN kept y ON y.grid_id = after AND y.h = x.h AND y.w = x.w),
hours AS (SELECT var, valid_hour, h, w, value, false AS filled FROM kept UNION ALL SELECT * FROM made)"""


@query("S11_hourly_layers", f"WITH {LAYERS}, {HOURS} SELECT var, valid_hour, h, w, round(value + {TIE}, 4) AS value, filled FROM hours")
def s11(spark, sf):
    heads, cells = tables(spark, sf)
    return layers.hourly_cells(layers.layers(heads, cells, BOX), cells, BOX).withColumn("value", r(c("value") + TIE))


@query("X56_regional_fields", f"""WITH {LAYERS}, {HOURS}, k AS (SELECT unnest([0, 1]) AS i), f AS (SELECT var, valid_hour, h, w, k.i, l.i AS j FROM hours, k, k l),
p AS (SELECT f.var, f.valid_hour, f.h * 2 + i AS fh, f.w * 2 + j AS fw, b.value, greatest(0.0625, power(f.h + (i + 0.5) / 2 - 0.5 - b.h, 2) + power(f.w + (j + 0.5) / 2 - 0.5 - b.w, 2)) AS d2 FROM f JOIN hours b ON b.var = f.var AND b.valid_hour = f.valid_hour AND b.h BETWEEN f.h - 1 AND f.h + 1 AND b.w BETWEEN f.w - 1 AND f.w + 1)
SELECT var, valid_hour, fh, fw, round(sum(value / d2) / sum(1 / d2) + {TIE}, 3) AS background FROM p GROUP BY var, valid_hour, fh, fw""")
def x56_fields(spark, sf):
    """The regional model's field of each variable and hour, layers and what lies between them, on cells of half the size, for the archive."""
    heads, cells = tables(spark, sf)
    by = ("var", "valid_hour")
    fields = layers.hourly_cells(layers.layers(heads, cells, BOX), cells, BOX)
    return spatial.refined(fields.select(*by, "h", "w", "value"), 2, by, 8).select(*by, "fh", "fw", r(c("value") + TIE, 3).alias("background"))


@query("K3_grid_series", f"WITH {LAYERS}, {HOURS}, g AS (SELECT var, valid_hour, h, min(w) AS w0, max(w) AS w1, map_from_entries(list((w, value))) AS m FROM hours GROUP BY ALL) SELECT var, valid_hour, h, w0, list_transform(range(w0, w1 + 1), lambda x: round(m[x] + {TIE}, 3)) AS values FROM g")
def k3_series(spark, sf):
    """Each variable's fields as rows of arrays by time, as exchange formats hold them."""
    heads, cells = tables(spark, sf)
    rows = sinks.grid_series(layers.hourly_cells(layers.layers(heads, cells, BOX), cells, BOX), ("var", "valid_hour"))
    return rows.withColumn("values", F.transform("values", lambda x: r(x + TIE, 3)))


#: Orders as files of three sources: 60 days, four runs a day, eight chunks of six hours.
RUNS = "files AS (SELECT 'H' || CAST(o_custkey % 3 AS VARCHAR) AS source, o_orderkey // 32 % 60 * 24 + o_orderkey % 4 * 6 AS run_hour, o_orderkey // 4 % 8 AS chunk FROM orders GROUP BY ALL)"
FIRST, LAST = 120, 1000


def run_files(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select(F.concat(lit("H"), (c("o_custkey") % 3).cast("string")).alias("source"), (F.floor(k / 32) % 60 * 24 + k % 4 * 6).alias("run_hour"), (F.floor(k / 4) % 8).alias("chunk"), lit(6).alias("hours")).distinct()


CHOSEN = f"{RUNS}, each AS (SELECT source, run_hour, chunk, run_hour + chunk * 6 + unnest(range(0, 6)) AS hour FROM files), runs AS (SELECT * FROM each WHERE hour BETWEEN {FIRST} AND {LAST} QUALIFY row_number() OVER (PARTITION BY source, hour ORDER BY run_hour DESC, chunk DESC) = 1)"


@query("S14_forecast_runs", f"WITH {CHOSEN} SELECT source, hour, run_hour, chunk, hour - run_hour AS lead FROM runs")
def s14(spark, sf):
    return layers.newest_runs(run_files(spark, sf), FIRST, LAST)


@query("S14_missing_chunks", f"""WITH {CHOSEN}, gap AS (SELECT source, hour FROM (SELECT DISTINCT source FROM runs), (SELECT unnest(range({FIRST}, {LAST} + 1)) AS hour) EXCEPT SELECT source, hour FROM runs),
isle AS (SELECT source, hour, hour - row_number() OVER (PARTITION BY source ORDER BY hour) AS isle FROM gap)
SELECT 'hours' AS kind, source, min(hour) AS from_hour, max(hour) AS to_hour FROM isle GROUP BY source, isle
UNION ALL SELECT 'chunk', source, run_hour + chunk * 6, run_hour + chunk * 6 + 5 FROM (SELECT DISTINCT source, run_hour, unnest(range(0, 8)) AS chunk FROM files EXCEPT SELECT source, run_hour, chunk FROM files)""")
def s14_missing(spark, sf):
    """Hours that no run reaches, as ranges, and the chunks of 48 hours that runs lack."""
    found = run_files(spark, sf)
    gaps = layers.uncovered(layers.newest_runs(found, FIRST, LAST), FIRST, LAST).select(lit("hours").alias("kind"), "source", "from_hour", "to_hour")
    start = c("run_hour") + c("chunk") * 6
    return gaps.union(layers.missing_chunks(found).select(lit("chunk"), "source", start, start + 5))


@query("S15_superseded_runs", f"WITH {RUNS}, days AS (SELECT DISTINCT source, run_hour // 24 AS day FROM files WHERE run_hour % 24 = 0), kept AS (SELECT a.* FROM days a JOIN days b ON b.source = a.source AND b.day = a.day + 1) SELECT DISTINCT source, run_hour FROM files f WHERE run_hour % 24 IN (6, 18) AND EXISTS (SELECT 1 FROM kept WHERE kept.source = f.source AND kept.day = f.run_hour // 24)")
def s15(spark, sf):
    return layers.superseded(run_files(spark, sf))


@query("S9_point_lists", "SELECT l_suppkey % 40 AS list_id, l_orderkey AS hour, round(60 + l_partkey % 50 / CAST(50 AS DOUBLE), 4) AS lat, round(24 + l_linenumber / CAST(8 AS DOUBLE), 4) AS lon, round(l_quantity * 0.5 + 3, 4) AS value FROM lineitem WHERE l_quantity <> 7 AND 60 + l_partkey % 50 / CAST(50 AS DOUBLE) BETWEEN 60.0 AND 60.5 AND l_linenumber BETWEEN 1 AND 4")
def s9(spark, sf):
    """Files of parallel arrays, a row each of at most a few hundred points, with a fill value."""
    line = table(spark, sf, "lineitem").select((c("l_suppkey") % 40).alias("list_id"), "l_orderkey", (60 + c("l_partkey") % 50 / 50).alias("lat"), (24 + c("l_linenumber") / 8).alias("lon"), "l_quantity")
    lists = line.groupBy("list_id", F.floor(c("l_orderkey") / 1000).alias("part")).agg(F.collect_list(F.struct("l_orderkey", "lat", "lon", "l_quantity")).alias("p"))
    array = lambda k, name: F.transform("p", lambda x: x[k]).alias(name)
    lists = lists.select("list_id", array("l_orderkey", "hours"), array("lat", "lats"), array("lon", "lons"), array("l_quantity", "values"), lit(0.5).alias("scale"), lit(3.0).alias("offset"))
    rows = layers.point_lists(lists, (60.0, 60.5, 24.0, 24.5), 7.0)
    return rows.select("list_id", "hour", r(c("lat")).alias("lat"), r(c("lon")).alias("lon"), r(c("value")).alias("value"))


@query("S16_road_weather", f"""WITH {OBS}, lines AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY event_id) AS line, count(*) OVER (PARTITION BY var) AS n FROM obs),
kept AS (SELECT * FROM lines WHERE (n <= 190 OR line % 4 = 0) AND lat BETWEEN 60.11 AND 60.17)
SELECT var, line - 1 AS line, source_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, name, round(CASE name WHEN 'road' THEN value ELSE value / 2 END, 4) AS value FROM kept, (SELECT unnest(['road', 'air']) AS name)""")
def s16(spark, sf):
    """A file of road-station lines for each variable, in order; long files are thinned by true line numbers."""
    o = observations(spark, sf)
    line = F.concat_ws(";", "source_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), c("lat").cast("string"), c("lon").cast("string"), F.concat(lit("road="), c("value").cast("string"), lit(",air="), (c("value") / 2).cast("string")))
    path = folder(spark, "roads")
    o.select("var", "event_id", line.alias("value")).repartition("var").sortWithinPartitions("var", "event_id").select("var", "value").write.partitionBy("var").text(path)
    rows = files.road_weather(spark, f"{path}/*/*.txt", (60.11, 60.17, 24.0, 25.0), 190)
    names = files.numbered_lines(spark, f"{path}/*/*.txt").select("file", F.regexp_extract("path", "var=([^/]+)", 1).alias("var")).distinct()
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return rows.join(F.broadcast(names), "file").select("var", "line", "source_id", sec.alias("sec"), "name", r(c("value")).alias("value"))  # a row a file
