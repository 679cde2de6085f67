"""Layers of gridded feeds: which layer stands for an hour, which forecast run reaches it, and what lies between layers.

Choices are made on small tables (a row a layer or a file); cells are joined once, to the layers that were chosen.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.geo import DEGREE_M

#: Kilometres by which a box grows before grids are read, and the maturity of a layer that misses a cell.
WIDER_KM, AGED = 50.0, 100


def widened(box, km: float = WIDER_KM):
    """``(latmin, latmax, lonmin, lonmax)`` columns of a box grown by ``km`` on each side."""
    latmin, latmax, lonmin, lonmax = map(F.lit, box)
    dy = km * 1000 / DEGREE_M
    dx = dy / F.cos(F.radians((latmin + latmax) / 2))
    return latmin - dy, latmax + dy, lonmin - dx, lonmax + dx


def cell_place(head: str = ""):
    """(lat, lon) of a cell's centre by its header; row 0 is the north edge."""
    at = lambda c: F.col(f"{head}{c}")
    lat = at("latmax") - (F.col("h") + 0.5) * (at("latmax") - at("latmin")) / at("n_rows")
    return lat, at("lonmin") + (F.col("w") + 0.5) * (at("lonmax") - at("lonmin")) / at("n_columns")


def inside(box, lat: Column, lon: Column) -> Column:
    return (lat >= box[0]) & (lat <= box[1]) & (lon >= box[2]) & (lon <= box[3])


def meets(box) -> Column:
    """Headers whose bounds meet a box."""
    return (F.col("latmin") <= box[1]) & (F.col("latmax") >= box[0]) & (F.col("lonmin") <= box[3]) & (F.col("lonmax") >= box[2])


def reachable(headers: DataFrame, box) -> DataFrame:
    """Headers that meet the box widened by 50 km, and all headers of the variables of which none does; ``bounded`` tells which."""
    near = headers.withColumn("bounded", meets(widened(box)))
    found = near.filter("bounded").select(F.col("var").alias("_var")).distinct()
    return near.join(F.broadcast(found), F.col("var") == F.col("_var"), "left").filter("bounded or _var is null").drop("_var")  # a row a variable


def layers(headers: DataFrame, cells: DataFrame, box) -> DataFrame:
    """The layer of each variable and hour: ``headers`` with ``maturity``, chosen.

    ``headers(grid_id, var, run_hour, valid_hour, latmin, latmax, lonmin, lonmax, n_rows, n_columns, scale, offset)``, ``cells(grid_id, h, w, value)``. A
    layer's maturity is its forecast lead; one that misses a cell ages to 100. The least mature wins, of equal ones the older run.
    """
    near = reachable(headers, box)
    holes = cells.filter("value is null or isnan(value)").select(F.col("grid_id").alias("_hole")).distinct()
    aged = near.join(holes, F.col("grid_id") == F.col("_hole"), "left")
    rated = aged.withColumn("maturity", F.when(F.col("_hole").isNotNull(), AGED).otherwise(F.col("valid_hour") - F.col("run_hour"))).drop("_hole")
    own = F.struct(*[c for c in rated.columns if c not in ("var", "valid_hour")])
    best = rated.groupBy("var", "valid_hour").agg(F.min_by(own, F.struct("maturity", "run_hour", "grid_id")).alias("l"))
    return best.select("var", "valid_hour", "l.*")


def layered_cells(chosen: DataFrame, cells: DataFrame, box) -> DataFrame:
    """``(var, valid_hour, grid_id, h, w, lat, lon, value, maturity)`` of the chosen layers: values by scale and offset, missing ones 0, those
    outside the widened box left out (unless the variable had none inside)."""
    lat, lon = cell_place()
    rows = cells.join(chosen, "grid_id").withColumns({"lat": lat, "lon": lon}).filter(~F.col("bounded") | inside(widened(box), F.col("lat"), F.col("lon")))
    value = F.when(F.col("value").isNull() | F.isnan("value"), 0.0).otherwise(F.col("value") * F.col("scale") + F.col("offset"))
    return rows.select("var", "valid_hour", "grid_id", "h", "w", "lat", "lon", value.alias("value"), "maturity")


def between(chosen: DataFrame) -> DataFrame:
    """``(var, valid_hour, before, after, share)`` of the hours between two layers of a variable that no layer has; ``share`` is the later layer's weight."""
    w = Window.partitionBy("var").orderBy("valid_hour")
    pairs = chosen.select("var", F.col("valid_hour").alias("a"), F.col("grid_id").alias("before"), F.lead("valid_hour").over(w).alias("b"), F.lead("grid_id").over(w).alias("after"))
    hours = pairs.filter("b > a + 1").select("*", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("valid_hour"))
    return hours.select("var", "valid_hour", "before", "after", ((F.col("valid_hour") - F.col("a")) / (F.col("b") - F.col("a"))).alias("share"))


def hourly_cells(chosen: DataFrame, cells: DataFrame, box) -> DataFrame:
    """The chosen layers' cells and, for hours between layers, cells that both neighbours have; ``filled`` tells them apart."""
    own = layered_cells(chosen, cells, box)
    at = lambda k: own.select(F.col("grid_id").alias(k), "h", "w", F.col("value").alias(f"{k}_value"))
    made = between(chosen).join(at("before"), "before").join(at("after"), ["after", "h", "w"])
    value = F.col("before_value") * (1 - F.col("share")) + F.col("after_value") * F.col("share")
    filled = made.select("var", "valid_hour", "h", "w", value.alias("value"), F.lit(True).alias("filled"))
    return own.select("var", "valid_hour", "h", "w", "value", F.lit(False).alias("filled")).unionByName(filled)


def newest_runs(files: DataFrame, first: int, last: int) -> DataFrame:
    """``(source, hour, run_hour, chunk, lead)``: for each hour of the span the newest run of ``files(source, run_hour, chunk, hours)`` that reaches it.

    A file holds ``hours`` hours of a run from ``chunk`` times as many after its start."""
    each = files.select("source", "run_hour", "chunk", F.explode(F.transform(F.sequence(F.lit(0), F.col("hours") - 1), lambda k: F.col("run_hour") + F.col("chunk") * F.col("hours") + k)).alias("hour"))
    best = each.filter(F.col("hour").between(first, last)).groupBy("source", "hour").agg(F.max(F.struct("run_hour", "chunk")).alias("b"))
    return best.select("source", "hour", "b.run_hour", "b.chunk", (F.col("hour") - F.col("b.run_hour")).alias("lead"))


def uncovered(chosen: DataFrame, first: int, last: int) -> DataFrame:
    """``(source, from_hour, to_hour)``: ranges of the span's hours that no run of a source reaches."""
    ends = chosen.select("source", "hour").union(chosen.select("source").distinct().select("source", F.explode(F.array(F.lit(first - 1).cast("long"), F.lit(last + 1).cast("long"))).alias("hour")))
    nxt = ends.select("source", "hour", F.lead("hour").over(Window.partitionBy("source").orderBy("hour")).alias("next"))
    return nxt.filter("next > hour + 1").select("source", (F.col("hour") + 1).alias("from_hour"), (F.col("next") - 1).alias("to_hour"))


def missing_chunks(files: DataFrame, reach: int = 48) -> DataFrame:
    """``(source, run_hour, chunk)``: the chunks up to ``reach`` hours that a run lacks."""
    runs = files.select("source", "run_hour", "hours").distinct()
    want = runs.select("source", "run_hour", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((reach - 1) / F.col("hours")))).alias("chunk"))
    return want.join(files.select("source", "run_hour", "chunk"), ["source", "run_hour", "chunk"], "left_anti")


def superseded(files: DataFrame) -> DataFrame:
    """Runs of 06 and 18 hours that may be deleted: those of days of which the run of 00 hours and that of the next day are there."""
    runs = files.select("source", "run_hour").distinct()
    days = runs.filter("run_hour % 24 = 0").select("source", (F.col("run_hour") / 24).cast("long").alias("day"))
    kept = days.join(days.select("source", (F.col("day") - 1).alias("day")), ["source", "day"])
    return runs.filter("run_hour % 24 in (6, 18)").withColumn("day", F.floor(F.col("run_hour") / 24)).join(kept, ["source", "day"], "left_semi").select("source", "run_hour")


def point_lists(lists: DataFrame, box, fill: float) -> DataFrame:
    """``(list_id, i, hour, lat, lon, value)`` of ``lists(list_id, hours, lats, lons, values, scale, offset)``: parallel arrays zipped by index; fill values and points
    outside the box go before anything is exploded, and so do entries beyond the shortest array."""
    n = F.least(*[F.size(c) for c in ("hours", "lats", "lons", "values")])
    cut = [F.slice(c, 1, n).alias(k) for c, k in (("hours", "hour"), ("lats", "lat"), ("lons", "lon"), ("values", "value"))]
    points = F.transform(F.arrays_zip(*cut), lambda p, i: F.struct(i.alias("i"), p["hour"].alias("hour"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["value"].alias("value")))
    good = F.filter(points, lambda p: p["value"].isNotNull() & ~F.isnan(p["value"]) & (p["value"] != fill) & inside(box, p["lat"], p["lon"]))
    rows = lists.select("list_id", "scale", "offset", F.explode(good).alias("p"))
    return rows.select("list_id", "p.i", "p.hour", "p.lat", "p.lon", (F.col("p.value") * F.col("scale") + F.col("offset")).alias("value"))
