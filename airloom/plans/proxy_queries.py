"""Queries on recipes of secondary variables and the slice archive."""

from pyspark.sql import functions as F

from airloom.operators import proxies
from airloom.sources import ledger
from airloom.sources.adapters import CELLS, grid_cells

from .base import TIE, query
from .fusion_queries import COMPONENTS, components
from .quality_queries import HOURLY, hourly
from .source_queries import folder

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x + TIE, n) + 0.0
RECIPES = ["# three levels, and a variable that some sources measure", "total = AFFINE<1*fine+1*coarse-0.1*error>,error_MIN<5>", "coarse = AFFINE<1.4*click+0.5*fine>,click_MAX<100>", "fine = AFFINE<0.6*view+0.2*signup>", "purchase = AFFINE<2*view>"]
FINE, COARSE, TOTAL = "0.6 * view + 0.2 * signup", "1.4 * CASE WHEN click > 100 THEN 100 ELSE click END + 0.5 * fine", "fine + coarse - 0.1 * CASE WHEN error < 5 THEN 5 ELSE error END"
PIVOT = ", ".join(f"max(CASE WHEN var = '{v}' THEN value END) AS {v}" for v in ("view", "click", "signup", "error", "purchase"))


@query("X40_recipe_graph", f"""WITH {HOURLY}, rows AS (SELECT * FROM hourly WHERE var <> 'purchase' OR source_id <= 'S2'), wide AS (SELECT source_id, sys_hour, {PIVOT} FROM rows GROUP BY ALL),
one AS (SELECT *, {FINE} AS fine FROM wide), two AS (SELECT *, {COARSE} AS coarse FROM one), three AS (SELECT *, {TOTAL} AS total FROM two)
SELECT source_id, sys_hour, var, round(value + {TIE}, 4) + 0.0 AS value FROM (SELECT source_id, sys_hour, unnest(['fine', 'coarse', 'total', 'purchase']) AS var, unnest([fine, coarse, total, CASE WHEN source_id <= 'S2' THEN purchase ELSE 2 * view END]) AS value FROM three) WHERE value IS NOT NULL""")
def x40_graph(spark, sf):
    rows = hourly(spark, sf).filter("var <> 'purchase' or source_id <= 'S2'")
    return proxies.station_proxies(rows, proxies.parsed(RECIPES)).withColumn("value", r(c("value")))


@query("X40_grid_proxies", f"""WITH {CELLS}, wide AS (SELECT a.h, a.w, a.value / 10 AS view, b.value / 20 AS click, CASE WHEN a.size % 3 > 0 THEN a.size * 1.0 END AS signup, 3.0 AS error FROM cells a LEFT JOIN cells b ON b.h = a.h // 2 AND b.w = a.w // 2),
one AS (SELECT *, {FINE} AS fine FROM wide), two AS (SELECT *, {COARSE} AS coarse FROM one) SELECT h, w, round(fine + {TIE}, 4) + 0.0 AS fine, round(coarse + {TIE}, 4) + 0.0 AS coarse, round({TOTAL} + {TIE}, 4) + 0.0 AS total FROM two""")
def x40_grid(spark, sf):
    """Grids of one area: one of them coarse, one with gaps."""
    g = grid_cells(spark, sf)
    near = g.select("h", "w", F.floor(c("h") / 2).alias("bh"), F.floor(c("w") / 2).alias("bw")).join(g.select(c("h").alias("bh"), c("w").alias("bw"), "value"), ["bh", "bw"])
    cells = lambda value: g.select("h", "w", value.alias("value"))
    grids = {"view": cells(c("value") / 10), "click": near.select("h", "w", (c("value") / 20).alias("value")), "signup": g.filter("size % 3 > 0").select("h", "w", c("size").cast("double").alias("value")), "error": cells(lit(3.0))}
    found = proxies.grid_proxies(grids, proxies.parsed(RECIPES[1:4]))
    return found.select("h", "w", *[r(c(v)).alias(v) for v in ("fine", "coarse", "total")])


@query("X40_component_proxies", f"""WITH {COMPONENTS}, wide AS (SELECT v.source_id, v.sys_hour, unnest([0, 1, 2, 3]) AS part, unnest([v.p0, v.p1, v.p2, v.p3]) AS view, unnest([k.p0, k.p1, k.p2, k.p3]) AS click FROM comp v JOIN comp k ON k.source_id = v.source_id AND k.sys_hour = v.sys_hour AND k.var = 'click' WHERE v.var = 'view')
SELECT source_id, sys_hour, part, round(0.6 * view + {TIE}, 4) AS fine, round(1.4 * click + 0.5 * (0.6 * view) + {TIE}, 4) AS coarse FROM wide""")
def x40_components(spark, sf):
    """A recipe for each source's part of a value: the parts add up as the values do."""
    rows = components(spark, sf).select("var", "source_id", "sys_hour", "parts")
    wide = rows.filter("var = 'view'").select("source_id", "sys_hour", c("parts").alias("view")).join(rows.filter("var = 'click'").select("source_id", "sys_hour", c("parts").alias("click")), ["source_id", "sys_hour"])
    made = proxies.component_proxies(wide, proxies.parsed(["coarse = AFFINE<1.4*click+0.5*fine>", "fine = AFFINE<0.6*view>"]), 4)
    return made.select("source_id", "sys_hour", F.posexplode(F.arrays_zip("fine", "coarse")).alias("part", "z")).select("source_id", "sys_hour", "part", r(c("z.fine")).alias("fine"), r(c("z.coarse")).alias("coarse"))


@query("K2_slice_ledger", f"WITH {HOURLY} SELECT var AS slice, source_id, sys_hour, round(CASE var WHEN 'click' THEN 2 * value ELSE value END, 4) AS value, CASE var WHEN 'click' THEN 'again' END AS note FROM hourly")
def k2(spark, sf):
    """Variables as slices written at once; one is written again with one column more, and one write stops before its ledger line."""
    rows = hourly(spark, sf).select("var", "source_id", "sys_hour", "value")
    names = [x["var"] for x in rows.select("var").distinct().collect()]  # names of variables
    path = folder(spark, "ledger")
    part = lambda v: rows.filter(c("var") == v).drop("var")
    ledger.write_slices({v: part(v) for v in names}, path)
    again = part("click").select("source_id", "sys_hour", (c("value") * 2).alias("value"), lit("again").alias("note"))
    ledger.write_slices({"click": again}, path)
    part("view").write.parquet(f"{path}/slices/0")
    return ledger.read_slices(spark, path).select("slice", "source_id", "sys_hour", F.round("value", 4).alias("value"), "note")
