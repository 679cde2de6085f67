"""Queries on map objects and terrain: rings of relations, areas and buildings, roughness and shade by direction."""

from pyspark.sql import functions as F

from airloom.functions import landuse
from airloom.operators import geometry as g
from airloom.operators import terrain
from airloom.sources import map_tables as m
from airloom.sources.adapters import CELLS, grid_cells
from airloom.sources.map_tables import MAP_SQL, picked_sql

from .base import TIE, query

c, lit = F.col, F.lit
D = "CAST(6371000.0 AS DOUBLE) * 2 * pi() / 360"
STEPS = "SELECT way_id, pos, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, first_value(lat) OVER w AS low, first_value(lon) OVER w AS lon0 FROM points WINDOW w AS (PARTITION BY way_id ORDER BY pos)"
DIST = "sqrt(power(lat - {lat2}, 2) + power(cos(radians({lat2})) * (lon - {lon2}), 2))"
#: Walks: closed ones from each ring's smallest way, open ones from each loose end.
RINGS = f"""WITH RECURSIVE {MAP_SQL}, steps AS ({STEPS}),
measures AS (SELECT way_id, sum((lon2 - lon) * (lat + lat2) / 2) AS strip, sum({DIST.format(lat2='lat2', lon2='lon2')}) * {D} AS length_m, min(low) AS low FROM steps WHERE lat2 IS NOT NULL GROUP BY way_id),
open AS (SELECT relation_id, role, way_id, nodes[1] AS a, nodes[-1] AS b FROM members JOIN ways USING (way_id)),
loose AS (SELECT relation_id, role, node FROM (SELECT relation_id, role, unnest([a, b]) AS node FROM open WHERE a <> b) GROUP BY ALL HAVING count(*) = 1),
walk AS (SELECT relation_id, role, way_id AS start, a AS origin, b AS node, way_id, [way_id] AS path, [1] AS signs FROM open
 UNION ALL SELECT o.relation_id, o.role, w.start, w.origin, CASE WHEN o.a = w.node THEN o.b ELSE o.a END, o.way_id, list_append(w.path, o.way_id), list_append(w.signs, CASE WHEN o.a = w.node THEN 1 ELSE -1 END)
 FROM walk w JOIN open o ON o.relation_id = w.relation_id AND o.role = w.role AND (o.a = w.node OR o.b = w.node) AND o.way_id > w.start WHERE w.node <> w.origin AND o.way_id <> w.way_id),
trail AS (SELECT relation_id, role, o.way_id, CASE WHEN o.a = node THEN o.b ELSE o.a END AS node, [o.way_id] AS path, [CASE WHEN o.a = node THEN 1 ELSE -1 END] AS signs FROM loose JOIN open o USING (relation_id, role) WHERE o.a = node OR o.b = node
 UNION ALL SELECT o.relation_id, o.role, o.way_id, CASE WHEN o.a = t.node THEN o.b ELSE o.a END, list_append(t.path, o.way_id), list_append(t.signs, CASE WHEN o.a = t.node THEN 1 ELSE -1 END)
 FROM trail t JOIN open o ON o.relation_id = t.relation_id AND o.role = t.role AND (o.a = t.node OR o.b = t.node) AND o.way_id <> t.way_id),
chains AS (SELECT relation_id, role, start AS ring, path, signs, true AS closed FROM walk WHERE node = origin
 UNION ALL SELECT relation_id, role, list_min(path), list_sort(path), NULL, false FROM trail SEMI JOIN loose USING (relation_id, role, node) GROUP BY ALL),
each AS (SELECT relation_id, role, ring, closed, unnest(path) AS way_id, CASE WHEN closed THEN unnest(signs) END AS sign FROM chains),
lost AS (SELECT relation_id, role, count(*) FILTER (ways.way_id IS NULL OR nodes.node_id IS NULL) AS n_lost FROM members LEFT JOIN ways USING (way_id) LEFT JOIN nodes ON node_id = members.next_way * 10 GROUP BY ALL),
rings AS (SELECT relation_id, role, ring, closed, count(*) AS n_ways, any_value(n_lost) AS n_lost, CASE WHEN closed THEN abs(sum(sign * strip)) * power({D}, 2) * cos(radians(min(low))) END AS area_m2, sum(length_m) AS length_m
 FROM each JOIN measures USING (way_id) JOIN lost USING (relation_id, role) GROUP BY relation_id, role, ring, closed)"""


def rings(spark, sf):
    return g.relation_rings(m.relations(spark, sf), g.measured(m.ways(spark, sf), m.nodes(spark, sf), m.stops(spark, sf)))


@query("X50_relation_rings", f"{RINGS} SELECT relation_id, role, ring, n_ways, n_lost, closed, round(area_m2 + {TIE}) AS area_m2, round(length_m + {TIE}, 2) AS length_m FROM rings")
def x50_rings(spark, sf):
    return rings(spark, sf).select("relation_id", "role", "ring", "n_ways", "n_lost", "closed", F.round(c("area_m2") + TIE).alias("area_m2"), F.round(c("length_m") + TIE, 2).alias("length_m"))


@query("X50_multipolygons", f"""{RINGS} SELECT relation_id, count(*) FILTER (closed AND role = 'outer') AS n_outer, count(*) FILTER (closed AND role = 'inner') AS n_inner, count(*) FILTER (NOT closed) AS n_open, bool_and(closed AND n_lost = 0) AND count(*) FILTER (role = 'outer') > 0 AS whole,
 round(coalesce(sum(area_m2) FILTER (role = 'outer'), 0) - coalesce(sum(area_m2) FILTER (role = 'inner'), 0) + {TIE}) AS area_m2 FROM rings GROUP BY relation_id""")
def x50_multipolygons(spark, sf):
    """Relations as polygons: outer without inner area; whole ones miss no way and have only closed rings."""
    outer, area = c("role") == "outer", F.coalesce("area_m2", lit(0.0))
    found = rings(spark, sf).groupBy("relation_id").agg(
        F.count_if(c("closed") & outer).alias("n_outer"), F.count_if(c("closed") & ~outer).alias("n_inner"), F.count_if(~c("closed")).alias("n_open"), F.every(c("closed") & (c("n_lost") == 0)).alias("ok"), F.count_if(outer).alias("outers"), F.sum(F.when(outer, area).otherwise(-area)).alias("a")
    )
    return found.select("relation_id", "n_outer", "n_inner", "n_open", (c("ok") & (c("outers") > 0)).alias("whole"), F.round(c("a") + TIE).alias("area_m2"))


EXTRA = f"{picked_sql([k for k, _ in m.EXTRAS])} AS extra, {picked_sql([v for _, v in m.EXTRAS])} AS extra_value"
MAIN = " ".join(f"WHEN '{p}' THEN {picked_sql(v)}" for p, (_, v) in m.KINDS.items())
KEY = " ".join(f"WHEN '{p}' THEN '{k}'" for p, (k, _) in m.KINDS.items())
BUILDING = " ".join(f"WHEN {{0}} IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in landuse.BUILDINGS.items())
ZONE = " ".join(f"WHEN '{z}' THEN '{k}'" for z, k in landuse.BY_ZONE.items())


def spec_sql(pick):
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {pick(*v)}" for k, v in landuse.SPECS.items()) + f" ELSE {pick(*landuse.OTHER_SPECS)} END"


FLOORS = spec_sql(lambda s, n, most: f"CASE WHEN area > {s[0]} THEN {n[0]} WHEN area > {s[1]} THEN {n[1]} WHEN area > {s[2]} THEN {n[2]} ELSE {n[3]} END")


@query("X50_way_classes", f"""WITH {MAP_SQL}, steps AS ({STEPS}),
closed AS (SELECT way_id, lat, lon, coalesce(lat2, low) AS lat2, coalesce(lon2, lon0) AS lon2, low FROM steps),
shape AS (SELECT way_id, CASE WHEN count(*) > 2 THEN abs(sum((lon2 - lon) * ((lat + lat2) / 2 - low))) * power({D}, 2) * cos(radians(min(low))) ELSE 0 END AS area, sum({DIST.format(lat2='lat2', lon2='lon2')}) * {D} AS around FROM closed GROUP BY way_id),
tagged AS (SELECT *, CASE priority {KEY} ELSE 'building' END AS key, CASE priority {MAIN} ELSE 'yes' END AS value, CASE WHEN priority = '1-URGENT' THEN extra END AS extra FROM (SELECT *, {EXTRA} FROM ways)),
said AS (SELECT *, CASE WHEN key <> 'building' THEN NULL WHEN value <> 'yes' THEN CASE {BUILDING.format('value')} END
 WHEN extra = 'office' THEN 'office' WHEN extra = 'tourism' THEN 'hotel' WHEN extra IN ('amenity', 'leisure') THEN coalesce(CASE {BUILDING.format('extra_value')} END, 'undefined') ELSE 'undefined' END AS said FROM tagged JOIN shape USING (way_id)),
zoned AS (SELECT *, CASE zone {ZONE} END AS of_zone FROM said),
kinds AS (SELECT *, CASE WHEN said <> 'undefined' OR said IS NULL THEN said
 WHEN of_zone = 'industrial' THEN CASE WHEN area > 5000 THEN 'warehouse' WHEN area > 51 THEN 'industrial' ELSE 'small utility' END
 WHEN of_zone = 'commercial' THEN CASE WHEN area > 51 THEN 'commercial' ELSE 'small utility' END WHEN of_zone IS NOT NULL THEN of_zone
 WHEN around < 30 THEN 'small utility' WHEN around < 64 THEN 'house' WHEN area < 2000 THEN 'apartments' WHEN area < 5000 OR around / 4 > CAST(1.7 AS DOUBLE) * sqrt(area) THEN 'commercial' ELSE 'warehouse' END AS kind FROM zoned),
floors AS (SELECT *, CASE WHEN kind IS NOT NULL THEN {FLOORS} END AS floors, {spec_sql(lambda s, n, most: most)} AS most FROM kinds)
SELECT way_id, key || ':' || value AS surface, CAST(len(nodes) AS INTEGER) AS n_nodes, round(area + {TIE}) AS area_m2, round(around + {TIE}, 2) AS around_m, kind AS building, floors,
 CASE WHEN kind = 'house' THEN 2.2 WHEN kind IS NOT NULL THEN CAST(floor(floors * least(area, most) / 100) AS DOUBLE) END AS population,
 CASE WHEN kind IN ('house', 'farm', 'apartments') AND area BETWEEN 51 AND 350 AND floors * 3.5 <= 12 THEN round(2.17 * CASE WHEN area < 210 AND area > 112 THEN 1.2 ELSE 1 END * CASE way_id % 7 WHEN 0 THEN 1.3 WHEN 1 THEN 1.3 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.8 WHEN 5 THEN 0.8 ELSE 0.7 END / area + {TIE}, 5) WHEN kind IS NOT NULL THEN 0.0 END AS wood FROM floors""")
def x50_ways(spark, sf):
    w = g.measured(m.ways(spark, sf), m.nodes(spark, sf), m.stops(spark, sf)).withColumnsRenamed({"area_m2": "area", "around_m": "around"})
    said = landuse.tagged_building(c("tags"))
    w = w.withColumn("kind", F.when(said == "undefined", landuse.estimated_building(c("zone"), c("area"), c("around"))).otherwise(said))
    is_building, people = c("kind").isNotNull(), (c("way_id") % 7) * 1000.0 + 500
    people = F.when(c("way_id") % 7 == 1, 1100.0).otherwise(people)
    return w.select(
        "way_id", landuse.surface(c("tags")).alias("surface"), F.size("nodes").alias("n_nodes"), F.round(c("area") + TIE).alias("area_m2"), F.round(c("around") + TIE, 2).alias("around_m"), c("kind").alias("building"),
        F.when(is_building, landuse.floors(c("kind"), c("area"))).alias("floors"), F.when(is_building, landuse.population(c("kind"), c("area"))).alias("population"), F.when(is_building, F.round(landuse.wood_burning(c("kind"), c("area"), people) + TIE, 5)).alias("wood"),
    )


#: Land of the grid's cells: half of them built, the others water, road, crops and greens; houses by size, their ground by price.
LAND = f"""{CELLS}, land AS (SELECT h, w, CASE p_partkey % 8 WHEN 0 THEN 'water' WHEN 1 THEN 'road' WHEN 2 THEN 'crops' WHEN 3 THEN 'green' ELSE 'building' END AS kind,
 CAST(size AS DOUBLE) * 0.6 AS height_m, CAST(size * 37 % 1000 AS DOUBLE) AS area_m2, CASE p_partkey % 8 WHEN 3 THEN CAST(size AS DOUBLE) / 50 ELSE 0 END AS vegetation, CAST(floor(value) AS BIGINT) % 7 AS ground FROM cells)"""


def land(spark, sf):
    k = c("p_partkey") % 8
    kind = F.when(k == 0, "water").when(k == 1, "road").when(k == 2, "crops").when(k == 3, "green").otherwise("building")
    return grid_cells(spark, sf).select("h", "w", kind.alias("kind"), (c("size").cast("double") * 0.6).alias("height_m"), (c("size") * 37 % 1000).cast("double").alias("area_m2"), F.when(k == 3, c("size").cast("double") / 50).otherwise(0.0).alias("vegetation"), (F.floor("value") % 7).alias("ground"))


def values(rows):
    return ", ".join("(" + ", ".join(map(repr, row)) + ")" for row in rows)


ROUGH = f"CASE kind WHEN 'building' THEN CASE {' '.join(f'WHEN height_m > {h} AND area_m2 > {a} THEN {x}' for h, a, x in terrain.BUILT)} ELSE 0.8 END WHEN 'road' THEN 0.01 ELSE CASE WHEN vegetation > 0.01 THEN greatest(0.06, vegetation * 0.4) WHEN kind = 'water' THEN 0.001 ELSE 0.06 END END"


@query("M11_directed_roughness", f"""WITH {LAND}, rough AS (SELECT h, w, CAST({ROUGH} AS DOUBLE) AS v FROM land), star(dh, dw) AS (VALUES {values(terrain.star())}), rays(sector, dh, dw, k) AS (VALUES {values(terrain.rays())}),
mean AS (SELECT a.h, a.w, least(2.0, avg(b.v)) AS v FROM rough a, star JOIN rough b ON b.h = a.h + dh AND b.w = a.w + dw GROUP BY a.h, a.w),
ray AS (SELECT a.h, a.w, sector, any_value(a.v) AS overall, sum(k * b.v) / sum(k) AS v FROM mean a, rays JOIN mean b ON b.h = a.h + dh AND b.w = a.w + dw GROUP BY a.h, a.w, sector)
SELECT a.h, a.w, a.sector, round(0.05 * a.overall + 0.35 * a.v + 0.3 * (b.v + c.v) + {TIE}, 5) AS roughness FROM ray a JOIN ray b ON b.h = a.h AND b.w = a.w AND b.sector = (a.sector + 35) % 36 JOIN ray c ON c.h = a.h AND c.w = a.w AND c.sector = (a.sector + 1) % 36""")
def m11_directed(spark, sf):
    rough = land(spark, sf).select("h", "w", terrain.surface_roughness(c("kind"), c("height_m"), c("area_m2"), c("vegetation")).alias("value"))
    return terrain.directed_roughness(rough).select("h", "w", "sector", F.round(c("roughness") + TIE, 5).alias("roughness"))


#: 21 June 2024, and the metres of a cell.
DAY, CELL_M = 1718928000, 20.0


@query("X61_shaded_sun", f"""WITH {LAND}, tops AS (SELECT h, w, CAST(ground AS DOUBLE) AS ground, CASE kind WHEN 'building' THEN height_m ELSE 0 END AS building FROM land), along(sector, dh, dw, k) AS (VALUES {values(terrain.sunward())}),
horizon AS (SELECT a.h, a.w, sector, degrees(atan(greatest(0, max((CASE WHEN k * {CELL_M} < 25 THEN a.ground ELSE coalesce(b.ground, 0) END + coalesce(b.building, 0) - a.ground - a.building) / (k * CAST({CELL_M} AS DOUBLE)))))) AS horizon FROM (SELECT * FROM tops, along) a LEFT JOIN tops b ON b.h = a.h + dh AND b.w = a.w + dw GROUP BY a.h, a.w, sector),
t AS (SELECT h, w, hour, radians(60 - h * CAST(0.0002 AS DOUBLE)) AS phi, 24 + w * CAST(0.0004 AS DOUBLE) AS lon, CAST({DAY} + 3600 * hour AS DOUBLE) / 86400 - 10957.5 AS d FROM tops, (SELECT unnest(range(0, 24)) AS hour)),
b AS (SELECT *, 2.1429 - 0.0010394594 * d AS node, 6.24006 + 0.0172019699 * d AS m FROM t),
e AS (SELECT *, 4.895063 + 0.017202791698 * d + 0.03341607 * sin(m) + 0.00034894 * sin(2 * m) - 0.0001134 - 0.0000203 * sin(node) AS ecl, 0.4090928 - 6.214e-9 * d + 0.0000396 * cos(node) AS tilt FROM b),
f AS (SELECT *, asin(sin(tilt) * sin(ecl)) AS decl, radians((6.6974243242 + 0.0657098283 * d + hour) * 15 + lon) - atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ha FROM e),
z AS (SELECT *, acos(cos(phi) * cos(ha) * cos(decl) + sin(decl) * sin(phi)) AS zen, (degrees(atan2(-sin(ha), tan(decl) * cos(phi) - sin(phi) * cos(ha))) + 360) % 360 AS az FROM f),
up AS (SELECT h, w, hour, 90 - degrees(zen + 6371.01 / 149597890.0 * sin(zen)) AS elevation, CAST(floor(az / 10) AS BIGINT) AS sector FROM z)
SELECT up.h, up.w, up.hour, round(elevation, 3) AS elevation, round(CASE WHEN horizon > elevation THEN 0 ELSE 1000 * sin(radians(elevation)) END, 2) AS power FROM up JOIN horizon x ON x.h = up.h AND x.w = up.w AND x.sector = up.sector WHERE elevation > 0""")
def x61(spark, sf):
    cells = land(spark, sf).select("h", "w", "ground", F.when(c("kind") == "building", c("height_m")).otherwise(0.0).alias("building"))
    hours = cells.select("h", "w", (60 - c("h") * 0.0002).alias("lat"), (24 + c("w") * 0.0004).alias("lon"), F.explode(F.sequence(lit(0).cast("long"), lit(23).cast("long"))).alias("hour"))
    found = terrain.shaded_power(hours.withColumn("sec", DAY + 3600 * c("hour")), terrain.horizons(cells, CELL_M))
    return found.select("h", "w", "hour", F.round("elevation", 3).alias("elevation"), F.round("power", 2).alias("power"))
