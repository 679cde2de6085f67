"""Map views of the star-schema tables: nodes, ways and multipolygon relations.

A customer is a relation and its orders are the member ways, outer or inner, six to a ring. A way starts at its own junction, passes a node for each
line number and ends at the next member's junction; every second one is drawn backwards. Ways whose number is divisible by 13 are
missing from the extract, so their rings stay open.

``MAP_SQL`` is the same in DuckDB SQL, to start a ``WITH`` list.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import table
from .store import spread

#: Values of the tags by the way's number modulo 5.
KINDS = {
    "2-HIGH": ("building", ["house", "apartments", "garage", "warehouse", "church"]),
    "3-MEDIUM": ("highway", ["primary", "residential", "footway", "cycleway", "service"]),
    "4-NOT SPECIFIED": ("landuse", ["industrial", "commercial", "forest", "farmland", "residential"]),
    "5-LOW": ("natural", ["water", "wood", "scrub", "sand", "grassland"]),
}
EXTRAS = [("office", "company"), ("tourism", "hotel"), ("amenity", "school"), ("note", "none"), ("leisure", "stadium")]
ZONES = ["", "industrial", "commercial", "farmland", "residential"]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(relation_id, role, way_id, q, k, m, next_way, priority)``: member ``k`` of the ``m`` of ring ``q``."""
    role = F.when(F.col("o_orderkey") % 4 == 0, "inner").otherwise("outer")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation_id"), role.alias("role"), F.col("o_orderkey").alias("way_id"), F.col("o_orderpriority").alias("priority"))
    along = Window.partitionBy("relation_id", "role").orderBy("way_id")  # one order for all: a ring is six neighbours in it
    o = o.withColumns({"i": F.row_number().over(along) - 1, "after": F.lead("way_id").over(along), "before": F.array(*[F.lag("way_id", j).over(along) for j in range(1, 6)])})
    o = o.withColumns({"count": F.count(F.lit(1)).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "q": F.floor(F.col("i") / 6), "k": F.col("i") % 6})
    o = o.withColumns({"m": F.least(F.lit(6), F.col("count") - 6 * F.col("q")), "first": F.when(F.col("k") == 0, F.col("way_id")).otherwise(F.get("before", F.col("k") - 1))})
    return o.withColumn("next_way", F.when(F.col("k") == F.col("m") - 1, F.col("first")).otherwise(F.col("after"))).drop("i", "after", "before", "count", "first")


def stops(spark: SparkSession, sf_dir: str) -> int:
    """About the number of nodes of all ways, from the row counts in the files' footers."""
    return table(spark, sf_dir, "orders").count() + table(spark, sf_dir, "lineitem").count()


def lines(spark: SparkSession, sf_dir: str, junctions: bool = False) -> DataFrame:
    """``(way_id, line, jitter)``, by way: what is grouped or joined by way moves no more. With ``junctions`` each way's own one is a line 0."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", F.lit(False).alias("junction"))
    if junctions:
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), zero.alias("line"), zero.alias("l_partkey"), F.lit(True).alias("junction")))
    return spread(rows, stops(spark, sf_dir), "way_id").groupBy("way_id", "line", "junction").agg((F.min("l_partkey") % 4).alias("jitter")).drop("junction")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, lat, lon)``."""
    m = members(spark, sf_dir)
    each = m.join(lines(spark, sf_dir, junctions=True).hint("merge"), "way_id")
    angle = 2 * math.pi * (F.col("k") + F.col("line") / 8) / F.col("m")
    radius = F.when(F.col("role") == "inner", 0.002).otherwise(0.006) * (1 + 0.05 * F.col("jitter"))
    lat = 60 + F.col("relation_id") % 50 * 0.05 + F.col("q") * 0.015 + radius * F.sin(angle)
    lon = 24 + F.floor(F.col("relation_id") / 50) % 50 * 0.1 + 2 * radius * F.cos(angle)
    return each.select((F.col("way_id") * 10 + F.col("line")).alias("node_id"), lat.alias("lat"), lon.alias("lon"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(way_id, nodes, tags, zone)``; ``zone`` is the functional land use around the way, if any."""
    inner = lines(spark, sf_dir).groupBy("way_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    m = members(spark, sf_dir).filter("way_id % 13 <> 0").join(inner.hint("merge"), "way_id", "left")
    own = F.transform(F.coalesce("lines", F.array().cast("array<long>")), lambda x: F.col("way_id") * 10 + x)
    along = F.concat(F.array(F.col("way_id") * 10), own, F.array(F.col("next_way") * 10))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("way_id") % 5 + 1).cast("int"))
    tags = F.create_map(F.lit("building"), F.lit("yes"), pick([k for k, _ in EXTRAS]), pick([v for _, v in EXTRAS]))
    for priority, (key, values) in KINDS.items():
        tags = F.when(F.col("priority") == priority, F.create_map(F.lit(key), pick(values))).otherwise(tags)
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.floor(F.col("way_id") / 5) % 5 + 1).cast("int"))
    return m.select("way_id", F.when(F.col("way_id") % 2 == 0, F.reverse(along)).otherwise(along).alias("nodes"), tags.alias("tags"), F.nullif(zone, F.lit("")).alias("zone"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(relation_id, role, way_id)``: a row for each member."""
    return members(spark, sf_dir).select("relation_id", "role", "way_id")


def picked_sql(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "][way_id % 5 + 1]"


MAP_SQL = f"""numbered AS (SELECT o_custkey AS relation_id, CASE WHEN o_orderkey % 4 = 0 THEN 'inner' ELSE 'outer' END AS role, o_orderkey AS way_id, o_orderpriority AS priority,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 = 0 ORDER BY o_orderkey) - 1 AS i FROM orders),
members AS (SELECT *, i // 6 AS q, i % 6 AS k, count(*) OVER g AS m, coalesce(lead(way_id) OVER (g ORDER BY i), min(way_id) OVER g) AS next_way FROM numbered WINDOW g AS (PARTITION BY relation_id, role, i // 6)),
lines AS (SELECT l_orderkey AS way_id, CAST(l_linenumber AS BIGINT) AS line, min(l_partkey) % 4 AS jitter FROM lineitem GROUP BY ALL),
stops AS (SELECT m.*, 0 AS line, 0 AS jitter FROM members m UNION ALL SELECT m.*, line, jitter FROM members m JOIN lines USING (way_id)),
nodes AS (SELECT way_id * 10 + line AS node_id, 60 + relation_id % 50 * CAST(0.05 AS DOUBLE) + q * CAST(0.015 AS DOUBLE) + CASE role WHEN 'inner' THEN CAST(0.002 AS DOUBLE) ELSE CAST(0.006 AS DOUBLE) END * (1 + CAST(0.05 AS DOUBLE) * jitter) * sin(2 * pi() * (k + line / 8) / m) AS lat,
  24 + relation_id // 50 % 50 * CAST(0.1 AS DOUBLE) + 2 * (CASE role WHEN 'inner' THEN CAST(0.002 AS DOUBLE) ELSE CAST(0.006 AS DOUBLE) END * (1 + CAST(0.05 AS DOUBLE) * jitter)) * cos(2 * pi() * (k + line / 8) / m) AS lon FROM stops),
drawn AS (SELECT *, list_concat([way_id * 10], coalesce((SELECT list(way_id * 10 + line ORDER BY line) FROM lines WHERE lines.way_id = members.way_id), []), [next_way * 10]) AS along FROM members WHERE way_id % 13 <> 0),
ways AS (SELECT way_id, CASE WHEN way_id % 2 = 0 THEN list_reverse(along) ELSE along END AS nodes, priority,
  nullif({str(ZONES)}[way_id // 5 % 5 + 1], '') AS zone FROM drawn),
points AS (SELECT way_id, pos, lat, lon FROM (SELECT way_id, unnest(nodes) AS node_id, unnest(range(1, len(nodes) + 1)) AS pos FROM ways) JOIN nodes USING (node_id))"""
