"""Ways and rings of a map: node lookup, areas, perimeters, and rings joined from open ways.

A way is an array of node ids; its coordinates become an array of points in the same order, and measures are aggregates over that array.
Areas are in the plane of a point's own latitude, relative to that point, so nothing is lost to large coordinates.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.geo import DEGREE_M, distance, distance_m
from airloom.sources.store import small, spread, written

#: Most ways of a group that a task joins at once; larger groups are joined by all tasks together.
GROUP = 20_000
PLACES = T.StructType([T.StructField("chain", T.LongType()), T.StructField("at", T.LongType()), T.StructField("back", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("closed", T.BooleanType())])


def located(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ways`` with ``points``, an array of (lat, lon) in the order of ``nodes``, and ``n_missing``, the nodes that ``nodes(node_id, lat, lon)`` lacks."""
    each = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes, "node_id", "left")
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("pos", "lat", "lon"))
    found = each.groupBy("way_id").agg(F.sort_array(F.collect_list(point)).alias("points"), F.count_if(point.isNull()).alias("n_missing"))
    found = found.select("way_id", F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"), "n_missing")
    return ways.join(found, "way_id", "left").withColumns({"points": F.coalesce("points", F.array().cast("array<struct<lat: double, lon: double>>")), "n_missing": F.coalesce("n_missing", F.lit(0).cast("long"))})


def measured(ways: DataFrame, nodes: DataFrame, rows: int = 0) -> DataFrame:
    """``ways`` (with about ``rows`` nodes in all) with ``low`` (latitude of the first point), ``dx`` (longitude from the first to the last), ``strip``, ``under`` (the strip down to the
    equator) and ``length_m`` of the open line, ``area_m2`` and ``around_m`` of the closed one, and ``n_missing``, the nodes that ``nodes(node_id, lat, lon)`` lacks.

    Points are rows all along: no array of them is made, and a task sorts about ``PART_ROWS`` of them. Files are far smaller than their rows, so nothing is broadcast.
    """
    refs = spread(ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")), rows, "node_id")
    known = spread(nodes.filter("lat is not null and lon is not null"), rows, "node_id")
    points = spread(refs.join(known.hint("merge"), "node_id").drop("node_id"), rows, "way_id")
    line = Window.partitionBy("way_id").orderBy("pos")
    after = lambda k: F.lead(k).over(line)
    steps = points.select("way_id", "pos", "lat", "lon", after("pos").alias("pos2"), after("lat").alias("next_lat"), after("lon").alias("next_lon"), F.first("lat").over(line).alias("low"), F.first("lon").over(line).alias("lon0"))
    steps = steps.withColumns({"on": F.col("pos2").isNotNull(), "lat2": F.coalesce("next_lat", "low"), "lon2": F.coalesce("next_lon", "lon0")})
    dx, both, amount = F.col("lon2") - F.col("lon"), F.col("lat") + F.col("lat2"), distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    steps = steps.select("way_id", "low", "on", dx.alias("dx"), (dx * (both / 2 - F.col("low"))).alias("strip"), (dx * both / 2).alias("under"), amount.alias("far"), F.col("pos2").eqNullSafe(F.col("pos")).alias("twice"))
    open_sum = lambda k: F.sum(F.when(F.col("on"), F.col(k)).otherwise(0.0))
    sums = steps.groupBy("way_id").agg(
        F.first("low").alias("low"), open_sum("dx").alias("dx"), open_sum("strip").alias("strip"), open_sum("under").alias("under"), (open_sum("far") * DEGREE_M).alias("length_m"), F.sum("strip").alias("shut"), (F.sum("far") * DEGREE_M).alias("around_m"),
        F.count(F.lit(1)).alias("n_points"), F.count_if(~F.col("twice")).alias("n_found"),
    )
    area = F.when(F.col("n_points") > 2, F.abs("shut") * DEGREE_M**2 * F.cos(F.radians("low"))).otherwise(0.0)
    zero = {k: F.coalesce(k, F.lit(0.0)) for k in ("strip", "under", "length_m", "around_m")}
    missing = F.greatest(F.coalesce(F.size("nodes"), F.lit(0)), F.lit(0)) - F.coalesce("n_found", F.lit(0))
    return ways.join(sums.hint("merge"), "way_id", "left").withColumns(zero | {"area_m2": area, "n_missing": missing}).drop("shut", "n_points", "n_found")


def edges(points: Column, closed: bool) -> Column:
    """Pairs (a, b) of neighbouring points; with the last and the first, if closed."""
    after = F.slice(points, 2, F.greatest(F.size(points), F.lit(1)))
    after = F.concat(after, F.slice(points, 1, 1)) if closed else after
    before = points if closed else F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.arrays_zip(before.alias("a"), after.alias("b"))


def total(pairs: Column, amount) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + amount(e["a"], e["b"]))


def strip(points: Column, closed: bool) -> Column:
    """Signed area between a line and the latitude of its first point, in square degrees."""
    low = F.get(points, 0)["lat"]
    return total(edges(points, closed), lambda a, b: (b["lon"] - a["lon"]) * ((a["lat"] + b["lat"]) / 2 - low))


def area_m2(points: Column) -> Column:
    """Area of the polygon; 0 below three points."""
    return F.when(F.size(points) > 2, F.abs(strip(points, True)) * DEGREE_M * DEGREE_M * F.cos(F.radians(F.get(points, 0)["lat"]))).otherwise(0.0)


def length_m(points: Column, closed: bool = False) -> Column:
    return total(edges(points, closed), lambda a, b: distance_m(a["lat"], a["lon"], b["lat"], b["lon"]))


def joints(ends: DataFrame, by: list) -> DataFrame:
    """``(*by, way_id, a, b)`` with each end's joint: the node and a number, shared by just two ends; null where no other way ends.

    Where more than two ways end at a node they are paired in the order of their ids."""
    sides = ends.select(*by, "way_id", F.posexplode(F.array("a", "b")).alias("side", "node"))
    at_node = Window.partitionBy(*by, "node")
    place = F.row_number().over(at_node.orderBy("way_id", "side")) - 1
    alone = (place == F.count(F.lit(1)).over(at_node) - 1) & (place % 2 == 0)
    named = sides.select(*by, "way_id", "side", F.when(~alone, F.concat_ws(":", F.col("node").cast("string"), F.floor(place / 2).cast("string"))).alias("joint"))
    return named.groupBy(*by, "way_id").agg(F.max(F.when(F.col("side") == 0, F.col("joint"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("joint"))).alias("b"))


def contracted(parts: DataFrame, by: list, turn: int) -> DataFrame:
    """Two parts become one at each joint that comes first, in this turn's random order, among the joints of both: ``(*by, x, y)`` with (part, side of the joint, other joint, n).

    No part has two such joints, so all merges of a turn are independent, and about a third of the joints go."""
    rank = lambda j: F.struct(F.xxhash64(F.col(j), F.lit(turn)), F.col(j))
    end = lambda k, joint, other: F.struct(F.lit(k).alias("side"), F.col(joint).alias("joint"), F.col(other).alias("other"), (F.col(other).isNull() | (rank(joint) < rank(other))).alias("first"))
    ends = parts.filter("a is null or b is null or a <> b").select(*by, "part", "n", F.explode(F.array(end(0, "a", "b"), end(1, "b", "a"))).alias("e")).filter("e.joint is not null")
    own = F.struct("part", "e.side", "e.other", "n")
    met = ends.groupBy(*by, "e.joint").agg(F.min("e.first").alias("first"), F.min(own).alias("x"), F.max(own).alias("y"))
    return met.filter("first and x.part <> y.part").select(*by, "x", "y")


def group_numbers(rows: pa.Table, by: list) -> np.ndarray:
    """Numbers of the groups of rows that stand together."""
    new = np.zeros(len(rows), bool)
    for k in by:
        codes = pc.fill_null(rows[k].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def followed(step: np.ndarray, low: np.ndarray):
    """``(last, count, least)`` of each walk along ``step`` (-1 ends it): its last place, the steps to it and the smallest ``low`` on the way, in doubling strides.

    A walk that never ends has passed all its places, and its last one still has a step."""
    jump, count = np.where(step < 0, np.arange(len(step)), step), (step >= 0).astype(np.int64)
    seen = 1
    while True:
        low = np.minimum(low, low[jump])
        count, jump, seen = count + count[jump], jump[jump], 2 * seen
        going = step[jump] >= 0
        if not going.any() or seen > len(step):
            return jump, count, np.minimum(low, low[jump])  # a walk may end just where its last stride does


def joined_ways(group: np.ndarray, way: np.ndarray, a: np.ndarray, b: np.ndarray):
    """``(chain, at, back, n, closed)`` of ``chains`` for whole groups. A way passed from side s on has the place ``2 * way + s``."""
    m = len(way)
    node, owner, side = np.column_stack([a, b]).ravel(), np.repeat(np.arange(m), 2), np.tile([0, 1], m)
    order = np.lexsort((side, way[owner], node, group[owner]))
    order = order[(a != b)[owner[order]]]
    same = (node[order][1:] == node[order][:-1]) & (group[owner[order]][1:] == group[owner[order]][:-1])
    first = np.r_[True, ~same][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    second = np.flatnonzero(place % 2 == 1)
    partner = np.full(2 * m, -1)
    partner[order[second]], partner[order[second - 1]] = order[second - 1], order[second]
    step = partner[np.arange(2 * m) ^ 1]
    by_id = np.argsort(way, kind="stable")
    rank = np.empty(m, np.int64)
    rank[by_id] = np.arange(m)
    last, _, least = followed(step, np.repeat(rank, 2))
    start = by_id[np.minimum(least[::2], least[1::2])]
    closed = (step[last] >= 0)[::2]
    cut = (step >= 0) & closed[owner] & (step // 2 == start[owner])
    last, count, _ = followed(np.where(cut, -1, step), np.repeat(rank, 2))
    back = last[::2] != last[2 * start]
    n = count[2 * start] + np.where(closed, 0, count[2 * start + 1]) + 1
    at = n - 1 - count[2 * np.arange(m) + back]
    return way[start], at, back, n, closed | (a == b)


def grouped_chains(ends: DataFrame, by: list, rows: int) -> DataFrame:
    """``chains`` of groups of at most ``GROUP`` ways, each joined in one task as it streams by; a chain's ways stand together, in its order."""
    rest = [k for k in ends.columns if k not in ("a", "b")]

    def joined(held: pa.Table, group: np.ndarray):
        found = joined_ways(group, *(held[k].to_numpy() for k in ("way_id", "a", "b")))
        table = held.select(rest)
        for name, column in zip(PLACES.names, found):
            table = table.append_column(name, pa.array(column))
        chain, at = found[:2]
        return table.take(np.lexsort((at, chain, group))).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            group = group_numbers(held, by)
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from joined(held.slice(0, whole), group[:whole])
                held = held.slice(whole)
        if held is not None:
            yield from joined(held, group_numbers(held, by))

    kind = T.StructType([ends.schema[k] for k in rest] + PLACES.fields)
    return spread(ends, rows, *by).sortWithinPartitions(*by).mapInArrow(run, kind)


def chains(ends: DataFrame, by: list, most: int = GROUP) -> DataFrame:
    """``(*by, way_id, chain, at, back, n, closed)``: ways ``(*by, way_id, a, b)``, all long, joined end to end at nodes ``a`` and ``b``; further columns of ``ends`` come along.

    ``chain`` is the smallest way of a chain of ``n`` ways, ``at`` a way's place in it and ``back`` whether it is passed from b to a; a chain's
    smallest way is never passed backwards, and a closed chain starts with it. Groups (of equal ``by``) of more than ``most`` ways are contracted.
    """
    sizes = written(ends.groupBy(*by).agg(F.count(F.lit(1)).alias("ways")))
    total, largest = sizes.agg(F.sum("ways"), F.max("ways")).first()
    if largest is None or largest <= most:
        return grouped_chains(ends, by, total or 0)
    large = small(sizes.filter(F.col("ways") > most).select(*by), 100_000)
    match = lambda one, other: [one[k].eqNullSafe(other[k]) for k in by]
    huge = written(ends.join(large, match(ends, large), "left_semi").withColumn("group", F.struct(*by)))  # a struct is equal to itself with nulls, too
    found = contracted_chains(huge.select("group", "way_id", "a", "b"), ["group"]).join(huge, ["group", "way_id"])
    found = found.select(*[k for k in ends.columns if k not in ("a", "b")], *PLACES.names)
    return grouped_chains(ends.join(large, match(ends, large), "left_anti"), by, total).unionByName(found)


def contracted_chains(ends: DataFrame, by: list) -> DataFrame:
    """``chains`` of groups of any size: each turn merges pairs of neighbours, so the number of turns grows with the
    logarithm of the longest chain, and no chain is ever held by a task."""
    whole = ends.filter("a <> b")
    parts = written(joints(whole, by).select(*by, F.col("way_id").alias("part"), "a", "b", F.lit(1).cast("long").alias("n")))
    ways = written(whole.select(*by, "way_id", F.col("way_id").alias("part"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("back")))
    turn = 0
    while True:
        merged = written(contracted(parts, by, turn))
        if merged.isEmpty():
            break
        move = lambda p, flipped, off: F.struct(F.col(f"{p}.part").alias("part"), flipped.alias("flip"), off.alias("off"), F.col(f"{p}.n").alias("n"))
        both = F.array(move("x", F.col("x.side") == 0, F.lit(0).cast("long")), move("y", F.col("y.side") == 1, F.col("x.n")))
        moves = merged.select(*by, F.explode(both).alias("move"), F.col("x.part").alias("to")).select(*by, "move.*", "to")
        new = merged.select(*by, F.col("x.part").alias("part"), F.col("x.other").alias("a"), F.col("y.other").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n"))
        parts = written(parts.join(moves, [*by, "part"], "left_anti").unionByName(new))
        at = F.col("off") + F.when(F.col("flip"), F.col("n") - 1 - F.col("at")).otherwise(F.col("at"))
        own = ways.join(moves, [*by, "part"], "left")
        ways = written(own.select(*by, "way_id", F.coalesce("to", "part").alias("part"), F.coalesce(at, "at").alias("at"), (F.col("back") != F.coalesce("flip", F.lit(False))).alias("back")))
        turn += 1
    state = parts.select(*by, "part", "n", (F.col("a").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("closed"))
    first = ways.filter("way_id = part").select(*by, "part", F.col("at").alias("at0"), F.col("back").alias("back0"))
    turned = F.when(F.col("back0"), F.col("at0") - F.col("at")).otherwise(F.col("at") - F.col("at0"))
    place = F.when(F.col("closed"), F.pmod(turned, F.col("n"))).when(F.col("back0"), F.col("n") - 1 - F.col("at")).otherwise(F.col("at"))
    found = ways.join(state, [*by, "part"]).join(first, [*by, "part"])
    found = found.select(*by, "way_id", F.col("part").alias("chain"), place.alias("at"), (F.col("back") != F.col("back0")).alias("back"), "n", "closed")
    rings = ends.filter("a = b").select(*by, "way_id", F.col("way_id").alias("chain"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("back"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("closed"))
    return found.unionByName(rings)


def relation_rings(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """``(relation_id, role, ring, n_ways, n_lost, closed, area_m2, length_m)`` of ``relations(relation_id, role, way_id)`` over measured ``ways``.

    Outer and inner ways make rings of their own. An open ring has no area; ``n_lost`` counts the relation's ways of that role that are missing from the extract.
    A ring's area is the sum of its ways' strips down to the equator, each in the direction in which the ring passes it and in the ring's order, as by the SQL: another order or
    zero shifts a sum of large terms by about a millionth of a square metre, which is enough to round it otherwise.
    """
    by = ["relation_id", "role"]
    ends = [F.get("nodes", 0).alias("a"), F.element_at("nodes", -1).alias("b")]
    ways = ways.filter(F.size("nodes") > 1).select("way_id", *ends, "under", "low", "length_m", "n_missing")
    own = written(relations.join(ways, "way_id", "left"))
    each = chains(own.filter("a is not null and b is not null").drop("n_missing"), by).withColumn("sign", F.when(F.col("back"), -1).otherwise(1))
    lost = own.groupBy(*by).agg(F.count_if(F.col("a").isNull() | (F.col("n_missing") > 0)).alias("n_lost"))
    sums = each.groupBy(*by, F.col("chain").alias("ring"), "closed").agg(
        F.count(F.lit(1)).alias("n_ways"), F.sum(F.col("sign") * F.col("under")).alias("strips"), F.min("low").alias("low"), F.sum("length_m").alias("length_m")
    )
    area = F.when(F.col("closed"), F.abs("strips") * DEGREE_M**2 * F.cos(F.radians("low")))
    return sums.join(lost, by).select(*by, "ring", "n_ways", "n_lost", "closed", area.alias("area_m2"), "length_m")
