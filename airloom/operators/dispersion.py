"""Footprints, plumes and puffs as joins and aggregates over cells."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions import physics
from airloom.sources.store import small, written

PI = 3.141592653589793


def footprint(spark, reach: int, cell_m: float) -> DataFrame:
    """``(dh, dw, x, y)``: cells up to ``reach`` cells upwind, with metres along and across a north wind; a fixed-size table."""
    n = 2 * reach + 1
    cells = spark.range(reach * n).select((F.floor(F.col("id") / n) + 1).alias("dh"), (F.col("id") % n - reach).alias("dw"))
    return cells.select("dh", "dw", (F.col("dh") * cell_m).alias("x"), (F.col("dw") * cell_m).alias("y"))


#: Weights are broadcast up to so many rows (about 20 MB); beyond it the join shuffles.
MAX_BROADCAST_HEIGHTS = 20_000


def receptor_sums(emissions: DataFrame, cells: DataFrame, speed: float = 3.0, depth: float = 300.0, cls: int = 3, z: float = 2.0) -> DataFrame:
    """``(h, w, cat, pollutant, conc)``: each emission cell's plume summed over the receptors downwind of a north wind.

    Emissions are added up by cell, category and height first. A plume's weights depend on the height alone, so they are worked out once for
    each height that occurs and footprint cell (``cells``, of fixed size), not once for each emission. Sums are partial before the shuffle.
    """
    dense = emissions.groupBy("h", "w", "cat", "pollutant", "height_m").agg(F.sum("rate").alias("rate"))
    weight = physics.plume(F.col("x"), F.col("y"), F.lit(z), F.col("height_m"), F.lit(speed), F.lit(depth), F.lit(cls))
    heights = emissions.select("height_m").distinct().crossJoin(F.broadcast(cells))
    reach = heights.groupBy("height_m").agg(F.collect_list(F.struct("dh", "dw", weight.alias("weight"))).alias("reach"))  # a list of the footprint's size
    spread = dense.join(small(written(reach), MAX_BROADCAST_HEIGHTS), "height_m").select("h", "w", "cat", "pollutant", "rate", F.inline("reach"))
    return spread.groupBy((F.col("h") + F.col("dh")).alias("h"), (F.col("w") + F.col("dw")).alias("w"), "cat", "pollutant").agg(F.sum(F.col("rate") * F.col("weight")).alias("conc"))


def released(emissions: DataFrame, mass_of: float) -> DataFrame:
    """One puff for each started ``mass_of`` of a source's rate: ``(puff, emitter, cat, h_m, y_m, x_m, dist_m, age_s, mass)``."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / mass_of))
    one = emissions.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return one.select(
        F.concat_ws(":", "emitter", "cat", "h", "w", "k").alias("puff"),
        "cat",
        F.col("height_m").alias("h_m"),
        (F.col("h") * 100.0).alias("y_m"),
        (F.col("w") * 100.0).alias("x_m"),
        F.lit(0.0).alias("dist_m"),
        F.lit(0.0).alias("age_s"),
        (F.col("rate") / F.col("n")).alias("mass"),
    )


def advected(puffs: DataFrame, north: float, east: float, seconds: float, decay_per_h: float = 0.0) -> DataFrame:
    """Puffs one tick later; mass decays exponentially."""
    speed = (north * north + east * east) ** 0.5
    return puffs.withColumns(
        {
            "y_m": F.col("y_m") + north * seconds,
            "x_m": F.col("x_m") + east * seconds,
            "dist_m": F.col("dist_m") + speed * seconds,
            "age_s": F.col("age_s") + seconds,
            "mass": F.col("mass") * F.exp(F.lit(-decay_per_h * seconds / 3600)),
        }
    )


def height_band(h):
    return F.when(h < 40, 0).when(h < 80, 1).otherwise(2)


def cell(at, cell_m: float):
    """Cell of a position; means that fall short of an edge by rounding lie beyond it."""
    return F.floor(at / cell_m + 1e-9)


def merged(puffs: DataFrame, cell_m: float) -> DataFrame:
    """One puff for each height band, cell and category: mass adds up, positions and ages are weighted by mass."""
    keys = {"band": height_band(F.col("h_m")), "cy": cell(F.col("y_m"), cell_m), "cx": cell(F.col("x_m"), cell_m)}
    mean = lambda c: (F.sum(F.col(c) * F.col("mass")) / F.sum("mass")).alias(c)
    g = puffs.withColumns(keys).groupBy("band", "cy", "cx", "cat").agg(F.min("puff").alias("puff"), *[mean(c) for c in ("h_m", "y_m", "x_m", "dist_m", "age_s")], F.sum("mass").alias("mass"))
    return g.select("puff", "cat", "h_m", "y_m", "x_m", "dist_m", "age_s", "mass")


def puff_concentration(d2, dist, height, z, cls="D"):
    """Concentration of a unit puff at a squared horizontal distance; ground-reflecting."""
    x = F.greatest(dist, F.lit(10.0))
    ry, rz = F.pow(physics.sigma_y(x, cls), 2) / 2, F.pow(physics.sigma_z(x, cls), 2) / 2
    r = F.sqrt(ry * rz)
    return F.exp(-d2 / (4 * ry)) * physics.reflection(rz, z, height) / (8 * F.pow(PI * r, F.lit(1.5)))


def puff_layer(puffs: DataFrame, cell_m: float, z: float = 2.0) -> DataFrame:
    """``(h, w, cat, conc)``: puffs reach cells within 2 + 0.25 dist / cell, then sums by cell."""
    rad = 2 + F.floor(0.25 * F.col("dist_m") / cell_m)
    p = puffs.withColumns({"rad": rad, "ch": cell(F.col("y_m"), cell_m), "cw": cell(F.col("x_m"), cell_m)})
    p = p.withColumn("dh", F.explode(F.sequence(-F.col("rad"), F.col("rad")))).withColumn("dw", F.explode(F.sequence(-F.col("rad"), F.col("rad"))))
    y, x = (F.col("ch") + F.col("dh") + 0.5) * cell_m, (F.col("cw") + F.col("dw") + 0.5) * cell_m
    d2 = F.pow(y - F.col("y_m"), 2) + F.pow(x - F.col("x_m"), 2)
    conc = F.col("mass") * puff_concentration(d2, F.col("dist_m"), F.col("h_m"), F.lit(z))
    return p.select((F.col("ch") + F.col("dh")).alias("h"), (F.col("cw") + F.col("dw")).alias("w"), "cat", conc.alias("conc")).groupBy("h", "w", "cat").agg(F.sum("conc").alias("conc"))


def simulated(emissions: DataFrame, winds, seconds: float, cell_m: float, mass_of: float, save) -> DataFrame:
    """Puffs after all ticks of ``winds`` [(north, east)]: inject, advect, merge. ``save`` writes each tick's puffs to shared
    storage and reads them back, so lineage stays short and a lost executor costs one tick."""
    puffs = None
    for north, east in winds:
        fresh = released(emissions, mass_of)
        puffs = save(merged(advected(fresh if puffs is None else puffs.unionByName(fresh), north, east, seconds, 0.02), cell_m))
    return puffs


def line_cells(rows: DataFrame) -> DataFrame:
    """``rows(h0, w0, h1, w1, ...)`` once for each cell of the straight line between two cells, with ``h``, ``w`` and their number ``n``."""
    n = F.greatest(F.abs(F.col("h1") - F.col("h0")), F.abs(F.col("w1") - F.col("w0"))) + 1
    steps = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    m = F.greatest(F.lit(1).cast("long"), F.col("n") - 1)
    at = lambda a, b: F.col(a) + F.floor((2 * F.col("k") * (F.col(b) - F.col(a)) + m) / (2 * m))
    return steps.withColumns({"h": at("h0", "h1"), "w": at("w0", "w1")}).drop("k")


def trajectory_points(rows: DataFrame, by: str, cell_m: float, max_gap_s: int = 7200) -> DataFrame:
    """Consecutive positions as points along the line: ``steps + 1`` points share the mass of each leg; legs without
    duration or longer than ``max_gap_s`` are left out. ``rows(by, sec, y_m, x_m, rate)``."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("sec")
    legs = rows.select(by, "sec", "y_m", "x_m", "rate", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("sec", "y_m", "x_m", "rate")])
    legs = legs.withColumn("dur", F.col("n_sec") - F.col("sec")).filter((F.col("dur") > 0) & (F.col("dur") <= max_gap_s) & (F.col("rate") + F.col("n_rate") > 0))
    length = F.sqrt(F.pow(F.col("n_y_m") - F.col("y_m"), 2) + F.pow(F.col("n_x_m") - F.col("x_m"), 2))
    legs = legs.withColumn("steps", F.floor(1.2 * length / cell_m + 1)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "steps")).alias("k"))
    f = F.col("k") / F.col("steps")
    along = lambda c: F.col(c) + (F.col(f"n_{c}") - F.col(c)) * f
    return legs.select(by, (F.col("sec") + F.floor(F.col("dur") * f)).alias("sec"), along("y_m").alias("y_m"), along("x_m").alias("x_m"), (along("rate") * F.col("dur") / (F.col("steps") + 1)).alias("mass"))
