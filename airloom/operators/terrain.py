"""Roughness by wind direction and shade by the sun's direction, over grids in tiles."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions import sun
from airloom.sources.store import small, written

from . import tiles

SECTORS, STEP = 36, 10
#: Roughness lengths in metres of land uses, of buildings by least height and area, the greatest of a cell, and that of unknown land.
WATER, GRASS, CROPS, LOW_HOUSES = 0.001, 0.01, 0.06, 0.8
BUILT = [(20, 600, 3.0), (15, 400, 2.0), (7, 300, 1.2)]
MOST, UNKNOWN = 2.0, 0.1
#: Shares of the overall roughness, the wind's sector and its two neighbours; degrees that a ray's third and fourth cells are turned.
OVERALL, OWN, BESIDE, TURN = 0.05, 0.35, 0.3, 3
#: Cells around that make a cell's roughness, and cells of a sector's ray.
NEAR, FAR = 9, 10
#: Cells of a ray towards the sun; nearer than this the ground counts as level.
REACH, LEVEL_M = 25, 25.0
#: Times of the sun are broadcast up to this many (about 30 MB); beyond it the join shuffles.
MAX_TIMES = 500_000


def surface_roughness(kind: Column, height_m: Column, area_m2: Column, vegetation: Column) -> Column:
    """Roughness length of a cell: buildings by height and area, else roads and lawns, vegetation, water, crops."""
    built = F.lit(LOW_HOUSES)
    for h, a, rough in reversed(BUILT):
        built = F.when((height_m > h) & (area_m2 > a), rough).otherwise(built)
    green = F.when(vegetation > 0.01, F.greatest(F.lit(CROPS), vegetation * 0.4))
    return F.when(kind == "building", built).when(kind == "road", GRASS).otherwise(F.coalesce(green, F.when(kind == "water", WATER).otherwise(CROPS)))


def star(n: int = NEAR) -> list:
    """The cell itself and six rays of ``n`` cells."""
    return [(0, 0)] + [(h, w) for d in range(0, 360, 60) for h, w, _ in tiles.ray(n, d)]


def rays(n: int = FAR) -> list:
    """(sector, dh, dw, weight) of the cells upwind; weights fall to nothing at the ray's end."""
    turned = lambda k: TURN if k % 3 == 0 else -TURN if k % 4 == 0 else 0
    return [(s, *(tiles.ray(k, s * STEP + turned(k))[-1][:2] if k else (0, 0)), 1 - k / (n + 1)) for s in range(SECTORS) for k in range(n + 1)]


def directed_roughness(cells: DataFrame, size: int = tiles.TILE) -> DataFrame:
    """``(h, w, sector, roughness)`` from the roughness of cells ``(h, w, value)``: a cell's is the mean of those around it, a sector's the weighted mean along
    its ray, and the two are blended with the sectors beside."""
    around, along = star(), rays()

    def kernel(a):
        here = tiles.shifted(a, NEAR, 0, 0)
        seen = [tiles.shifted(a, NEAR, dh, dw) for dh, dw in around]
        n = sum((~np.isnan(x)).astype(float) for x in seen)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(np.isnan(here), np.nan, np.minimum(MOST, sum(map(np.nan_to_num, seen)) / n))
        total, weight = np.zeros((2, SECTORS, a.shape[0] - 2 * NEAR - 2 * FAR, a.shape[1] - 2 * NEAR - 2 * FAR))
        for s, dh, dw, k in along:
            x = tiles.shifted(mean, FAR, dh, dw)
            total[s] += k * np.nan_to_num(x)
            weight[s] += k * ~np.isnan(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            ray = np.where(weight > 0, total / weight, UNKNOWN)
        return OVERALL * tiles.shifted(mean, FAR, 0, 0) + OWN * ray + BESIDE * (np.roll(ray, 1, axis=0) + np.roll(ray, -1, axis=0))

    made = tiles.windows(tiles.asked(cells), NEAR + FAR, kernel, size)
    return made.select("h", "w", F.col("layer").alias("sector"), F.col("value").alias("roughness"))


def sunward(n: int = REACH) -> list:
    """(sector, dh, dw, k): the middle of each sector, ``k`` cells away."""
    return [(s, *x) for s in range(SECTORS) for x in tiles.ray(n, (s + 0.5) * STEP)]


def horizons(cells: DataFrame, cell_m: float, size: int = tiles.TILE) -> DataFrame:
    """``(h, w, sector, horizon)``: the steepest angle in degrees from the top of a cell ``(h, w, ground, building)`` to those along each sector."""
    along = sunward()

    def kernel(ground, building):
        ground, building = np.nan_to_num(ground), np.nan_to_num(building)
        own = tiles.shifted(ground, REACH, 0, 0)
        top, steep = own + tiles.shifted(building, REACH, 0, 0), np.zeros((SECTORS, *own.shape))
        for s, dh, dw, k in along:
            far = own if k * cell_m < LEVEL_M else tiles.shifted(ground, REACH, dh, dw)
            steep[s] = np.maximum(steep[s], (far + tiles.shifted(building, REACH, dh, dw) - top) / (k * cell_m))
        return np.degrees(np.arctan(steep))

    rows = cells.select("h", "w", F.col("ground").cast("double").alias("ground"), F.col("building").cast("double").alias("building"), F.lit(True).alias("asked"))
    made = tiles.windows(rows, REACH, kernel, size, ("ground", "building"))
    return made.select("h", "w", F.col("layer").alias("sector"), F.col("value").alias("horizon"))


def shaded_power(places: DataFrame, horizon: DataFrame) -> DataFrame:
    """``places(h, w, lat, lon, sec)`` while the sun is up, with ``elevation`` and ``power``, which is 0 where the horizon in the sun's sector is higher.

    The sun's place in the sky is worked out once for each time: written out in every row's filter, it makes code that the JVM doesn't compile."""
    star, ascension, declination = sun.sky(F.col("sec"))
    times = small(written(places.select("sec").distinct().withColumns({"_star": star, "_ascension": ascension, "_declination": declination})), MAX_TIMES)
    elevation, azimuth = sun.seen(F.col("_star"), F.col("_ascension"), F.col("_declination"), F.col("lat"), F.col("lon"))
    up = places.join(times, "sec").withColumns({"elevation": elevation, "sector": F.floor(azimuth / STEP).cast("int")}).filter("elevation > 0").drop("_star", "_ascension", "_declination")
    seen = up.join(horizon.hint("merge"), ["h", "w", "sector"])  # a grid's file is far smaller than its sectors' rows, so Spark would broadcast them
    return seen.withColumn("power", F.when(F.col("horizon") > F.col("elevation"), 0.0).otherwise(sun.power(F.col("elevation"))))
