"""Windows over grids by tiles with halos.

A grid is cut into square tiles. Each cell goes to its own tile and, if it lies within a window's radius of others, to those: a
tile gets its rows and columns and a rim of its neighbours', about ``(1 + 2 * radius / size) ** 2`` copies of a cell in place of
``(2 * radius + 1) ** 2``. A task holds one tile as an array and slides the window over it, so a window costs one pass however wide it is.

Cells without a value are empty (NaN in the arrays); of several values of a cell the greatest counts. Only cells that are ``asked`` for come back, and only
where the kernel finds something.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells on a tile's side.
TILE = 64


def asked(cells: DataFrame, by=()) -> DataFrame:
    """All cells of ``(*by, h, w, value)``, each with a value and asked for."""
    return cells.select(*by, "h", "w", F.col("value").cast("double").alias("value"), F.lit(True).alias("asked"))


def empty(cells: DataFrame) -> DataFrame:
    """Cells that are asked for and give no value."""
    return cells.select("h", "w", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked"))


def with_halo(rows: DataFrame, radius: int, size: int) -> DataFrame:
    """The rows in each tile ``(th, tw)`` that needs them."""
    reach = lambda k: F.explode(F.sequence(F.floor((F.col(k) - radius) / size), F.floor((F.col(k) + radius) / size)))
    return rows.select("*", reach("h").alias("th")).select("*", reach("w").alias("tw"))


def windows(rows: DataFrame, radius: int, kernel, size: int = TILE, values=("value",), by=()) -> DataFrame:
    """``(*by, h, w, layer, value)`` of ``rows(*by, h, w, *values, asked)``: what ``kernel(*arrays)`` makes of a tile's arrays with a halo of ``radius`` cells, for each
    grid that the columns ``by`` tell apart.

    The kernel gives one array of the tile without its halo, or a stack of them (layers); NaN is left out. Tiles stream through the tasks in order, and a task holds one.
    """

    keys = [*by, "th", "tw"]

    def tile(key, h, w, wanted, data):
        top, left, side = int(key[-2]) * size - radius, int(key[-1]) * size - radius, size + 2 * radius
        h, w = h - top, w - left
        mine = wanted & (h >= radius) & (h < radius + size) & (w >= radius) & (w < radius + size)
        if not mine.any():  # all that came is halo
            return None
        arrays = []
        for v in data:
            a, has = np.full((side, side), -np.inf), ~np.isnan(v)
            np.maximum.at(a, (h[has], w[has]), v[has])
            arrays.append(np.where(np.isneginf(a), np.nan, a))
        own = np.zeros((size, size), bool)
        own[h[mine] - radius, w[mine] - radius] = True
        made = np.moveaxis(np.asarray(kernel(*arrays)).reshape(-1, size, size), 0, -1)
        at = np.argwhere(own[:, :, None] & ~np.isnan(made))
        return at[:, 0] + top + radius, at[:, 1] + left + radius, at[:, 2].astype(np.int32), made[tuple(at.T)]

    def frame(made):
        parts = [np.concatenate(x) for x in zip(*[m for _, m in made])]
        own = {c: pd.Series([k[i] for k, m in made for _ in range(len(m[0]))], dtype=object) for i, c in enumerate(by)}
        return pd.DataFrame(own | dict(zip(("h", "w", "layer", "value"), parts)))

    def run(batches):
        made, n, key, held = [], 0, None, []

        def closed():
            found = tile(key, *[np.concatenate(x) for x in list(zip(*held))[:3]], [np.concatenate(x) for x in list(zip(*held))[3:]]) if held else None
            return [(key, found)] if found is not None else []

        for pdf in batches:
            columns = [pdf[c].to_numpy() for c in keys]
            starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()] if len(pdf) else []
            arrays = [pdf["h"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64), pdf["asked"].to_numpy(bool), *[pdf[v].to_numpy(np.float64) for v in values]]
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                k = tuple(c[lo] for c in columns)
                if k != key:
                    made += closed()
                    key, held, n = k, [], sum(len(m[0]) for _, m in made)
                    if n >= 50_000:
                        yield frame(made)
                        made = []
                held.append([a[lo:hi] for a in arrays])
        made += closed()
        if made:
            yield frame(made)

    kind = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(c, t) for c, t in zip(("h", "w", "layer", "value"), (T.LongType(), T.LongType(), T.IntegerType(), T.DoubleType()))]])
    return with_halo(rows, radius, size).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, kind)


def shifted(a, radius, dh, dw):
    """The tile without its halo, moved so that each cell shows the one ``(dh, dw)`` from it."""
    n, m = a.shape[0] - 2 * radius, a.shape[1] - 2 * radius
    return a[radius + dh : radius + dh + n, radius + dw : radius + dw + m]


def mean(radius, weight):
    """Kernel: mean of the cells within ``radius`` rows and columns by ``weight(dh, dw)`` (0 leaves one out)."""

    def run(a):
        have, filled, total, weights = ~np.isnan(a), np.nan_to_num(a), 0.0, 0.0
        for dh in range(-radius, radius + 1):
            for dw in range(-radius, radius + 1):
                k = weight(dh, dw)
                if k:
                    total = total + k * shifted(filled, radius, dh, dw)
                    weights = weights + k * shifted(have, radius, dh, dw)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(weights > 0, total / weights, np.nan)

    return run


def count(radius):
    """Kernel: how many of the other cells within ``radius`` have a value."""

    def run(a):
        have = (~np.isnan(a)).astype(np.float64)
        sums = sum(shifted(have, radius, dh, dw) for dh in range(-radius, radius + 1) for dw in range(-radius, radius + 1) if dh or dw)
        return np.where(sums > 0, sums, np.nan)

    return run


def distance(radius):
    """Kernel: distance in cells to the nearest cell with a value, within ``radius`` rows and columns; first along rows, then along columns."""

    def run(a):
        far = 4.0 * radius + 4
        own = np.where(np.isnan(a), far, 0.0)
        across = np.full((a.shape[0], a.shape[1] - 2 * radius), far)
        for dw in range(-radius, radius + 1):
            across = np.minimum(across, own[:, radius + dw : radius + dw + across.shape[1]] + abs(dw))
        best = np.full((a.shape[0] - 2 * radius, across.shape[1]), far * far)
        for dh in range(-radius, radius + 1):
            best = np.minimum(best, across[radius + dh : radius + dh + len(best)] ** 2 + dh * dh)
        return np.where(best <= 2 * radius * radius, np.sqrt(best), np.nan)

    return run


def ray(steps: int, degrees: float):
    """Offsets (north is up, so rows go down) of a ray of ``steps`` cells towards a heading, with the way's length in cells."""
    a = math.radians(degrees)
    return [(-round(k * math.cos(a)), round(k * math.sin(a)), k) for k in range(1, steps + 1)]
