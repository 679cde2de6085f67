import math
import random

import pytest

from airloom.operators import spatial, terrain, tiles


def grid(seed, n=300):
    rng = random.Random(seed)
    return {(rng.randrange(-20, 30), rng.randrange(-15, 40)): round(rng.uniform(-5, 90), 2) for _ in range(n)}


def frame(spark, cells):
    return spark.createDataFrame([(h, w, v) for (h, w), v in cells.items()], "h long, w long, value double").repartition(3)


@pytest.mark.parametrize("size, radius", [(4, 1), (4, 3), (5, 7), (64, 2)])
def test_windows_do_not_depend_on_tiles(spark, size, radius):
    cells = grid(size)
    weight = lambda dh, dw: 1 / (1 + dh * dh + 2 * dw * dw) if dh + dw < 4 else 0
    want = {}
    for h, w in cells:
        near = [(weight(a - h, b - w), v) for (a, b), v in cells.items() if abs(a - h) <= radius and abs(b - w) <= radius]
        want[h, w] = sum(k * v for k, v in near) / sum(k for k, _ in near)
    got = {(r.h, r.w): r.value for r in tiles.windows(tiles.asked(frame(spark, cells)), radius, tiles.mean(radius, weight), size).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    n = {(r.h, r.w): r.value for r in tiles.windows(tiles.asked(frame(spark, cells)), radius, tiles.count(radius), size).collect()}
    assert n == {c: k for c in cells if (k := sum(abs(a - c[0]) <= radius and abs(b - c[1]) <= radius for a, b in cells) - 1)}


@pytest.mark.parametrize("size, radius", [(3, 5), (16, 4)])
def test_nearest_of_the_given_cells(spark, size, radius):
    cells, given = grid(1), grid(2, 25)
    rows = tiles.empty(frame(spark, cells)).union(frame(spark, given).selectExpr("h", "w", "1.0D", "false"))
    got = {(r.h, r.w): r.value for r in tiles.windows(rows, radius, tiles.distance(radius), size).collect()}
    want = {}
    for h, w in cells:
        near = [math.hypot(a - h, b - w) for a, b in given if abs(a - h) <= radius and abs(b - w) <= radius]
        if near:
            want[h, w] = min(near)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_halo_copies_few_cells(spark):
    cells = spark.range(200 * 200).selectExpr("id div 200 as h", "id % 200 as w", "1.0D as value", "true as asked")
    assert tiles.with_halo(cells, 12, 64).count() < 2.2 * 40000


def test_fill_and_refine(spark):
    cells = {(0, 0): 1.0, (0, 1): 3.0, (5, 5): 9.0}
    spine = {(h, w): None for h in range(3) for w in range(3)}
    got = {(r.h, r.w): r.value for r in spatial.filled_cells(frame(spark, cells), frame(spark, spine), 2).collect()}
    assert set(got) == set(spine) - set(cells) and abs(got[1, 0] - (1 / 2.25 + 3 / 2.25) / (2 / 2.25)) < 1e-12
    fine = {(r.fh, r.fw): r.value for r in spatial.refined(frame(spark, cells), 2).collect()}
    assert len(fine) == 12 and fine[10, 10] == 9.0 and 1 < fine[0, 1] < fine[0, 2] < 3


def test_terrain_across_tiles(spark):
    cells = grid(5, 900)
    df = frame(spark, {k: abs(v) / 50 for k, v in cells.items()})
    small, large = ({(r.h, r.w, r.sector): r.roughness for r in terrain.directed_roughness(df, n).collect()} for n in (7, 64))
    assert len(small) == 36 * len(cells) and all(abs(small[k] - large[k]) < 1e-12 for k in small | large)
    tower = spark.createDataFrame([(h, w, 0.0, 100.0 if (h, w) == (0, 0) else 0.0) for h in range(-30, 31, 3) for w in range(-30, 31, 3)], "h long, w long, ground double, building double")
    seen = {(r.h, r.w, r.sector): r.horizon for r in terrain.horizons(tower, 20.0, 8).collect()}
    south = [k for k, v in seen.items() if k[:2] == (3, 0) and v > 0]
    assert south and {s for _, _, s in south} <= {34, 35, 0, 1} and abs(seen[3, 0, 0] - math.degrees(math.atan(100 / 60))) < 1e-9
    assert all(v == 0 for k, v in seen.items() if k[:2] == (0, 0))
