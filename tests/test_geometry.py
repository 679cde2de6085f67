import math
import random
import re

from airloom.operators import geometry as g
from airloom.sources import map_tables, store


def passed(r, ends):
    a, b = ends[r.way_id]
    return (b, a) if r.back else (a, b)


def test_chains(spark):
    rng, ends = random.Random(2), {}

    def add(way, a, b):
        ends[way] = (b, a) if rng.random() < 0.5 else (a, b)

    ids = rng.sample(range(1000, 9999), 300)
    for i in range(150):  # a long ring
        add(ids[i], i, (i + 1) % 150)
    for i in range(60):  # an open chain
        add(ids[150 + i], 1000 + i, 1001 + i)
    for k in range(2):  # two triangles that meet at a node
        for i in range(3):
            add(ids[210 + 3 * k + i], 2000 + (0 if i == 0 else 10 * k + i), 2000 + (0 if i == 2 else 10 * k + i + 1))
    add(ids[220], 3000, 3001)
    add(ids[221], 3001, 3000)
    ends[ids[222]] = (4000, 4000)
    add(ids[223], 5000, 5001)
    df = spark.createDataFrame([(1, w, a, b) for w, (a, b) in ends.items()] + [(2, 1, 0, 1)], "rel long, way_id long, a long, b long")
    rows = g.chains(df, ["rel"]).collect()
    assert len(rows) == len(ends) + 1 and len({(r.rel, r.way_id) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        if r.rel == 1:
            by.setdefault(r.chain, []).append(r)
    for chain, own in by.items():
        own.sort(key=lambda r: r.at)
        assert [r.at for r in own] == list(range(own[0].n)) and chain == min(r.way_id for r in own)
        way = [passed(r, ends) for r in own]
        assert all(x[1] == y[0] for x, y in zip(way, way[1:]))
        assert own[0].closed == (way[-1][1] == way[0][0])
        if own[0].closed:
            assert own[0].way_id == chain and not own[0].back
    sizes = sorted((v[0].n, v[0].closed) for v in by.values())
    assert sizes[:3] == [(1, False), (1, True), (2, True)] and sizes[-2:] == [(60, False), (150, True)] and sum(n for n, _ in sizes) == len(ends)
    assert all(closed for n, closed in sizes if n in (3, 6))


def test_measures(spark):
    nodes = spark.createDataFrame([(1, 60.0, 25.0), (2, 60.0, 25.01), (3, 60.01, 25.01), (4, 60.01, 25.0)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [4, 3, 2, 1]), (3, [1, 2]), (4, [1]), (5, []), (6, [1, 99, 2, 3]), (7, [1, 2, 3, 4, 1])], "way_id long, nodes array<long>")
    rows = {r.way_id: r for r in g.located(ways, nodes).select("way_id", "n_missing", g.area_m2(g.F.col("points")).alias("area"), g.length_m(g.F.col("points")).alias("length"), g.length_m(g.F.col("points"), True).alias("around")).collect()}
    side = 0.01 * g.DEGREE_M
    square = side * side * math.cos(math.radians(60.0))
    assert abs(rows[1].area - square) < 1e-3 and abs(rows[2].area / square - math.cos(math.radians(60.01)) / math.cos(math.radians(60.0))) < 1e-9 and abs(rows[7].area - square) < 1e-3
    assert rows[3].area == rows[4].area == rows[5].area == 0 and rows[5].length == rows[4].length == 0
    assert rows[6].n_missing == 1 and rows[6].area > 0 and rows[1].n_missing == 0
    assert abs(rows[1].around - (2 * side + side * (math.cos(math.radians(60.0)) + math.cos(math.radians(60.01))))) < 1e-6
    assert abs(rows[7].length - rows[1].around) < 1e-6


def test_no_ways(spark):
    assert g.chains(spark.createDataFrame([], "rel long, way_id long, a long, b long"), ["rel"]).count() == 0


def test_chains_of_groups_and_of_all_tasks_agree(spark):
    """Joined in one task or contracted, with nodes where many ways end; further columns and groups of null come along."""
    rng, rows = random.Random(5), []
    for rel in [None, *range(40)]:
        for way in rng.sample(range(1000), rng.choice([1, 2, 7, 30, 90])):
            rows.append((rel, "outer" if way % 3 else None, way, rng.randrange(40), rng.randrange(40), None if way % 5 else way / 7))
    df = spark.createDataFrame(rows, "rel long, role string, way_id long, a long, b long, more double")
    found = {most: sorted(map(repr, g.chains(df, ["rel", "role"], most).collect())) for most in (10_000, 20, 0)}
    assert len(found[0]) == len(rows) and found[0] == found[20] == found[10_000]


def test_chains_of_small_groups_need_no_turns(spark, monkeypatch):
    """One table of sizes is written, however long the chains are."""
    df = spark.createDataFrame([(rel, 100 * rel + i, i, (i + 1) % 64) for rel in range(4) for i in range(64)], "rel long, way_id long, a long, b long")
    tables = []
    monkeypatch.setattr(g, "written", lambda x, keep=g.written: tables.append(x) or keep(x))
    assert {(r.n, r.closed, r.at == r.way_id % 100) for r in g.chains(df, ["rel"]).collect()} == {(64, True, True)} and len(tables) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_measured_by_rows(spark, monkeypatch):
    """The same measures as by arrays; partitions follow the number of nodes, and no array of points is made."""
    monkeypatch.setattr(store, "PART_ROWS", 10)
    rng = random.Random(7)
    nodes = spark.createDataFrame([(i, 60 + rng.random() / 50, 25 + rng.random() / 50) for i in range(40)] + [(40, None, 25.0)], "node_id long, lat double, lon double")
    lines = [[rng.randrange(44) for _ in range(rng.choice([1, 2, 3, 8]))] for _ in range(60)] + [[], [42, 43], [5, 5], None]
    ways = spark.createDataFrame(list(enumerate(lines)), "way_id long, nodes array<long>")
    found = g.measured(ways, nodes, 300)
    p = g.F.col("points")
    low, last = g.F.get(p, 0), g.F.get(p, g.F.size(p) - 1)
    want = {r.way_id: r for r in g.located(ways, nodes).select("way_id", low["lat"].alias("low"), (last["lon"] - low["lon"]).alias("dx"), g.strip(p, False).alias("strip"), g.length_m(p).alias("length_m"), g.area_m2(p).alias("area_m2"), g.length_m(p, True).alias("around_m"), "n_missing").collect()}
    rows = found.collect()
    assert sorted(r.way_id for r in rows) == sorted(want)
    for r in rows:
        for k in ("low", "dx", "strip", "length_m", "area_m2", "around_m", "n_missing"):
            x, y = r[k], want[r.way_id][k]
            assert x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9 if k != "area_m2" else 1e-3)), (k, r, want[r.way_id])
    text = plan(found)
    assert "collect_list" not in text and re.search(r"hashpartitioning\(way_id#\d+L, 30\)", text)


def test_map_tables_move_lines_once(spark):
    """Orders by relation and by way, lines by way: three shuffles a table."""
    for table in (map_tables.nodes, map_tables.ways):
        text = plan(table(spark, "/root/testdata/sf0.01"))
        assert text.count("Exchange hashpartitioning") == 3 and "Broadcast" not in text, text


def test_walks_that_end_where_a_stride_does():
    """The least of an open walk counts its last place, however long the walk is."""
    for n in range(1, 40):
        last, count, least = g.followed(g.np.array([*range(1, n), -1]), g.np.arange(n)[::-1])
        assert last.tolist() == [n - 1] * n and count.tolist() == list(range(n))[::-1] and least.tolist() == [0] * n
