import random

from airloom.sources import files, layers


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng, want, above = random.Random(3), [], 0
    for k in range(10):
        lines = [f"{k}:{i}:" + "x" * rng.randrange(60) for i in range(rng.choice([1, 5, 40, 200]))]
        (tmp_path / f"f{k}.txt").write_text("\n".join(lines) + "\n" * (k % 2))
        want += [(k, i, above + i, x) for i, x in enumerate(lines)]
        above += len(lines)
    (tmp_path / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = files.numbered_lines(spark, f"file://{tmp_path}").collect()
        assert len({r.file for r in rows}) == 10
        thin = files.sparse_lines(files.numbered_lines(spark, f"file://{tmp_path}"), 100).select("path", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file, r.line, r.row, r.value) for r in rows) == sorted(want)
    long = {k for k, i, *_ in want if i == 199}
    assert len(thin) == sum(i % 4 == 3 if k in long else True for k, i, *_ in want)


def test_configuration_over_ten_files(spark, tmp_path):
    for k in range(10):
        (tmp_path / f"part{k}.csv").write_text("name;level\n" + "".join(f'"v{k};{i}";{i / 2}\n' for i in range(k)))
    rows = files.configuration(spark, f"file://{tmp_path}", ["level"]).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(n, f"v{k};{i}", i / 2) for n, (k, i) in enumerate((k, i) for k in range(10) for i in range(k))]


def test_runs_and_gaps(spark):
    rng = random.Random(4)
    have = {(s, 6 * rng.randrange(20), rng.randrange(8)) for s in "ab" for _ in range(25)}
    df = spark.createDataFrame([(*f, 6) for f in have], "source string, run_hour long, chunk long, hours int")
    got = {(r.source, r.hour): (r.run_hour, r.chunk) for r in layers.newest_runs(df, 10, 90).collect()}
    want = {(s, h): max((run, c) for a, run, c in have if a == s and run + 6 * c <= h < run + 6 * c + 6) for s in "ab" for h in range(10, 91) if any(a == s and run + 6 * c <= h < run + 6 * c + 6 for a, run, c in have)}
    assert got == want
    gaps = {(r.source, h) for r in layers.uncovered(layers.newest_runs(df, 10, 90), 10, 90).collect() for h in range(r.from_hour, r.to_hour + 1)}
    assert gaps == {(s, h) for s in "ab" for h in range(10, 91)} - set(want)
    lost = {tuple(r) for r in layers.missing_chunks(df).collect()}
    assert lost == {(s, r, c) for s, r, _ in have for c in range(8)} - have


def test_layers_with_gaps(spark):
    head = "grid_id long, var string, run_hour long, valid_hour long, latmin double, latmax double, lonmin double, lonmax double, n_rows int, n_columns int, scale double, offset double"
    row = lambda i, v, run, hour, lat: (i, v, run, hour, lat, lat + 0.2, 24.0, 24.2, 1, 2, 2.0, 1.0)
    heads = spark.createDataFrame([row(1, "a", 0, 6, 60.0), row(2, "a", 3, 6, 60.0), row(3, "a", 6, 9, 60.3), row(4, "a", 5, 12, 70.0), row(5, "b", 0, 6, 70.0)], head)
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 7.0), (2, 0, 0, None), (2, 0, 1, 9.0), (3, 0, 0, 11.0), (3, 0, 1, 13.0), (4, 0, 0, 1.0), (5, 0, 0, float("nan")), (5, 0, 1, 2.0)], "grid_id long, h long, w long, value double")
    box = (60.0, 60.1, 24.0, 24.2)
    chosen = layers.layers(heads, cells, box)
    assert {(r.var, r.valid_hour): (r.grid_id, r.maturity) for r in chosen.collect()} == {("a", 6): (1, 6), ("a", 9): (3, 3), ("b", 6): (5, 100)}
    rows = {(r.var, r.valid_hour, r.w): (round(r.value, 6), r.filled) for r in layers.hourly_cells(chosen, cells, box).collect()}
    assert rows == {("a", 6, 0): (11, False), ("a", 6, 1): (15, False), ("a", 9, 0): (23, False), ("a", 9, 1): (27, False), ("a", 7, 0): (15, True), ("a", 7, 1): (19, True), ("a", 8, 0): (19, True), ("a", 8, 1): (23, True), ("b", 6, 0): (0, False), ("b", 6, 1): (5, False)}


def test_point_lists_of_unequal_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [60.0, 60.1, 80.0, 60.2], [24.0, 24.1, 24.2, 24.3], [1.0, -999.0, 3.0], 2.0, 1.0), (2, [], [], [], [], 1.0, 0.0)], "list_id long, hours array<long>, lats array<double>, lons array<double>, values array<double>, scale double, offset double")
    assert [tuple(r) for r in layers.point_lists(df, (59.0, 61.0, 23.0, 25.0), -999.0).collect()] == [(1, 0, 1, 60.0, 24.0, 3.0)]
