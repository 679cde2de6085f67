import datetime as dt

import pytest
from pyspark.sql import functions as F

from airloom.functions import text
from airloom.plans import extensions
from airloom.sources import files, sinks


def test_file_times_and_pruning(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    for n, body in (("feed_60.1_60.3_24.5_25.0_2024-01-05T06-00-00Z.csv", "x"), ("feed_2024-02-05T06-00-00Z.csv", "x"), ("feed_2024-01-05T07-00-00Z.csv", "")):
        (tmp_path / "2024" / n).write_text(body)
    got = files.pruned(spark, str(tmp_path), "2024-01-05 10:00:00", "2024-01-06 00:00:00", 6)
    assert [p.rsplit("/", 1)[1] for p in got] == ["feed_60.1_60.3_24.5_25.0_2024-01-05T06-00-00Z.csv"]
    box = spark.range(1).select(files.name_box(F.lit("feed_60.1_60.3_24.5_25.0_x.csv")).alias("b")).first().b
    assert tuple(box) == (60.1, 60.3, 24.5, 25.0)


def test_long_and_wide_observations(spark, tmp_path):
    (tmp_path / "long.csv").write_text("60.1;24.9;st 1;2024-01-05T06:00:00;NO2;12.5\nbad line\n60.1;24.9;st 1;nonsense;NO2;1\n60.1;24.9;st 1;2024-01-05 07:00;NO2;x\n")
    rows = files.long_observations(spark, [str(tmp_path / "long.csv")], scale=2.0).collect()
    assert [(r.var, r.source_id, r.value, r.ts) for r in rows] == [("NO2", "st_1", 25.0, dt.datetime(2024, 1, 5, 6))]
    (tmp_path / "wide.csv").write_text("id;time;NO2;O3;other\na;2024-01-05 06:00;1;2;9\na;2024-01-05 07:00;;3;9\n")
    rows = files.wide_observations(spark, str(tmp_path / "wide.csv"), "id", "time", ["NO2", "O3", "CO"]).collect()
    assert sorted((r["var"], r["value"]) for r in rows) == [("NO2", 1.0), ("O3", 2.0), ("O3", 3.0)]


def test_open_data_and_ways(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r>" + "".join(f"<BsWfsElement><Location>60.1 24.9</Location><Time>2024-01-05T06:00:00</Time><ParameterName>NO2</ParameterName><ParameterValue>{v}</ParameterValue></BsWfsElement>" for v in ("7.5", "NaN")) + "</r>")
    rows = files.open_data(spark, str(tmp_path / "a.xml")).collect()
    assert [(r["var"], r["value"], r["source_id"]) for r in rows] == [("NO2", 7.5, "ID_60.1000_24.9000")]
    (tmp_path / "b.xml").write_text('<osm><way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="6"><nd ref="3"/></way></osm>')
    rows = {r.way_id: r for r in files.ways(spark, str(tmp_path / "b.xml")).collect()}
    assert rows[5].nodes == [1, 2] and rows[5].tags == {"highway": "primary"} and rows[6].tags == {}


def test_stations_and_maintenance(spark, tmp_path):
    (tmp_path / "db.csv").write_text("S1;60.1;24.9;2;5;2,3;NO2=1.1,O3=0.9;A1;A2;30deg50m;true;CO,SO2;false;PM10=4;x;\n")
    s = files.stations(spark, str(tmp_path / "db.csv")).first()
    assert (s.source_id, s.tz, s.tz_summer, s.scalers["O3"], s.banned, s.auto_offset, s.type_imprecision["PM10"]) == ("S1", 2, 3, 0.9, ["CO", "SO2"], True, 4.0)
    line = '{"id": "r1", "event": "2", "time": "2024-01-05T06:00:00", "lon": 24.9, "lat": 60.1}\n'
    (tmp_path / "m.json").write_text(line * 2)
    rows = files.maintenance(spark, str(tmp_path / "m.json"))
    assert [(r.id, r.action) for r in rows.collect()] == [("r1", "salt")]
    assert files.maintenance(spark, str(tmp_path / "m.json"), rows).count() == 0


def test_units(spark):
    rows = spark.createDataFrame([(1.0, "mg", "NO2"), (1.0, "mole", "O3"), (1.0, "?", "O3")], "v double, u string, s string").select(files.to_micrograms(F.col("v"), F.col("u"), F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == [1000.0, pytest.approx(47998200.0), None]


def test_affine_expressions():
    e = text.affine("AFFINE<0.5*A + -2*B>,A_MIN<1>")
    assert e.variables == ["A", "B"]
    assert extensions.expression("NEURAL<x>") is None
    with pytest.raises(ValueError):
        text.affine("AFFINE<3+0.5*A>")
    need, kept = extensions.closed_over(["PM10"], {"PM10": text.affine("AFFINE<1*C+1*PM25>"), "X": text.affine("AFFINE<1*C>")})
    assert need == {"PM10", "C", "PM25"} and set(kept) == {"PM10"}
    assert extensions.fusion_order(["NO2", "O3", "CO"])[0] == "O3"


def test_archive_replaces_partitions(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(24, "NO2", v), (25, "NO2", v)], "sys_hour long, var string, value double")
    sinks.archive(rows(1.0), str(tmp_path / "a"))
    sinks.archive(rows(2.0).filter("sys_hour = 24"), str(tmp_path / "a"))
    sinks.archive(spark.createDataFrame([(48, "NO2", 3.0)], "sys_hour long, var string, value double"), str(tmp_path / "a"))
    assert sorted((r.sys_hour, r["value"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [(24, 2.0), (48, 3.0)]
    state = spark.createDataFrame([("NO2", 1.0)], "var string, master double")
    for h in (24 * 10, 24 * 12):
        sinks.saved_state(state, str(tmp_path / "s"), h)
    assert sinks.loaded_state(spark, str(tmp_path / "s"), 11).first().snapshot_day == 10
