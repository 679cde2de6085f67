from pyspark.sql import functions as F

from airloom.operators import fusion
from airloom.streaming import ingest


def test_late_and_better_data_replace(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "slots")
    put = lambda rows: spark.createDataFrame(rows, ingest.OBSERVATION).coalesce(1).write.mode("append").parquet(str(src))
    put([("NO2", "a", 10, 5.0, 1), ("NO2", "a", 20, 7.0, 1), ("NO2", "b", 10, 1.0, 0)])
    stream = lambda: ingest.slot_stream(ingest.observation_stream(spark, str(src)), out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    stream()
    put([("NO2", "a", 30, 9.0, 1), ("NO2", "b", 90000, 4.0, 0)])
    stream()
    assert {(r.source_id, r.sys_hour): r["value"] for r in ingest.slots(spark, out).collect()} == {("a", 0): 7.0, ("b", 0): 1.0, ("b", 25): 4.0}
    put([("NO2", "a", 40, 2.0, 0)])
    stream()
    assert {(r.source_id, r.sys_hour): r["value"] for r in ingest.slots(spark, out).collect()}[("a", 0)] == 2.0


def test_a_batch_delivered_again_counts_once(spark, tmp_path):
    path, batch = str(tmp_path / "slots"), lambda v, h=0: spark.createDataFrame([("NO2", "a", h * 3600, v, 1)], ingest.OBSERVATION).selectExpr("*", "sec div 3600 as sys_hour")
    now = lambda: {r.sys_hour: (r["value"], r.n) for r in ingest.slots(spark, path).collect()}
    ingest.merge_slots(batch(10.0), path, "q:0")
    ingest.merge_slots(batch(40.0), path, "q:1")
    assert now() == {0: (25.0, 2)}
    ingest.merge_slots(batch(40.0), path, "q:1")
    assert now() == {0: (25.0, 2)}
    ingest.merge_slots(batch(40.0, 30), path, "q:2")
    ingest.merge_slots(batch(70.0), path, "q:3")
    ingest.merge_slots(batch(70.0), path, "q:3")
    assert now() == {0: (40.0, 3), 30: (40.0, 1)}


def test_streamed_learning_equals_the_fold(spark, tmp_path):
    schema = "var string, cat long, sys_hour long, factor double, filled boolean"
    rows = [("NO2", c, h, 0.5 + (h % 7) / 5, False) for c in (0, 1) for h in range(60)]
    part = {r: (r[2] + (2 if r[2] % 10 == 9 else -1 if r[2] % 10 == 3 else 0)) // 30 for r in rows}  # hour 29 comes a batch late
    late = [("NO2", 0, 5, 9.0, False)]
    for k in range(3):
        mine = [r for r in reversed(rows) if part[r] == k] + late * (k == 1)
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = ingest.learned_stream(df, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r.cat: r for r in fusion.learned(spark.createDataFrame([r for r in rows if r[2] <= 56], schema)).collect()}
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        if r.cat not in got or r.k > got[r.cat].k:
            got[r.cat] = r
    for c in (0, 1):
        assert abs(got[c].master - want[c].master) < 1e-12 and got[c].cells == want[c].cells and got[c].last_hour == 56
        assert got[c].late == (1 if c == 0 else 0)


def test_windowed_means(spark, tmp_path):
    spark.createDataFrame([("NO2", "a", 10, 5.0, 0), ("NO2", "a", 20, 7.0, 0), ("NO2", "a", 4 * 3600, 1.0, 0)], ingest.OBSERVATION).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.hourly_means(ingest.accepted_stream(ingest.observation_stream(spark, str(tmp_path / "in")), 0, 300)).writeStream.format("memory").queryName("means").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["value"] for r in spark.sql("select * from means").collect()] == [6.0]
