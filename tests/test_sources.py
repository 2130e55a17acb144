import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trailweave.sources import files, sinks
from trailweave.streaming.sessions import gap_sessions, hourly_counts, pair_streams


def test_points_from_csv(spark, tmp_path):
    p = tmp_path / "points-20201221.csv"
    p.write_text("source_row,BICYCLE_ID,LOCATING_TIME,LATITUDE,LONGITUDE\n1,a, 06:00:01,24.5,118.1\n2,, 06:00:09,24.5,118.2\n")
    found = files.resolve_inputs(tmp_path, [date(2020, 12, 21)])
    rows = files.read_points(spark, str(found[date(2020, 12, 21)]), date(2020, 12, 21)).collect()
    assert [(r.entity, r.ts) for r in rows] == [("a", datetime(2020, 12, 21, 6, 0, 1)), (None, datetime(2020, 12, 21, 6, 0, 9))]
    with pytest.raises(files.InputError, match="2020-12-22"):
        files.resolve_inputs(tmp_path, [date(2020, 12, 21), date(2020, 12, 22)])
    (tmp_path / "bad-20201222.csv").write_text("a,b\n")
    with pytest.raises(files.InputError, match="header"):
        files.resolve_inputs(tmp_path, [date(2020, 12, 22)])


def test_lock_events(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("source_row,BICYCLE_ID,LATITUDE,LONGITUDE,LOCK_STATUS,UPDATE_TIME1,UPDATE_TIME2,ORDER DURATION\n1,a,1.0,2.0,0,2020-12-21, 06:00:01,\n2,,1.0,2.0,1,2020-12-21, 06:10:01,600\n")
    assert files.resolve_single(tmp_path) == p
    assert [r.status for r in files.read_lock_events(spark, str(p)).collect()] == [0, 1]


def test_dated_tables(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 12, d), i) for d in (21, 22, 23) for i in range(3)], "source_date date, v int")
    path = str(tmp_path / "t")
    sinks.write_by(df, path, ["source_date", "v"], sort=["v"])
    assert files.read_dated(spark, path, [date(2020, 12, 22)]).count() == 3
    pruned = files.read_dated(spark, path, [date(2020, 12, 22)], schema=df.schema)
    assert pruned.count() == 3 and "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString()
    sinks.write_by(df.where("v = 0 and source_date = date'2020-12-21'"), path, ["source_date", "v"], overwrite=True)
    assert spark.read.parquet(path).count() == 7  # only that day was replaced
    with pytest.raises(files.InputError, match="already"):
        sinks.refuse_existing(spark, [path, str(tmp_path / "none")])
    sinks.write_sorted(df, str(tmp_path / "s"), [F.desc("v"), "source_date"])
    assert [r.v for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [2, 2, 2, 1, 1, 1, 0, 0, 0]
    assert files.read_subset(spark, path, ["v"]).columns == ["v"]
    with pytest.raises(files.InputError):
        files.read_subset(spark, path, ["w"])


def test_release(spark, tmp_path):
    root = str(tmp_path / "r")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = sinks.publish(spark, {"t": t}, {"t": ["k"]}, root)
    assert sinks.publish(spark, {"t": t.repartition(3)}, {"t": ["k"]}, root) == first == sinks.current_release(spark, root)
    second = sinks.publish(spark, {"t": t.where("k = 1")}, {"t": ["k"]}, root)
    assert second != first and sinks.current_release(spark, root) == second
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("next")]
    with pytest.raises(files.InputError, match="repeated key"):
        sinks.publish(spark, {"t": t.union(t)}, {"t": ["k"]}, root)
    assert sinks.check_release({"t": t.withColumn("k", F.lit(None).cast("int"))}, {"t": ["k"]}) == ["t: null in the key", "t: repeated key"]


def test_small_files(tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}]}))
    assert files.read_rings(p) == [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    p.write_text(json.dumps({"type": "Point", "coordinates": [0, 0]}))
    with pytest.raises(files.InputError):
        files.read_rings(p)
    sinks.write_json(tmp_path / "l.json", {"region_cells_digest": "x", "labels": {"1": "North"}})
    assert files.read_labels(tmp_path / "l.json", "x") == {1: "North"}
    with pytest.raises(files.InputError):
        files.read_labels(tmp_path / "l.json", "y")


def drain(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = lambda h, m=0, d=1: datetime(2024, 1, d, h, m)
    rows = [("a", t(0), "x"), ("a", t(1), "y"), ("a", t(9), "x"), ("b", t(2), "x"), ("z", t(0, 0, 5), "x")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "u string, ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = lambda: spark.readStream.schema("u string, ts timestamp, k string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert sorted((r.u, r.points) for r in drain(gap_sessions(src(), "u", "ts"), spark, "s1")) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.hour.hour, r.k, r.n) for r in drain(hourly_counts(src(), "ts", "k"), spark, "s2")) == [(0, "x", 1), (1, "y", 1), (2, "x", 1), (9, "x", 1)]
    pairs = drain(pair_streams(src().where("k = 'x'"), src().where("k = 'y'"), "u", "ts"), spark, "s3")
    assert [(r.entity, r.open_ts.hour, r.close_ts.hour) for r in pairs] == [("a", 0, 1)]


def test_every_session_of_a_stream(spark, tmp_path):
    from trailweave.streaming.sessions import all_sessions

    t = lambda h, d=1: datetime(2024, 1, d, h)
    schema, folder = "u string, ts timestamp", str(tmp_path / "in")
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    spark.createDataFrame([("a", t(0)), ("a", t(5)), ("a", t(12)), ("b", t(1)), ("c", t(0, 5))], schema).coalesce(1).write.parquet(folder + "/0")
    got = lambda: sorted((r.u, r.start_time, r.end_time, r.points) for r in all_sessions(src(), "u", "ts", str(tmp_path / "out")).collect())
    first = [("a", t(0), t(11), 2), ("a", t(12), t(18), 1), ("b", t(1), t(7), 1), ("c", t(0, 5), t(6, 5), 1)]
    assert got() == first and got() == first  # nothing new, nothing twice
    # Out of order but within the watermark: joined; later than it: dropped by the stream.
    spark.createDataFrame([("c", t(3, 5)), ("c", t(22, 4)), ("b", t(2))], schema).coalesce(1).write.parquet(folder + "/1")
    assert got() == [*first[:3], ("c", t(22, 4), t(9, 5), 3)]
