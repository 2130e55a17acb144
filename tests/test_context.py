"""Overlays, road names, serving, gates and contrasts on small inputs worked by hand or by a plain version."""

import json
import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import contrast, gates, labels, overlay, serving, spatial, trajectory

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


def ring(*points):
    return np.array([*points, points[0]], float)


def test_covered_area():
    box = ((0.0, 0.0), (10.0, 10.0))
    area = lambda *features: overlay.covered_area(list(features), *box)
    triangle, other = [ring((2, 2), (8, 2), (2, 8))], [ring((2, 2), (8, 2), (8, 8))]
    assert area(triangle) == pytest.approx(18) and area(triangle, triangle) == pytest.approx(18)
    assert area(triangle, other) == pytest.approx(27)  # they share the triangle under both diagonals
    assert area([ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))]) == pytest.approx(96)  # a hole
    assert area([ring((-5, -5), (5, -5), (5, 5), (-5, 5))]) == pytest.approx(25) and area([ring((-50, -50), (50, -50), (50, 50), (-50, 50))]) == pytest.approx(100)
    assert area([ring((20, 20), (30, 20), (30, 30))]) == 0 and area() == 0
    rng = random.Random(3)
    at = (np.arange(1000) + 0.5) / 100
    x, y = (v.ravel() for v in np.meshgrid(at, at))
    for _ in range(5):
        shapes = [[ring(*[(rng.uniform(-3, 13), rng.uniform(-3, 13)) for _ in range(rng.randrange(3, 7))])] for _ in range(3)]
        inside = np.zeros(len(x), bool)
        for (r,) in shapes:
            inside |= spatial.ring_distance(x, y, r)[0]
        assert area(*shapes) == pytest.approx(inside.mean() * 100, abs=0.3)


FEATURE = "feature_id long, category string, rings array<array<struct<x:double,y:double>>>"


def test_composition(spark):
    square = lambda x, y, n: [[(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]]
    features = spark.createDataFrame([(1, "home", square(0.0, 0.0, 15.0)), (2, "home", square(5.0, 0.0, 10.0)), (3, "work", square(15.0, 0.0, 5.0)), (4, "sea", square(0.0, 0.0, 99.0)), (5, None, square(0.0, 0.0, 9.0)), (6, "work", square(500.0, 500.0, 5.0)), (7, "home", square(-10.0, 0.0, 10.0))], FEATURE)
    points = spark.createDataFrame([("home", 1.0, 1.0), ("bus_stop", 2.0, 2.0), ("work", 12.0, 2.0), ("home", 900.0, 1.0), ("sea", 1.0, 1.0)], "category string, x double, y double")
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (9, 9, 2)], "cell_x int, cell_y int, region int")
    got = {r.region: r for r in overlay.composition(features, points, cells, 10.0, ["home", "work"]).collect()}
    a = got[1]
    assert (a.area_home, a.area_work, a.classified_area) == (pytest.approx(150), pytest.approx(25), pytest.approx(175))
    assert a.share_home == pytest.approx(150 / 175) and a.share_work + a.share_home == pytest.approx(1) and a.classified_share == pytest.approx(175 / 200)
    assert (a.poi_home, a.poi_work, a.poi_total, a.stops) == (1, 1, 2, 1) and a.stops_per_km2 == pytest.approx(1 / 200e-6)
    b = got[2]
    assert (b.area_home, b.share_home, b.classified_share, b.poi_total, b.stops) == (0, None, 0, 0, 0)
    # The square that only touches the first cell meets it; the far one meets none.
    assert sorted(r.feature_id for r in overlay.features_meeting(features.where("category is not null"), cells, 10.0).collect()) == [1, 2, 3, 4, 7]
    assert overlay.composition(features.limit(0), points.limit(0), cells, 10.0, ["home"]).count() == 2


def test_way_features(spark):
    from trailweave.operators.network import classify

    ways = spark.createDataFrame([(1, {"landuse": "home"}, [1, 2, 3, 1]), (2, {"landuse": "home"}, [1, 2, 3]), (3, {"landuse": "home"}, [1, 2, 99, 1]), (4, {}, [1, 2, 3, 1])], "osmid long, tags map<string,string>, refs array<long>")
    nodes = spark.createDataFrame([(1, {}, 0.0, 0.0), (2, {"amenity": "school"}, 3.0, 0.0), (3, {}, 0.0, 4.0)], "id long, tags map<string,string>, x double, y double")
    rules = [("home", [("landuse", ["home"])]), ("school", [("amenity", ["school"])])]
    areas, points = overlay.way_features(ways, nodes, lambda t: classify(t, rules))
    assert [(r.feature_id, r.category, [(p.x, p.y) for p in r.rings[0]]) for r in areas.collect()] == [(1, "home", [(0, 0), (3, 0), (0, 4), (0, 0)])]
    assert [(r.feature_id, r.category, r.matched, r.x) for r in points.collect()] == [(2, "school", "amenity=school", 3.0)]


def test_polygons_in_columns(spark):
    far = [[(100.0, 0.0), (110.0, 0.0), (110.0, 10.0), (100.0, 10.0), (100.0, 0.0)]]
    bay = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0), (0.0, 0.0)]]
    pts = [(1, 5.0, 5.0), (2, 55.0, 5.0), (3, 56.0, 5.0), (4, None, 1.0), (5, 105.0, 5.0)]
    f = spatial.nearest_polygon([(9, far), (2, [SQUARE])])
    assert [r.r for r in spark.createDataFrame(pts, "i int, x double, y double").orderBy("i").select(f("x", "y").alias("r")).collect()] == [2, 2, 9, None, 9]
    paths = [(1, [1.0, 9.0], [1.0, 1.0]), (2, [1.0, 9.0], [7.0, 7.0]), (3, [1.0, 11.0], [1.0, 1.0]), (4, None, None), (5, [101.0, 109.0], [1.0, 9.0])]
    df = spark.createDataFrame(paths, "i int, xs array<double>, ys array<double>").orderBy("i")
    ask = lambda polygons, tolerance=0.0: [r.v for r in df.select(spatial.path_inside(polygons, tolerance)("xs", "ys").alias("v")).collect()]
    assert ask([bay]) == [True, False, False, None, False] and ask([bay, far]) == [True, False, False, None, True]
    assert ask([[SQUARE]], 1.5) == [True, True, True, None, False]
    assert ask([[SQUARE, [(4.0, 0.5), (6.0, 0.5), (6.0, 2.0), (4.0, 2.0), (4.0, 0.5)]]]) == [False, True, False, None, False]
    legs = spark.createDataFrame([(-5.0, 5.0, 15.0, 5.0), (-5.0, -5.0, -1.0, 20.0), (10.0, 12.0, 12.0, 10.0), (2.0, 2.0, 3.0, 3.0), (10.0, 10.0, 20.0, 20.0)], "a double, b double, c double, d double")
    assert [r.v for r in legs.select(spatial.meets_polygon([SQUARE])("a", "b", "c", "d").alias("v")).collect()] == [True, False, False, True, True]


def test_road_names(spark):
    weights = spark.createDataFrame([(1, "Main", 0, 5.0), (1, "Main", 0, 5.0), (1, "Side", 0, 9.0), (1, "Lane", 1, 99.0), (1, "", 0, 500.0), (2, "Road", 0, 9.0), (2, "\u8def", 3, 1.0), (3, "A", 2, 1.0), (3, "A", 0, 1.0), (3, "B", 1, 1.0)], "region int, name string, rank int, weight double")
    assert {r.region: r.names for r in labels.dominant_names(weights, ["region"]).collect()} == {1: ["Main", "Side"], 2: ["\u8def", ""], 3: ["A", "B"]}
    segments = spark.createDataFrame([(1, "path", "P", 10.0, [(0.0, 0.0), (10.0, 0.0)]), (2, "primary", "Q", 20.0, [(0.0, 5.0), (4.0, 5.0), (4.0, 21.0)]), (3, "other", None, 9.0, [(0.0, 0.0), (9.0, 0.0)]), (4, "odd", "R", 99.0, [(0.0, 1.0), (9.0, 1.0)])], "segment_id long, highway string, name string, length_m double, line array<struct<x:double,y:double>>")
    assert {r.segment_id: (r.mid_x, r.mid_y) for r in labels.midpoints(segments).collect()}[2] == (4.0, 11.0)
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "cell_x int, cell_y int, region int")
    assert {r.region: r.names for r in labels.road_names(segments, cells, 10.0, ["primary", "path"]).collect()} == {1: ["P", "R"], 2: ["Q", ""]}


def at(s):
    return datetime(2020, 12, 21, 6, s // 60, s % 60)


def test_tracks_in_a_region_and_their_paths(spark):
    pts = spark.createDataFrame([(1, at(0), 0.0, 5.0), (1, at(100), 100.0, 5.0), (2, at(0), 0.0, 50.0), (2, at(100), 100.0, 50.0), (3, at(0), 5.0, -100.0), (3, at(100), 5.0, 100.0)], "k int, ts timestamp_ntz, x double, y double")
    stamp = lambda s: F.lit(str(at(s))).cast("timestamp_ntz")
    ask = lambda a, b, **more: serving.tracks_in_region(pts, ["k"], [SQUARE], stamp(a), stamp(b), **more)
    total, rows = ask(0, 100)
    assert total.first()[0] == 2 and [r.k for r in rows.collect()] == [1, 3]
    assert ask(20, 100)[0].first()[0] == 1 and ask(0, 100, longest_s=200.0)[0].first()[0] == 2 and [r.k for r in ask(0, 100, limit=1)[1].collect()] == [1]
    paths = {r.k: [(p.x, p.y) for p in r.path] for r in serving.windowed_paths(pts, rows, ["k"], stamp(10), stamp(60)).collect()}
    assert paths == {1: [(10, 5), (60, 5)], 3: [(5, -80), (5, 20)]}
    serving.check_selection(3, None)
    for bad in ((None, None), (3, (0, 0, 1, 1)), (None, (1, 0, 0, 1))):
        with pytest.raises(serving.RequestError):
            serving.check_selection(*bad)
    total, rows = serving.merge_samples([("b", *ask(0, 100)), ("a", *ask(0, 100))], ["k"], 3)
    assert total.first()["total"] == 4 and [(r.day, r.k) for r in rows.collect()] == [("a", 1), ("a", 3), ("b", 1)]


def test_sequences_regions_and_requests(spark):
    pats = spark.createDataFrame([("d", [1, 2], 9, True), ("d", [1, 2, 3], 9, True), ("d", [4, 5], 50, False), ("d", [2, 1], 3, True), ("e", [1, 2], 9, True)], "scope string, pattern array<int>, contiguous int, all_steps_adjacent boolean")
    scan = spark.createDataFrame([("d", 0.01, 5), ("d", 0.1, 60), ("d", 0.5, 1), ("d", 0.5, 1)], "scope string, min_support double, min_support_count int")
    ask = lambda level, limit=20: [r.pattern for r in serving.top_sequences(pats, scan, "d", level, limit).collect()]
    assert ask(0.01) == [[1, 2, 3], [1, 2]] and ask(0.01, 1) == [[1, 2, 3]] and ask(0.1) == []
    for bad in (0.2, 0.5):
        with pytest.raises(serving.RequestError):
            ask(bad)
    metrics = spark.createDataFrame([(1, "b", 6, 5), (1, "a", 7, 4), (1, "a", 6, 3)], "region int, day string, hour int, n int")
    rows = serving.regions_payload(spark.createDataFrame([(2, "y"), (1, "x")], "region int, code string"), metrics).collect()
    assert [(r.region, r.code, [m.n for m in r.metrics]) for r in rows] == [(1, "x", [3, 4, 5]), (2, "y", [])]
    days = ["2020-12-21", "2020-12-22", "2020-12-23"]
    assert serving.flow_requests(days, days[:2], "clear-days", True, 6, 8) == [("stable", 6), ("stable", 7)]
    assert serving.flow_requests(days, days[:2], "clear-days", False, 6, 7) == [(days[0], 6), (days[1], 6)]
    assert serving.flow_requests(days, days[:2], "2020-12-22..2020-12-24", False, 9, 10) == [(days[1], 9), (days[2], 9)]


def test_gates(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "a"), (4, None)], "source_row int, entity string")
    assert "row 3" in gates.first_row_problem(rows) and gates.first_row_problem(rows.where("source_row > 2")) is None and gates.first_row_problem(rows.where("source_row < 3")) == "no row names anybody" and gates.first_row_problem(rows.limit(0)) is None
    (tmp_path / "t" / "source_date=2020-12-21").mkdir(parents=True)
    assert gates.missing_days(spark, str(tmp_path), ["t", "u"], [date(2020, 12, 21)]) == ["u: nothing of 2020-12-21"]
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("1"), b.write_text("2")
    gates.write_lock(tmp_path / "lock", {"a": a, "b": b})
    assert gates.lock_problems(tmp_path / "lock", {"a": a, "b": b}) == [] and gates.lock_problems(tmp_path / "none", {})[0].startswith("no lock")
    a.write_text("x")
    assert gates.lock_problems(tmp_path / "lock", {"a": a, "b": tmp_path / "gone", "c": b}) == ["c: not frozen", "a: other bytes than frozen", "b: no file"]
    actual = spark.createDataFrame([("d", 10, 5), ("e", 1, None), ("f", 1, 1)], "day string, points int, tracks int")
    base = spark.createDataFrame([("d", 11, 2, 5), ("e", 3, 1, 7), ("g", 1, 0, 1)], "day string, points int, points_tolerance int, tracks int")
    off = sorted((r.day, r.field, r.expected, r.actual) for r in gates.baseline_differences(actual, base, ["day"], ["points", "tracks"]).collect() if r.day in "de")
    assert off == [("e", "points", 3, 1)]
    assert sorted((r.day, r.field) for r in gates.baseline_differences(actual, base, ["day"], ["points", "tracks"]).collect() if r.day in "fg") == [("f", "points"), ("f", "tracks"), ("g", "points"), ("g", "tracks")]
    regions = spark.createDataFrame([(1, 2), (2, 1)], "region int, cells int")
    metrics = spark.createDataFrame([(1,), (1,), (2,), (3,)], "region int")
    assert gates.density_problems(metrics, regions, 2) == ["region 2: 1 rows instead of 2", "region 3 is not known"]
    assert gates.member_problems(regions, metrics, "region", "cells") == [] and gates.member_problems(regions, metrics.where("region = 1"), "region", "cells") == ["region 2: 1 recorded, 0 found"]
    manifest = spark.createDataFrame([("a", 1), ("z", 2)], "id string, points int")
    assert gates.sample_problems(rows, manifest) == ["z: 0 points instead of 2"] and gates.sample_problems(rows, manifest.where("id = 'a'"), total=2) == ["1 points in all instead of 2"]
    assert gates.same_keys(regions, regions.orderBy("cells"), ["region"]) and not gates.same_keys(regions, regions.union(regions), ["region"])
    assert gates.one_to_one(regions, regions.select("region"), ["region"]).count() == 2
    with pytest.raises(ValueError, match="right"):
        gates.one_to_one(regions, metrics, ["region"])
    assert gates.environment(spark)["spark"] == spark.version


def test_day_contrast(spark):
    counts = spark.createDataFrame([("r", "near", 1, 2, 10), ("r", "far", 1, 1, 10), ("a", "near", 1, 2, 40), ("a", "far", 2, 1, 40), ("b", "near", 1, 1, 20)], "day string, band string, from_region int, to_region int, n long")
    exposure = spark.createDataFrame([("r", 20), ("a", 80), ("b", 40), ("x", 1)], "day string, exposure long")
    got = {(r.metric, r.band): r.value for r in contrast.day_contrast(counts, exposure, "r", ["a", "b"], spark.createDataFrame([("kept", 0.7)], "metric string, value double")).collect()}
    # near: 0.5 against the mean of 0.5 and 0.5; far: 0.5 against that of 0.5 and 0.
    assert got["exposure_ratio", "near"] == 1 and got["exposure_ratio", "far"] == 2 and got["exposure_ratio", "all"] == pytest.approx(1 / 0.75)
    assert got["band_spread", None] == 1 and got["band_furthest", "far"] == 0.5 and got["kept", None] == 0.7
    assert got["share_cosine", None] == pytest.approx(0.5 / math.sqrt(0.5)) and got["self_loop_ratio", None] == pytest.approx(0.5 / 0.5)
    none = spark.createDataFrame([("a", "near", 1, 2, 1)], counts.schema)
    assert {r.band: r.ratio for r in contrast.exposure_ratios(none, exposure.where("day <> 'r'"), "r", ["a"]).collect()} == {"near": None, "all": None}


def test_channel_stats(spark):
    visits = spark.createDataFrame([("t", 0, 0, 1, False), ("t", 0, 1, 2, False), ("t", 0, 2, 1, True), ("t", 1, 0, 1, False), ("t", 1, 1, 2, False), ("u", 0, 0, 1, False), ("u", 1, 0, 2, False)], "t string, piece int, visit_index int, region int, gap_before boolean")
    pairs, totals = contrast.channel_stats(visits, ["t"], ["visit_index"], ["piece"])
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 1)]
    r = totals.first()
    assert (r.tracks, r.crossing, r.crossing_share) == (2, 1, 0.5)


def test_trajectories():
    go = lambda line, seen: trajectory.interpolate(np.array(line, float).reshape(-1, 2), np.array([s[0] for s in seen], float), np.array([s[1] for s in seen], np.int64))
    rows, problem = go([(0, 0), (10, 0), (10, 10)], [(0, 0), (20, 2_000_000)])
    assert problem is None and rows.tolist() == [[0, 0, 0], [10, 0, 1_000_000], [10, 10, 2_000_000]]
    # Observed times stay; the vertices between two of them get a microsecond each where there is hardly room.
    rows, problem = go([(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 10), (3, 13)])
    assert problem is None and rows[:, 2].tolist() == [10, 11, 12, 13]
    assert go([(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 10), (3, 12)])[1] == "no room for the times of vertices"
    rows, _ = go([(0, 0), (10, 0), (20, 0)], [(0, 0), (10 + 1e-8, 5), (20, 9)])
    assert rows.tolist() == [[0, 0, 0], [10, 0, 5], [20, 0, 9]]
    rows, _ = go([(0, 0), (10, 0)], [(0, 0), (0, 5), (10, 9)])  # standing still
    assert rows[:, 0].tolist() == [0, 0, 10]
    assert go([(5, 5)], [(0, 7)])[0].tolist() == [[5, 5, 7]]
    for line, seen, why in (([(0, 0), (10, 0)], [(0, 5), (10, 5)], "times"), ([(0, 0), (10, 0)], [(0, 0), (8, 1), (4, 2), (10, 3)], "decrease"), ([(0, 0), (10, 0)], [(2, 0), (10, 1)], "begin"), ([(0, 0), (0, 0)], [(0, 0), (0, 1)], "length"), ([(0, 0), (10, 0)], [(math.nan, 0), (10, 1)], "finite")):
        assert why in go(line, seen)[1]


def test_trajectories_of_pieces(spark):
    line = [(0.0, 0.0), (10.0, 0.0)]
    rows = [("t", 0, line, [(0.0, 1000), (10.0, 2000)]), ("t", 1, line, [(0.0, 3000), (10.0, 4000)]), ("u", 0, line, [(0.0, 1000), (10.0, 5000)]), ("u", 1, line, [(0.0, 4000), (10.0, 6000)]), ("v", 0, line, [(0.0, 5), (10.0, 5)])]
    df = spark.createDataFrame(rows, "t string, piece int, line array<struct<x:double,y:double>>, seen array<struct<offset_m:double,us:long>>")
    got = {(r.t, r.piece): r for r in trajectory.trajectories(df, ["t"], "piece").collect()}
    assert [(p.x, p.us) for p in got["t", 1].trajectory] == [(0, 3000), (10, 4000)] and got["u", 0].problem is None
    assert got["u", 1].trajectory is None and "piece to piece" in got["u", 1].problem and got["v", 0].problem == "times must increase"


def test_payload_is_json(spark):
    assert json.loads(serving.health({"a": True})[1]) == {"a": "ok"}
