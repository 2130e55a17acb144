"""Operators on small inputs worked by hand or by a plain version."""

import math
import random
from datetime import date, datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions.digest import ordered_digest, unordered_digest
from trailweave.functions.scalars import half_even, half_up, haversine, sector, text_seed, upper_tail, utm
from trailweave.operators import community, grid, matching, profiles, sequences, serving, spatial, stats, tracks, trips, visits
from trailweave.params import CommunityParams, DebounceParams, MatchParams, SequenceParams, SplitParams, TrackFilterParams, TripParams


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_scalars(spark):
    zs = [-3.0, -0.5, 0.0, 0.1, 1.0, 3.0, 8.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", upper_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=3e-7)
    r = one(spark, a=half_up(F.lit(2.5)), b=half_even(F.lit(2.5)), c=half_even(F.lit(3.5)), n=sector(F.lit(0.0), F.lit(1.0)), e=sector(F.lit(1.0), F.lit(0.0)), w=sector(F.lit(-1e-9), F.lit(1.0)))
    assert tuple(r) == (3, 2, 4, 0, 4, 0)
    east, north = utm(F.lit(118.1), F.lit(24.5))
    r = one(spark, e=east, n=north, h=haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), cm=utm(F.lit(117.0), F.lit(0.0))[0])
    assert r.cm == pytest.approx(500000) and r.h == pytest.approx(111194.93, abs=0.1)
    assert (r.e, r.n) == (pytest.approx(611450, abs=400), pytest.approx(2710000, abs=400))
    assert text_seed("a") != text_seed("b") and text_seed("a") == text_seed("a")


POINTS = "entity string, source_row long, ts timestamp_ntz, x double, y double"


def at(s):
    return datetime(2020, 12, 21, 6) .replace(minute=s // 60 % 60, second=s % 60, hour=6 + s // 3600)


def test_split_rules(spark):
    rows = [("a", 1, at(0), 0.0, 0.0), ("a", 2, at(60), 100.0, 0.0), ("a", 3, at(181), 110.0, 0.0), ("a", 4, at(181), 120.0, 0.0), ("a", 5, at(190), 1000.0, 0.0), ("a", 6, at(310), 2001.0, 0.0), ("a", 7, at(311), 2001.0, 0.0), ("b", 8, at(5), 0.0, 0.0)]
    got = tracks.split_tracks(spark.createDataFrame(rows, POINTS).repartition(3), SplitParams()).orderBy("source_row").collect()
    # gap over 120 s at 3, no advance at 4, too fast at 5, step over 1000 m at 6
    assert [r.track_no for r in got] == [1, 1, 2, 3, 4, 5, 5, 1]
    assert [r.gap_s for r in got] == [None, 60, None, None, None, None, 1, None]


def test_track_flags_are_independent_and_funnel_adds_up(spark):
    rows = [("a", i, at(30 * i), 100.0 * i, 0.0) for i in range(5)] + [("b", 10, at(0), 0.0, 0.0), ("b", 11, at(60), 1.0, 0.0)] + [("c", 20, at(0), 0.0, 0.0)]
    p = tracks.split_tracks(spark.createDataFrame(rows, POINTS), SplitParams())
    t = tracks.track_table(p, TrackFilterParams(), ["entity", "track_no"])
    got = {r.entity: r for r in t.collect()}
    assert got["a"].is_valid and got["a"].range_m == 400 and got["a"].length_m == 400 and got["a"].duration_s == 120
    assert got["b"].fails_points and got["b"].fails_duration and got["b"].fails_range and got["b"].fails_slow and not got["b"].fails_speed
    assert got["c"].mean_speed_mps == math.inf and got["c"].fails_speed and got["c"].slow_share == 1.0
    stages = [("points", "fails_points"), ("range", "fails_range")]
    f = tracks.funnel(t.withColumn("d", F.lit(1)), stages, ["d"], "points").orderBy("stage_index").collect()
    assert [(r.entered, r.kept, r.rejected, r.weight_kept) for r in f] == [(3, 1, 2, 5), (1, 1, 0, 5)]


@pytest.mark.parametrize("n", [1, 2, 24, 25, 300])
def test_range_is_exact_at_every_length(spark, n):
    rng = random.Random(n)
    rows = [("a", i, at(i), rng.gauss(0, 100), rng.gauss(0, 40)) for i in range(n)] + [("b", i, at(i), 5.0 * (i % 3), 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, POINTS).withColumns({"step_m": F.lit(0.0), "speed_mps": F.lit(0.0)})
    got = {r.entity: r.range_m for r in tracks.track_table(df, TrackFilterParams(), ["entity"]).collect()}
    for k in "ab":
        assert got[k] == max((math.dist(a[3:], b[3:]) for a, b in combinations([r for r in rows if r[0] == k], 2)), default=0.0)


def test_range_of_many_points_without_a_switch():
    rng = np.random.default_rng(2)
    for n in (4095, 4096, 4097, 10000):
        for x, y in ((rng.normal(0, 100, n), rng.normal(0, 40, n)), (np.cos(np.arange(n)), np.sin(np.arange(n))), (rng.integers(0, 50, n) * 1.0, rng.integers(0, 50, n) * 1.0), (np.arange(n) * 1.0, np.arange(n) * 2.0)):
            want = max(float(np.hypot(x[a : a + 500, None] - x, y[a : a + 500, None] - y).max()) for a in range(0, n, 500))
            assert tracks.diameter(x, y) == pytest.approx(want, rel=1e-15)


def test_marked_points(spark):
    rows = [("a", i, at(30 * i), 100.0 * i, 0.0) for i in range(5)] + [("b", 10, at(0), 0.0, 0.0)]
    p = tracks.split_tracks(spark.createDataFrame(rows, POINTS), SplitParams())
    got = tracks.mark_points(p, TrackFilterParams(), ["entity", "track_no"], ["source_row"]).collect()
    assert sorted((r.source_row, r.is_valid_track) for r in got) == [(i, True) for i in range(5)] + [(10, False)]


@pytest.mark.parametrize("block", [3, 1024])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.uniform(0, 300), rng.gauss(100, 1)]), rng.choice([rng.uniform(0, 300), rng.gauss(100, 1)])) for i in range(250)]
    rows += [(300 + i, 50.0, 50.0) for i in range(40)] + [(900, None, 1.0), (901, math.nan, 1.0), (902, math.inf, 1.0), (None, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    fine = [r for r in rows if r[0] is not None and r[1] is not None and math.isfinite(r[1])]
    want = []
    for i, x, y in fine:
        near = sorted((d, j) for j, u, v in fine if j != i and (d := math.sqrt((x - u) ** 2 + (y - v) ** 2)) <= 60)[:5]
        want += [(i, j, d, n) for n, (d, j) in enumerate(near, 1)]
    assert sorted(map(tuple, spatial.knn_within(df, df, "i", "i", 60.0, 5).collect())) == [(i, j, pytest.approx(d), n) for i, j, d, n in sorted(want)]
    other = spark.createDataFrame([(7, 51.0, 50.0), (3, 49.0, 50.0)], "j int, x double, y double")
    assert sorted(tuple(r)[1:] for r in spatial.knn_within(df.where("i in (300, 900)"), other, "i", "j", 60.0, 5).collect()) == [(3, 1.0, 1), (7, 1.0, 2)]


def test_lookup_or_nearest_loses_no_point(spark):
    cells = spark.createDataFrame([(0, 0, 5), (3, 0, 2), (0, 3, 2), (9, 9, None)], "cell_x int, cell_y int, region int")
    pts = [(1, 5.0, 5.0), (2, 25.0, 25.0), (3, 1e9, -1e9), (4, None, 3.0), (5, 20.0, 5.0), (6, math.nan, 0.0), (7, 95.0, 95.0)]
    got = {r.i: (r.region, r.is_fallback) for r in spatial.lookup_or_nearest(spark.createDataFrame(pts, "i int, x double, y double"), cells, 10.0, "i").collect()}
    # 25 m from the corner of the square of region 5, 5 m from those of region 2; at 20, 5 both are 10 m away.
    assert got == {1: (5, False), 2: (2, True), 3: (2, True), 4: (None, True), 5: (2, True), 6: (None, True), 7: (2, True)}
    assert [(r.region, r.is_fallback) for r in spatial.lookup_or_nearest(spark.createDataFrame(pts, "i int, x double, y double"), cells.where("region < 0"), 10.0, "i").collect()] == [(None, True)] * 7


def test_forward_fill_and_asof(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, "a", " ", None, "b", None, None, None, "c", None])], "i long, v string")
    assert [r.v for r in tracks.forward_fill(df, "i", "v", 3).orderBy("i").collect()] == [None, "a", "a", "a", "b", "b", "b", "b", "c", "c"]
    left = spark.createDataFrame([("k", 1), ("k", 5), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 5, "x"), ("k", 2, "y")], "k string, w int, val string")
    assert sorted((r.k, r.t, r.val) for r in tracks.asof_join(left, right, ["k"], "t", "w", "val").collect()) == [("k", 1, None), ("k", 5, "x"), ("z", 9, None)]


def test_pairs_and_offenders(spark):
    rows = [("a", i, at(100 * i), i % 2) for i in range(5)] + [("b", 10, at(0), 1), ("b", 11, at(9), 0)]
    df = spark.createDataFrame(rows, "entity string, n long, ts timestamp_ntz, status int")
    got = trips.pair_events(df, ["entity"], "n", ["ts", "status"]).where("entity = 'a'").orderBy("trip_index").collect()
    assert [(r.trip_index, r.open_status, r.close_status) for r in got] == [(0, 0, 1), (1, 0, 1)]
    assert sorted((r.entity, r.events, r.misplaced) for r in trips.offenders(df, ["entity"], "n", "status").collect()) == [("a", 5, 0), ("b", 2, 2)]
    edge = spark.createDataFrame([(at(0), at(s), float(m)) for s, m in ((60, 999), (61, 1000), (3599, 2999), (3600, 3000))], "open_ts timestamp_ntz, close_ts timestamp_ntz, distance_m double")
    assert [(r.band, r.is_valid) for r in trips.judge_trips(edge, TripParams()).orderBy("distance_m").collect()] == [("short", False), ("medium", True), ("medium", True), ("long", False)]


def plain_cells(line, size):
    """Cells under a line by dense sampling."""
    out = []
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        for t in np.linspace(0, 1, 40001)[1:-1]:
            c = math.floor((x0 + t * (x1 - x0)) / size), math.floor((y0 + t * (y1 - y0)) / size)
            if not out or out[-1] != c:
                out.append(c)
    return out


def test_traverse(spark):
    rng = random.Random(7)
    lines = {k: [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(5)] for k in range(6)}
    rows = [(k, i, x, y) for k, pts in lines.items() for i, (x, y) in enumerate(pts)]
    got = grid.traverse(spark.createDataFrame(rows, "k int, i int, x double, y double"), ["k"], "i", 150.0).orderBy("k", "run_index").collect()
    for k, pts in lines.items():
        own = [r for r in got if r.k == k]
        assert [(r.cell_x, r.cell_y) for r in own] == plain_cells(pts, 150.0)
        assert sum(r.length_m for r in own) == pytest.approx(sum(math.dist(a, b) for a, b in zip(pts, pts[1:])))
    # Straight through a corner: along x, then along y, with length 0.
    got = grid.traverse(spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 2.5, 2.5)], "k int, i int, x double, y double"), ["k"], "i", 1.0).orderBy("run_index").collect()
    assert [(r.cell_x, r.cell_y) for r in got] == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]
    assert [r.length_m == 0 for r in got] == [False, True, False, True, False]
    assert grid.min_cells(150) == 14 and grid.min_cells(200) == 8 and grid.min_cells(300) == 4


def test_votes_links_and_adjacency(spark):
    c = spark.createDataFrame([("d", "t", 0, 0, 0), ("d", "t", 1, 1, 0), ("d", "t", 2, 0, 0), ("d", "t", 3, 1, 0), ("d", "u", 0, 0, 0), ("d", "u", 1, 1, 0)], "d string, t string, run_index int, cell_x int, cell_y int")
    assert sorted((r.from_x, r.to_x, r.tracks) for r in grid.cell_links(c, "d", ["t"]).collect()) == [(0, 1, 2), (1, 0, 1)]
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (1, 1, 3), (5, 5, 4)], "cell_x int, cell_y int, r int")
    assert sorted(map(tuple, grid.region_adjacency(cells, "r").collect())) == [(1, 2), (2, 3)]


def test_polygons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    f = spatial.in_polygons([[square, hole]], 1.0)
    pts = spark.createDataFrame([(5.0, 5.0), (5.0, 4.5), (2.0, 2.0), (10.5, 5.0), (12.0, 5.0)], "x double, y double")
    assert [r.v for r in pts.select(f("x", "y").alias("v")).collect()] == [True, True, True, True, False]
    assert spatial.line_inside([(1, 1), (9, 9)], square) and not spatial.line_inside([(1, 1), (11, 5)], square)
    bay = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]
    assert not spatial.line_inside([(1, 7), (9, 7)], bay)


def test_contains_and_supports(spark):
    rng = random.Random(3)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(2, 8))] for _ in range(60)]
    pats = [list(p) for n in (2, 3) for p in {tuple(rng.randrange(4) for _ in range(n)) for _ in range(30)}]

    def within(p, s):
        it = iter(s)
        return all(x in it for x in p)

    df = spark.createDataFrame(list(enumerate(seqs)), "id int, regions array<int>")
    got = {tuple(r.pattern): r.support for r in sequences.contained_support(df, spark.createDataFrame([(p,) for p in pats], "pattern array<int>")).collect()}
    assert got == {tuple(p): n for p in pats if (n := sum(within(p, s) for s in seqs))}
    runs = {tuple(r.pattern): r.n for r in sequences.contiguous_patterns(df, ["id"], 3).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    want = {}
    for s in seqs:
        for p in {tuple(s[i : i + n]) for n in (2, 3) for i in range(len(s) - n + 1)}:
            want[p] = want.get(p, 0) + 1
    assert runs == want
    mined = {tuple(r.pattern): r.support for r in sequences.mine(df, 12, SequenceParams(max_length=3)).collect()}
    everything = {p: sum(within(p, s) for s in seqs) for n in (2, 3) for p in __import__("itertools").product(range(4), repeat=n)}
    assert mined == {p: n for p, n in everything.items() if n >= 12}
    assert sequences.support_threshold(0, SequenceParams()) is None and sequences.support_threshold(62_500, SequenceParams()) == 13


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, None, 0.5, 0.03]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "g int, i int, p double")
    got = [r.q for r in stats.benjamini_hochberg(df, ["g"], "p", ["i"]).orderBy("i").collect()]
    assert got == [pytest.approx(0.05), pytest.approx(0.05), pytest.approx(0.05), None, pytest.approx(0.5), pytest.approx(0.05)]


def test_monte_carlo_meets_the_closed_form(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("d", a, b, rng.randrange(1, 40)) for a in range(5) for b in range(5)], "scope string, from_region int, to_region int, n int")
    closed = {(r.from_region, r.to_region): (r.null_mean, r.null_sd) for r in stats.od_null(df, ["scope"], "n").collect()}
    for r in stats.replicate_null(df, "scope", "n", 400, "7").collect():
        mean, sd = closed[r.from_region, r.to_region]
        assert abs(r.mc_mean - mean) < 5 * sd / math.sqrt(400) + 1e-9 and abs(r.mc_sd - sd) < 0.25 * sd
        assert 1 / 401 <= r.p_empirical <= 1


def plain_ami(counts):
    """AMI by the published formula, term by term."""
    n = sum(counts.values())
    a, b = {}, {}
    for (i, j), k in counts.items():
        a[i], b[j] = a.get(i, 0) + k, b.get(j, 0) + k
    h = lambda m: -sum(k / n * math.log(k / n) for k in m.values())
    mi = sum(k / n * math.log(n * k / (a[i] * b[j])) for (i, j), k in counts.items() if k)
    f = math.lgamma
    emi = sum(k / n * math.log(n * k / (x * y)) * math.exp(f(x + 1) + f(y + 1) + f(n - x + 1) + f(n - y + 1) - f(n + 1) - f(k + 1) - f(x - k + 1) - f(y - k + 1) - f(n - x - y + k + 1)) for x in a.values() for y in b.values() for k in range(max(1, x + y - n), min(x, y) + 1))
    return (mi - emi) / ((h(a) + h(b)) / 2 - emi)


def test_information_and_similarity(spark):
    ami = lambda counts: stats.adjusted_mutual_information(spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "a int, b int, n long"), "a", "b", "n").first()["ami"]
    same = {(0, 0): 5, (1, 1): 7}
    assert ami(same) == pytest.approx(1.0) and ami({(0, 0): 1}) is None and ami({(0, 0): 9}) == 1.0
    # Labels [0,0,1,1] against [0,0,1,2], by the published formula.
    assert ami({(0, 0): 2, (1, 1): 1, (1, 2): 1}) == pytest.approx(0.571428, abs=1e-5)
    rng = random.Random(2)
    for size in (3, 40, 4000):
        counts = {(a, b): rng.randrange(size) for a in range(5) for b in range(4)} | {(0, 0): 3 * size}
        assert ami(counts) == pytest.approx(plain_ami(counts), abs=1e-9)
    ks = np.array([0, 1, 5, 254, 255, 256, 1000, 10**7, 10**12])
    assert stats.log_factorial(ks) == pytest.approx([math.lgamma(k + 1) for k in ks.tolist()], rel=1e-13)
    df = spark.createDataFrame([(a, b, n) for (a, b), n in same.items()], "a int, b int, n int")
    assert stats.element_similarity(df, "a", "b", "n").first()[0] == pytest.approx(1.0)


def test_null_floor_audit_and_extremes(spark):
    df = spark.createDataFrame([("d", 1, 2, 0.0, 0.5, 0.0, 0.4), ("d", 1, 3, 3.0, 2.0, 4.0, 2.0), ("d", 2, 3, 3.0, 0.0, 3.0, 0.0)], "scope string, from_region int, to_region int, mc_mean double, null_mean double, mc_sd double, null_sd double")
    got = [r.s for r in df.orderBy("from_region", "to_region").select(stats.floored_sd(F.col("mc_sd"), F.col("null_sd")).alias("s")).collect()]
    assert got == [0.4, 4.0, 3.0]
    r = stats.moment_audit(df, ["scope"]).first()
    assert (r.mean_off, r.sd_off, r.pairs) == (0.5, 1.0, 1)
    assert [(r.to_region, r.end) for r in stats.extremes(df, ["mc_mean", "from_region"], 1).select("to_region", "end").collect()] == [(2, "head"), (3, "tail")]
    assert [(r.from_region, r.to_region) for r in stats.top_pairs(df, ["scope"], "mc_sd", 1).collect()] == [(1, 3)]
    rng = np.random.default_rng(1)
    left = np.array([3, 0, 10, 5])
    for _ in range(50):
        x = stats._hypergeometric(rng, left, 9)
        assert x.sum() == 9 and (x <= left).all()
    big = stats._hypergeometric(rng, np.array([10**12, 3 * 10**12]), 10**10)
    assert big.sum() == 10**10 and abs(big[0] - 2.5 * 10**9) < 10**6


def test_attributed_patterns(spark):
    seqs = spark.createDataFrame([([1, 2, 3], "d1", 6), ([1, 9, 2], "d1", 7), ([1, 2], "d2", 7), ([1, 2], "d2", 7), ([3, 2, 1], "d2", 8)], "regions array<int>, day string, start_hour int")
    scopes = spark.createDataFrame(sequences.scopes_of(["d1", "d2"], ["d1", "d2"], "all"), "scope string, day string")
    pats = spark.createDataFrame([("all", [1, 2], 4), ("d1", [1, 2], 2), ("d1", [1, 3], 1), ("d2", [9, 2], 0)], "scope string, pattern array<int>, support int")
    adjacency = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    codes = spark.createDataFrame([(r, f"c{r}", r % 2) for r in (1, 2, 3, 9)], "region int, code string, district int")
    got = {(r.scope, tuple(r.pattern)): r for r in sequences.attribute_patterns(seqs, pats, scopes, adjacency, codes).collect()}
    assert (got["all", (1, 2)].contained, got["all", (1, 2)].contiguous, got["all", (1, 2)].hour_07) == (4, 3, 3)
    assert (got["d1", (1, 2)].contained, got["d1", (1, 2)].contiguous, got["d1", (1, 2)].hour_06) == (2, 1, 1)
    assert not got["d1", (1, 3)].all_steps_adjacent and got["d1", (1, 2)].all_steps_adjacent and got["d1", (1, 3)].codes == ["c1", "c3"] and got["d1", (1, 3)].districts == [1, 1]
    assert (got["d2", (9, 2)].contained, got["d2", (9, 2)].contiguous) == (0, 0)
    with pytest.raises(ValueError, match="9"):
        sequences.attribute_patterns(seqs, pats, scopes, adjacency, codes.where("region < 9"))
    assert sequences.scopes_of(["d1"], ["d1", "d2"]) == [("d1", "d1")] and sequences.overlap_floor(1001) == 4


DEBOUNCE = [
    # region and length of each crossing; offsets; visits (region, entry, exit, gap before); spans, cuts
    ([(1, 200)], [], [(1, 0, 200, False)], 1, 0),
    ([(1, 50)], [], [], 1, 0),
    ([(1, 50)], [10, 50], [(1, 0, 50, False)], 1, 0),  # the last span is closed
    ([(1, 50), (2, 200)], [10, 50], [(2, 50, 250, False)], 2, 0),  # any other is half open
    ([(1, 150), (2, 50)], [10, 150, 200], [(1, 0, 150, False), (2, 150, 200, False)], 2, 0),
    ([(1, 200), (2, 50), (1, 200)], [], [(1, 0, 450, False)], 3, 0),
    ([(1, 200), (None, 150), (1, 200)], [], [(1, 0, 200, False), (1, 350, 550, True)], 3, 1),
    ([(1, 200), (None, 50), (1, 200)], [], [(1, 0, 450, False)], 3, 0),
    ([(1, 150), (None, 40), (2, 150)], [], [(1, 0, 190, False), (2, 190, 340, False)], 3, 0),
    ([(1, 150), (None, 50), (1, 150)], [160, 180], [(1, 0, 150, False), (1, 200, 350, True)], 3, 1),  # points can cut
    ([(1, 200), (None, 150), (2, 50), (3, 200)], [], [(1, 0, 200, False), (3, 400, 600, True)], 4, 1),
    ([(1, 200), (None, 150), (2, 50), (None, 150), (3, 200)], [], [(1, 0, 200, False), (3, 550, 750, True)], 5, 1),  # two cuts before one visit
    ([(None, 150), (1, 200)], [], [(1, 150, 350, True)], 2, 1),  # a leading gap
    ([(None, 150), (1, 200), (None, 150)], [], [(1, 150, 350, True)], 3, 2),
    ([(1, 200), (None, 150)], [], [(1, 0, 200, False)], 2, 1),
    ([(1, 200), (None, 150), (2, 20)], [], [(1, 0, 200, False)], 3, 1),
    ([(None, 300)], [], [], 1, 0),  # nothing but a gap is no cut
    ([(1, 60), (1, 60)], [], [(1, 0, 120, False)], 1, 0),
    ([(1, 80), (1, 80), (2, 40)], [], [(1, 0, 200, False)], 2, 0),
    ([(None, 50), (2, 40), (1, 200)], [], [(1, 90, 290, False)], 3, 0),
]


def test_debounce(spark):
    rows, marks = [], []
    for k, (line, offsets, *_) in enumerate(DEBOUNCE):
        at = 0.0
        for i, (region, length) in enumerate(line):
            rows.append((k, i, region, float(length), at, 0.0, at + length, 0.0))
            at += length
        marks += [(k, float(o)) for o in offsets]
    c = spark.createDataFrame(rows, "k int, run_index int, region int, length_m double, entry_x double, entry_y double, exit_x double, exit_y double")
    o = spark.createDataFrame([*marks, (999, 5.0), (0, None)], "k int, offset_m double")
    got = {}
    for r in visits.debounce_pieces(c, o, ["k"], DebounceParams()).orderBy("k", "visit_index").collect():
        got.setdefault(r.k, []).append((r.region, r.entry_x, r.exit_x, r.gap_before))
        assert r.visit_index == len(got[r.k]) - 1 and r.length_m == r.exit_x - r.entry_x
    assert [got.get(k, []) for k in range(len(DEBOUNCE))] == [want for _, _, want, _, _ in DEBOUNCE]
    cuts = {r.k: (r.candidates, r.visits, r.cuts) for r in visits.piece_cuts(c, o, ["k"], DebounceParams()).collect()}
    assert [cuts[k] for k in range(len(DEBOUNCE))] == [(n, len(want), cut) for _, _, want, n, cut in DEBOUNCE]


def test_circular(spark):
    v = spark.createDataFrame([(k, i, r, x, y, x, y) for k, pts in enumerate([[(1, 0, 0), (2, 0, 10), (2, 0, 60), (3, 0, 90)], [(1, 5, 5), (2, 0, 0), (2, 0, 50), (1, 9, 9)], [(2, 0, 0), (2, 1, 1)]]) for i, (r, x, y) in enumerate((a, float(b), float(c)) for a, b, c in pts)], "k int, i int, region int, entry_x double, entry_y double, exit_x double, exit_y double")
    votes = profiles.transit_votes(v, ["k"], ["i"])
    got = {r.region: r for r in profiles.circular(votes, ["region"]).collect()}
    assert (got[2].visiting, got[2].transit, got[2].chords, got[2].sector_00) == (3, 2, 2, 2)
    assert got[2].r == pytest.approx(1) and got[2].mean_bearing == pytest.approx(0) and got[1].r is None and got[1].mean_bearing is None


def plain_move(roads, a, b):
    """Length of the way between two candidates (edge, place) by all ways up to the cut-off."""
    (e, s), (f, t) = a, b
    if e == f:
        return None if t - s < -roads.p.backtrack_m else max(0.0, t - s)
    best = {int(roads.head[e]): 0.0}
    for _ in range(len(roads.length)):
        for i in range(len(roads.length)):
            u, v = int(roads.tail[i]), int(roads.head[i])
            if u in best and best[u] + roads.length[i] <= roads.p.cutoff_m:
                best[v] = min(best.get(v, math.inf), best[u] + roads.length[i])
    return roads.length[e] - s + best[int(roads.tail[f])] + t if int(roads.tail[f]) in best else None


def plain_score(roads, points, path):
    dist, edge, along = roads.candidates(np.array(points))
    at = lambda i, k: (int(edge[i, k]), along[i, k])
    emit = lambda i, k: -(dist[i, k] ** 2) / (2 * roads.p.sigma_m**2) - (0 if roads.legal[edge[i, k]] else roads.p.contraflow_penalty)
    total = emit(0, path[0])
    for i in range(1, len(points)):
        m = plain_move(roads, at(i - 1, path[i - 1]), at(i, path[i]))
        total += emit(i, path[i]) - (roads.p.no_path_cost if m is None else abs(m - math.dist(points[i - 1], points[i])) / roads.p.beta_m)
    return total


STREETS = [(0, 1, 2, [(0, 0), (100, 0)], True, True), (1, 2, 3, [(100, 0), (100, 100)], True, False), (2, 1, 4, [(0, 0), (0, 100)], True, True)]


def matched(roads, *lines):
    sizes = np.array([len(x) for x in lines])
    return roads.match_all(np.array([p for x in lines for p in x], float).reshape(-1, 2), sizes)


def test_map_matching():
    from itertools import product

    p = MatchParams()
    roads = matching.Roads(STREETS, p)
    points = [(10.0, 5.0), (60.0, -4.0), (95.0, 20.0), (104.0, 80.0)]
    rows = matched(roads, points)
    assert rows["edge"].tolist() == [0, 0, 2, 2] and rows["piece"].tolist() == [0] * 4
    assert rows["offset_m"][-1] == pytest.approx(170) and rows["inferred_m"].sum() == 0
    dist, edge, along = roads.candidates(np.array(points))
    first, size = np.array([0]), np.array([4])
    chosen = roads.viterbi(np.array(points), dist, edge, along, first, size)
    best = max(plain_score(roads, points, path) for path in product(*[range(int((e >= 0).sum())) for e in edge]))
    assert plain_score(roads, points, chosen) == pytest.approx(best)
    # Two pieces around a point far from any road; a single point rides over nothing, so it is no piece.
    far = matched(roads, [(10.0, 5.0), (60.0, 0.0), (5000.0, 5000.0), (0.0, 90.0), (0.0, 20.0)], [(10.0, 5.0)], [], [(9e9, 0.0)], [(50.0, 0.0), (90.0, 0.0)])
    assert far["piece"].tolist() == [0, 0, -1, 1, 1, -1, -1, 0, 0] and far["edge"].tolist()[2] == -1 and far["edge"].tolist()[5] >= 0
    assert far["offset_m"][[1, 4, 8]].tolist() == [50, 70, 40]
    nodes = roads.nodes
    assert roads.between(np.array([nodes[4]]), np.array([nodes[3]]))[0] == 300
    assert roads.way(nodes[4], nodes[3]) == [5, 0, 2]


def test_matching_many_tracks_is_matching_each():
    rng = random.Random(8)
    grid_ = [(k, a, b, line, True, k % 3 > 0) for k, (a, b, line) in enumerate([(i * 10 + j, i * 10 + j + 1, [(i * 90, j * 90), (i * 90, j * 90 + 90)]) for i in range(6) for j in range(5)] + [(i * 10 + j, i * 10 + 10 + j, [(i * 90, j * 90), (i * 90 + 30, j * 90 + 8), (i * 90 + 90, j * 90)]) for i in range(5) for j in range(6)])]
    lines = []
    for n in (1, 2, 9, 30, 5, 17, 1, 30):
        x, y, line = rng.uniform(0, 450), rng.uniform(0, 450), []
        for _ in range(n):
            x, y = x + rng.gauss(0, 50), y + rng.gauss(0, 50)
            line.append((x, y))
        lines.append(line)
    p = MatchParams(radius_m=45.0)
    together = matched(matching.Roads(grid_, p), *lines)
    at = 0
    for line in lines:
        alone = matched(matching.Roads(grid_, p), line)
        for c, v in alone.items():
            assert together[c][at : at + len(line)].tolist() == v.tolist()
        at += len(line)
    assert (together["edge"] < 0).any() and len(set(together["piece"].tolist())) > 2


def test_match_tables(spark):
    points = [("a", 1, 10.0, 5.0), ("a", 2, 60.0, -4.0), ("a", 3, 95.0, 20.0), ("a", 4, 104.0, 80.0), ("b", 1, 0.0, 95.0), ("b", 2, 100.0, 50.0), ("c", 1, 9e9, 0.0), ("d", 1, 10.0, 0.0), ("d", 2, 0.0, 95.0), ("d", 3, 9e9, 0.0), ("d", 4, 100.0, 10.0), ("d", 5, 100.0, 60.0)]
    df = spark.createDataFrame(points, "t string, n int, x double, y double")
    at, edges, pieces = matching.match_tables(df, STREETS, MatchParams(), ["t"], "n")
    rows = {(r.t, r.n): r for r in at.collect()}
    assert [rows["a", i].edge for i in (1, 2, 3, 4)] == [0, 0, 2, 2] and rows["c", 1].edge is None and rows["c", 1].snap_m is None and rows["d", 4].piece == 1
    assert {(r.t, r.n): r.offset_m for r in matching.match_tracks(df, STREETS, MatchParams(), ["t"], "n").collect()} == {k: r.offset_m for k, r in rows.items()}
    assert [(r.seq, r.edge, r.start_m, r.end_m, r.is_inferred) for r in edges.where("t = 'a'").orderBy("seq").collect()] == [(0, 0, 10.0, 60.0, False), (1, 0, 60.0, 100.0, False), (2, 2, 0.0, 20.0, False), (3, 2, 20.0, 80.0, False)]
    # From the end of one street to the middle of another: the street between was not observed.
    assert [(r.edge, r.is_inferred) for r in edges.where("t = 'b'").orderBy("seq").collect()] == [(5, False), (0, True), (2, False)]
    found = {(r.t, r.piece): r for r in pieces.collect()}
    assert set(found) == {("a", 0), ("b", 0), ("d", 0), ("d", 1)}
    assert [(v.x, v.y) for v in found["a", 0].line] == [(10, 0), (60, 0), (100, 0), (100, 20), (100, 80)]
    assert (found["b", 0].length_m, found["b", 0].observed_m, found["b", 0].inferred_m) == (245, 145, 100)
    for r in found.values():
        assert r.length_m == pytest.approx(sum(math.dist(a, b) for a, b in zip(r.line, r.line[1:])))
    legal = spark.createDataFrame([(2 * k + d, ok) for k, *_, f, b in STREETS for d, ok in enumerate((f, b))], "edge long, is_legal_direction boolean")
    inside = pieces.withColumn("on_area", F.col("t") != "b")
    judged = {r.t: r for r in matching.judge_matches(at, inside, ["t"], "n", MatchParams(), legal, "on_area").collect()}
    assert judged["a"].is_valid and judged["a"].matched_points == 4 and judged["a"].contraflow_points == 0
    assert judged["b"].fails_inside and judged["b"].fails_inferred and not judged["b"].is_valid
    assert judged["c"].match_rate == 0 and judged["c"].pieces == 0 and judged["c"].path_inside and judged["c"].inferred_share == 1.0
    assert judged["d"].path_breaks == 0 and judged["d"].pieces == 2 and matching.piece_points(pieces, ["t"]).where("t = 'a'").count() == 5


def test_network_tables_feed_the_matcher(spark):
    from trailweave.operators.network import AccessRules, build_network

    ways = spark.createDataFrame([(1, {"highway": "a", "oneway": "yes"}, [1, 2, 3]), (2, {"highway": "b"}, [2, 4])], "osmid long, tags map<string,string>, refs array<long>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 100.0, 90.0)], "id long, x double, y double")
    rows = matching.network_rows(*build_network(ways, nodes, AccessRules()))
    assert rows == [(0, 1, 2, [(0, 0), (100, 0)], True, False), (1, 2, 3, [(100, 0), (200, 0)], True, False), (2, 2, 4, [(100, 0), (100, 90)], True, True)]
    df = spark.createDataFrame([("a", 1, 20.0, 3.0), ("a", 2, 150.0, -3.0), ("a", 3, 190.0, 0.0)], "t string, n int, x double, y double")
    assert [r.edge for r in matching.match_tracks(df, rows, MatchParams(), ["t"], "n").orderBy("n").collect()] == [0, 2, 2]


def test_candidates_of_bent_segments():
    rng = random.Random(4)
    lines = [(k, 2 * k, 2 * k + 1, [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(rng.randrange(2, 5))], True, True) for k in range(12)]
    roads = matching.Roads(lines, MatchParams(radius_m=80.0))
    points = np.array([(rng.uniform(-50, 350), rng.uniform(-50, 350)) for _ in range(60)])
    for (x, y), dist, edge, along in zip(points.tolist(), *roads.candidates(points)):
        want = []
        for k, _, _, pts, _, _ in lines:
            at, best = 0.0, (math.inf, 0.0)
            for a, b in zip(pts, pts[1:]):
                n = math.dist(a, b)
                t = min(1, max(0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / n**2))
                best = min(best, (math.dist((x, y), (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))), at + t * n), key=lambda v: v[0])
                at += n
            if best[0] <= 80:
                want.append((best[0], 2 * k, best[1], at - best[1]))
        want = sorted(want)[:5]
        n = 2 * len(want)
        assert edge[:n].tolist() == [e for w in want for e in (w[1], w[1] + 1)] and (edge[n:] == -1).all()
        assert [v for g in zip(dist[:n], along[:n]) for v in g] == pytest.approx([v for w in want for v in (w[0], w[2], w[0], w[3])])


def test_communities_and_tidying():
    links = [(a, b, 10.0) for g in (0, 1) for a in [(g * 10 + i, j) for i in range(3) for j in range(3)] for b in [(g * 10 + i, j) for i in range(3) for j in range(3)] if a != b]
    links += [((2, 1), (10, 1), 1.0), ((10, 1), (2, 1), 1.0)]
    found = community.communities(links, CommunityParams(trials=3))
    assert len(set(found.values())) == 2 and found[(0, 0)] == found[(2, 2)] != found[(10, 0)]
    assert community.communities(links[::-1], CommunityParams(trials=3)) == found and community.communities([], CommunityParams()) == {}
    of = {(x, 0): 0 for x in range(4)} | {(4, 0): 1} | {(x, 0): 0 for x in range(5, 8)}
    done = community.tidy(of, [((3, 0), (4, 0), 5.0), ((4, 0), (5, 0), 9.0)], 2)
    assert done.regions == {(x, 0): 1 for x in range(4)} | {(x, 0): 2 for x in range(4, 8)}
    ring = {(x, y): 0 for x in range(3) for y in range(3)} | {(1, 1): 5}
    grid_ = community.Raster(ring)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in grid_.enclosed(grid_.labels(ring))] == [[0] * 9, 1]
    assert community.layer_stats({c: 1 for c in ring if c != (1, 1)}) == {"regions": 1, "multipart": 0, "holes": 1}
    filled = community.display_fill({c: 1 for c in ring if c != (1, 1)}, list(ring), 150.0)
    assert filled.regions[(1, 1)] == 1 and filled.filled == ((1, 1),) and filled.waves == 1
    assert community.spread_labels({(0, 0): 2, (2, 0): 1}, [(1, 0), (9, 9)]) == ({(0, 0): 2, (1, 0): 1, (2, 0): 1}, 1)
    assert len(community.island_cells([(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], 10.0)) == 9
    w = community.shuffle_weights(links, 1)
    assert sorted(x[2] for x in w) == sorted(x[2] for x in links) and w == community.shuffle_weights(links[::-1], 1)
    assert len(community.fold_plans("abcd", 2)) == 3 and len(community.fold_plans("abcd", 1)) == 6 and len(community.fold_plans("abcd", 3)) == 4
    assert community.aligned([(1.0, 8), (2.0, 12), (3.0, 30)], 10, 5) == (1.0, False)
    assert community.districts({(0, 0): 1, (1, 0): 2, (9, 9): 3}, [((0, 0), (1, 0), 3.0), ((1, 0), (0, 0), 3.0)]) == {1: 1, 2: 1, 3: 2}


def test_display_fill_keeps_wide_open_blocks():
    island = [(x, y) for x in range(40) for y in range(30)]
    lake = {(x, y) for x in range(10, 24) for y in range(8, 22)}
    lane = {(x, 4) for x in range(40)} | {(x, 5) for x in range(40)}
    of = {c: 1 + c[0] // 20 for c in island if c not in lake | lane}
    out = community.display_fill(of, island, 150.0)
    # 14 x 14 cells of 150 m are 4.4 km2; an erosion by two steps and back takes only the corners, which are filled.
    assert lane <= set(out.filled) and len(out.blocks) == 1 and out.blocks == (4.14,)
    corners = lake & set(out.filled)
    assert len(lake) - len(corners) == round(out.blocks[0] * 1e6 / 150**2) and {(10, 8), (23, 21)} <= corners
    assert community.display_fill(of, island, 150.0, max_hole_km2=5.0).blocks == () and len(community.display_fill(of, island, 150.0, max_hole_km2=5.0).regions) == len(island)
    # Off the island nothing is filled, and of labels that reach a cell at once the smaller one stays.
    assert community.display_fill({(0, 0): 7, (2, 0): 3, (9, 9): 1}, [(0, 0), (1, 0), (2, 0)], 150.0).regions == {(0, 0): 7, (1, 0): 3, (2, 0): 3, (9, 9): 1}


def test_tidying_rules():
    strip = {(x, 0): 1 for x in range(14)} | {(x, 0): 2 for x in range(14, 17)} | {(x, 0): 3 for x in range(17, 31)}
    weak, strong = [((13, 0), (14, 0), 1.0)], [((16, 0), (17, 0), 1.0), ((17, 0), (16, 0), 1.0)]
    assert community.tidy(strip, weak + strong).regions[(14, 0)] == community.tidy(strip, weak + strong).regions[(20, 0)]
    # Equal flow: the longer border; then the smaller number.
    field = {(x, 0): 1 for x in range(14)} | {(x, 2): 3 for x in range(14)} | {(0, 1): 2, (14, 0): 1, (14, 1): 1}
    done = community.tidy(field, [])
    assert done.regions[(0, 1)] == done.regions[(0, 0)]
    # A small part without a neighbour stays, parts of one label that don't touch come apart, numbers go by size.
    alone = community.tidy({(0, 0): 1, (5, 5): 1, (5, 6): 1}, [])
    assert alone.regions == {(5, 5): 1, (5, 6): 1, (0, 0): 2} and alone.steps[0] == ("split", 1, 2)
    assert community.tidy({}, []).regions == {}
    rng = random.Random(5)
    for _ in range(20):
        of = {(x, y): rng.randrange(4) for x in range(9) for y in range(9) if rng.random() < 0.8}
        r = community.Raster(of)
        seen, want = {}, 0
        for c in sorted(of):
            if c not in seen:
                stack = [c]
                while stack:
                    u = stack.pop()
                    if seen.setdefault(u, want) == want:
                        stack += [v for v in ((u[0] + 1, u[1]), (u[0] - 1, u[1]), (u[0], u[1] + 1), (u[0], u[1] - 1)) if of.get(v) == of[u] and v not in seen]
                want += 1
        assert r.mapping(r.parts(r.labels(of))) == seen
        out = community.tidy(of, [], 5)
        assert set(out.regions) == set(of) and sorted(set(out.regions.values())) == list(range(1, len(set(out.regions.values())) + 1))


def test_serving(spark):
    with pytest.raises(serving.RequestError):
        serving.check_window(datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 13))
    with pytest.raises(serving.RequestError):
        serving.check_box((1, 0, 0, 1))
    assert serving.health({"db": True, "files": False})[0] == 503 and serving.days_between("2024-02-28", "2024-03-01") == ["2024-02-28", "2024-02-29", "2024-03-01"]
    pts = spark.createDataFrame([(1, at(0), 0.0, 0.0), (1, at(100), 100.0, 0.0), (2, at(0), 0.0, 50.0), (2, at(100), 100.0, 50.0), (3, at(0), 50.0, -100.0), (3, at(100), 50.0, 100.0)], "k int, ts timestamp_ntz, x double, y double")
    ask = lambda a, b: serving.tracks_in_box(pts, ["k"], (40, -10, 60, 10), F.lit(str(at(a))).cast("timestamp_ntz"), F.lit(str(at(b))).cast("timestamp_ntz"))
    total, rows = ask(0, 100)
    assert total.first()[0] == 2 and [r.k for r in rows.collect()] == [1, 3]
    assert ask(0, 30)[0].first()[0] == 0
    rings = spark.createDataFrame([(2, [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], "b"), (1, [[[0.0, 0.0]]], "a")], "id int, g array<array<array<double>>>, name string")
    import json

    doc = json.loads(serving.feature_collection(rings, "g", "id", ["name"]).first()[0])
    assert [f["id"] for f in doc["features"]] == [1, 2] and doc["features"][1]["properties"] == {"name": "b"}


def test_digests_do_not_see_layout(spark):
    df = spark.createDataFrame([(i, f"v{i}", i / 3) for i in range(50)], "i int, v string, d double")
    assert unordered_digest(df) == unordered_digest(df.repartition(7).orderBy(F.desc("i"))) != unordered_digest(df.where("i > 0"))
    assert ordered_digest(df, ["i"]) == ordered_digest(df.repartition(7), ["i"])


def test_overlay(spark):
    f = spark.createDataFrame([("park", 0, 0), ("park", 0, 0), ("park", 1, 0), ("shop", 0, 0)], "category string, cell_x int, cell_y int")
    r = spark.createDataFrame([(7, 0, 0), (7, 1, 0)], "region int, cell_x int, cell_y int")
    assert {x.category: round(x.share, 3) for x in spatial.overlay_share(f, r).collect()} == {"park": 0.667, "shop": 0.333}


def test_dates():
    from trailweave.sources.files import InputError, date_in_filename

    assert date_in_filename("points-20201221.csv") == date(2020, 12, 21)
    for bad in ("x.csv", "20201221-20201222.csv", "20201341.csv", "120201221.csv"):
        with pytest.raises(InputError):
            date_in_filename(bad)
