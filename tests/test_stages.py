"""Stages from files to patterns on two small days, and partitions of several days."""

import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from trailweave import stages
from trailweave.operators import community
from trailweave.operators.network import AccessRules, build_network
from trailweave.params import MatchParams, SequenceParams
from trailweave.sources.files import InputError

DAYS = [date(2020, 12, 21), date(2020, 12, 22)]


def lonlat(x, y):
    """Degrees of a place near 118.1, 24.5, close enough for a test that reads x and y back."""
    return 118.1 + x / 101300.0, 24.5 + y / 110800.0


def write_day(path, day, bikes):
    rows = ["source_row,BICYCLE_ID,LOCATING_TIME,LATITUDE,LONGITUDE"]
    for name, (x, y) in bikes.items():
        for i in range(12):
            lon, lat = lonlat(x + 60 * i, y)
            rows.append(f"{len(rows)},{name if i == 0 else ''}, 0{6 + (name == 'b')}:{i // 2:02d}:{30 * (i % 2):02d},{lat:.7f},{lon:.7f}")
    path.write_text("\n".join(rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    from trailweave.functions.scalars import utm

    base = tmp_path_factory.mktemp("stages")
    inputs = {d: write_day(base / f"points-{d:%Y%m%d}.csv", d, {"a": (0, 3), "b": (30, 3), "far": (0, 900)}) for d in DAYS}
    lon, lat = lonlat(-200, 0)
    end = lonlat(1000, 0)
    p = spark.range(1).select(*[c.alias(n) for n, c in zip("abcd", [*utm(F.lit(lon), F.lit(lat)), *utm(F.lit(end[0]), F.lit(end[1]))])]).first()
    area = [[[(p.a - 500, p.b - 300), (p.c + 500, p.b - 300), (p.c + 500, p.d + 300), (p.a - 500, p.d + 300), (p.a - 500, p.b - 300)]]]
    out = str(base / "out")
    done = {"split": stages.split(spark, inputs, area, out)}
    nodes = spark.createDataFrame([(i, p.a + (p.c - p.a) * i / 4, p.b + (p.d - p.b) * i / 4) for i in range(5)], "id long, x double, y double")
    ways = spark.createDataFrame([(1, {"highway": "path"}, [0, 1, 2, 3, 4])], "osmid long, tags map<string,string>, refs array<long>")
    segments, edges = build_network(ways, nodes, AccessRules())
    done["match"] = stages.match(spark, out, segments, edges, DAYS, area, MatchParams())
    done["cells"] = stages.cells(spark, out, DAYS, 150.0)
    found = stages.table(spark, out, "track_cells", DAYS).select("cell_x", "cell_y").distinct()
    low = found.agg(F.min("cell_x")).first()[0]
    regions = found.withColumn("region", F.floor((F.col("cell_x") - low) / 2).cast("int"))
    done["regions"] = stages.regions(spark, out, regions, DAYS)
    codes = regions.select("region").distinct().select("region", F.concat(F.lit("r"), "region").alias("code"), F.lit(1).alias("district"))
    adjacency = spark.createDataFrame([(i, i + 1) for i in range(9)], "a int, b int")
    done["sequences"] = stages.frequent(spark, out, codes, adjacency, DAYS, DAYS, SequenceParams(support_floor=2))
    return out, inputs, area, done, regions


def test_split_tables(spark, root):
    out, inputs, area, done, _ = root
    tracks = {(r.source_date, r.entity): r for r in stages.table(spark, out, "points", DAYS).groupBy("source_date", "entity").agg(F.count("*").alias("n"), F.bool_and("is_valid_track").alias("v"), F.count_distinct("track_id").alias("t")).collect()}
    assert {k: (r.n, r.v, r.t) for k, r in tracks.items()} == {(d, e): (12, e != "far", 1) for d in DAYS for e in ("a", "b", "far")}
    funnel = [(r.stage_name, r.entered, r.kept) for r in stages.table(spark, out, "funnel_split", DAYS[:1]).orderBy("stage_index").collect()]
    assert funnel[0] == ("points", 3, 3) and funnel[2] == ("inside", 3, 2) and funnel[-1][2] == 2
    with pytest.raises(InputError, match="already"):
        stages.split(spark, inputs, area, out)
    with pytest.raises(InputError, match="2020-12-25"):
        stages.cells(spark, out, [date(2020, 12, 25)])
    again = stages.split(spark, {DAYS[0]: inputs[DAYS[0]]}, area, out, overwrite=True)
    assert again["points"][0] == 36 and stages.table(spark, out, "points", DAYS).count() == 72
    record = json.loads(open(f"{out}/runs/match/params.json").read())
    assert record["days"] == [str(d) for d in DAYS] and record["match"]["radius_m"] == 60.0
    assert json.loads(open(f"{out}/runs/match/digests.json").read())["track_match"] == done["match"]["track_match"]


def test_match_to_patterns(spark, root):
    out, _, _, done, regions = root
    judged = stages.table(spark, out, "track_match", DAYS).collect()
    assert len(judged) == 4 and all(r.is_valid and r.match_rate == 1 and r.pieces == 1 and abs(r.length_m - 660) < 5 for r in judged)
    assert {r.stage_name: r.kept for r in stages.table(spark, out, "funnel_match", DAYS[:1]).collect()} == {"rate": 2, "length": 2, "inferred": 2, "inside": 2}
    links = stages.table(spark, out, "cell_links", DAYS[:1]).collect()
    assert links and all(r.tracks in (1, 2) and abs(r.from_x - r.to_x) + abs(r.from_y - r.to_y) == 1 for r in links)
    visits = stages.table(spark, out, "visits", DAYS).collect()
    assert {r.start_hour for r in visits} == {6, 7} and not any(r.gap_before for r in visits)
    assert math.isclose(sum(r.length_m for r in visits), sum(r.length_m for r in judged), rel_tol=1e-3)
    assert stages.table(spark, out, "flow_channel", DAYS).count() > 0 and stages.table(spark, out, "votes", DAYS).where("is_transit").count() > 0
    pats = spark.read.parquet(f"{out}/patterns").collect()
    assert {r.scope for r in pats} == {"clear-days", *map(str, DAYS)} and all(r.contained == r.support and r.hour_06 + r.hour_07 == r.contained for r in pats)
    steps = [r for r in pats if len(r.pattern) == 2 and r.pattern[1] == r.pattern[0] + 1]
    assert steps and all(r.all_steps_adjacent and r.codes == [f"r{x}" for x in r.pattern] for r in steps)
    assert any(not r.all_steps_adjacent for r in pats)


def test_granularity_and_folds(spark):
    block = lambda g: [(g * 4 + i, j) for i in range(4) for j in range(4)]
    day = [(a, b, 9.0 + (a[0] + b[1]) % 3) for g in range(3) for a in block(g) for b in block(g) if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1] + [((3, 0), (4, 0), 1.0), ((7, 3), (8, 3), 1.0)]
    by_day = {d: [(s, t, w + i) for s, t, w in day] for i, d in enumerate("abcd")}
    rows = community.granularity(spark, by_day, [0.8, 1.0], (42, 43), least=4, trials=2)
    assert [r["markov_time"] for r in rows] == [0.8, 1.0]
    assert all(r["regions"] >= 3 and 0.5 < r["ami"] <= 1 and abs(r["excess"] - (r["ami"] - r["null_ami"])) < 1e-12 for r in rows)
    folds = community.fold_arms(spark, by_day, 2, 1.0, least=4, trials=2)
    assert len(folds) == 3 and all(f["ami"] > 0.5 and f["null_ami"] is not None for f in folds)
    assert community.similarity({(0, 0): 1}, {(0, 0): 1}) is None and community.similarity({(i, 0): 1 for i in range(5)}, {(i, 0): 2 for i in range(5)}) == 1.0
    halves, thirds = {(i, 0): i // 6 for i in range(12)}, {(i, 0): i // 4 for i in range(12)}
    assert 0 < community.similarity(halves, thirds) < 1 and community.similarity(halves, {(i, 0): i % 2 for i in range(12)}) < 0.05
