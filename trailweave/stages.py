"""Stages from staged points to tables: split, match, cells, visits, sequences.

Each stage reads tables below a root, writes its own by day beside them with a
funnel of what it kept, and records its parameters and digests. A stage refuses
to start if a day of its input is missing, and to write over a table unless told
to. Tables: points, tracks; match_points, match_edges, match_pieces, track_match;
track_cells, cell_links; visits, votes, flow_channel; sequences, patterns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.digest import unordered_digest
from .functions.scalars import utm
from .operators import gates, grid, matching, profiles, sequences, spatial, tracks, visits
from .params import DebounceParams, MatchParams, SequenceParams, SplitParams, TrackFilterParams
from .sources import files, sinks

DAY, TRACK = "source_date", ["source_date", "track_id"]
PIECE = [*TRACK, "piece"]

SPLIT_FUNNEL = [("points", "fails_points"), ("duration", "fails_duration"), ("inside", "fails_inside"), ("range", "fails_range"), ("slow", "fails_slow"), ("speed", "fails_speed")]
MATCH_FUNNEL = [("rate", "fails_rate"), ("length", "fails_length"), ("inferred", "fails_inferred"), ("inside", "fails_inside")]


def table(spark: SparkSession, root: str, name: str, days: Iterable[date]) -> DataFrame:
    """A table's rows of some days, with the day as a date."""
    return files.read_dated(spark, f"{root}/{name}", list(days))


def _start(spark: SparkSession, root: str, reads: Sequence[str], writes: Sequence[str], days: Sequence[date], overwrite: bool) -> None:
    if problems := gates.missing_days(spark, root, reads, days):
        raise files.InputError("; ".join(problems))
    if not overwrite:
        sinks.refuse_existing(spark, [f"{root}/{t}/{DAY}={d}" for t in writes for d in days])


def _write(df: DataFrame, root: str, name: str, sort: Sequence[str] = ()) -> None:
    rest = [c for c in df.columns if c != DAY]
    df.select(DAY, *rest).repartition(DAY, *[c for c in ("track_id",) if c in rest]).sortWithinPartitions(DAY, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{root}/{name}")


def _record(spark: SparkSession, root: str, stage: str, params: Mapping[str, object], names: Sequence[str], days: Sequence[date]) -> dict:
    marks = {n: list(unordered_digest(table(spark, root, n, days))) for n in names}
    sinks.write_run(str(Path(root.removeprefix("file://")) / "runs" / stage), {"days": [str(d) for d in days], **params}, gates.environment(spark, Path(__file__).parent), marks)
    return marks


def split(spark: SparkSession, inputs: Mapping[date, str], polygons, root: str, p: SplitParams = SplitParams(), f: TrackFilterParams = TrackFilterParams(), tolerance: float = 0.0, overwrite: bool = False) -> dict:
    """Points of staged CSV files, by day, as tracks: tables points, tracks, funnel_split. ``polygons`` are the study area in metres (rings of x, y)."""
    days = sorted(inputs)
    written = ["points", "tracks", "funnel_split"]
    _start(spark, root, [], written, days, overwrite)
    per_day = []
    for d in days:
        raw = files.read_points(spark, inputs[d], d)
        if problem := gates.first_row_problem(raw):
            raise files.InputError(f"{inputs[d]}: {problem}")
        per_day.append(tracks.forward_fill(raw, "source_row", "entity"))
    east, north = utm(F.col("lon"), F.col("lat"))
    points = files.union_days(per_day).withColumns({"x": east, "y": north})
    points = points.withColumn("on_area", spatial.in_polygons(polygons, tolerance)("x", "y"))
    points = tracks.split_tracks(points, p, [DAY, "entity"])
    points = points.withColumn("track_id", F.concat_ws("-", "entity", F.date_format(DAY, "yyyyMMdd"), F.lpad(F.col("track_no").cast("string"), 4, "0")))
    keep = ["source_row", "entity", "ts", "lat", "lon", "x", "y", "gap_s", "step_m", "speed_mps", "on_area"]
    _write(tracks.mark_points(points, f, TRACK, keep, inside="on_area"), root, "points", ["source_row"])
    judged = tracks.track_table(points, f, TRACK, inside="on_area")
    _write(judged, root, "tracks", ["track_id"])
    _write(tracks.funnel(table(spark, root, "tracks", days), SPLIT_FUNNEL, [DAY], "points"), root, "funnel_split", ["stage_index"])
    return _record(spark, root, "split", {"split": asdict(p), "filter": asdict(f)}, written, days)


def match(spark: SparkSession, root: str, segments: DataFrame, edges: DataFrame, days: Sequence[date], polygons=None, p: MatchParams = MatchParams(), tolerance: float = 0.0, overwrite: bool = False) -> dict:
    """Valid tracks on a road network: tables match_points, match_edges, match_pieces, track_match, funnel_match. The matcher runs once; its arrays are written and the tables made from them."""
    written = ["match_points", "match_edges", "match_pieces", "track_match", "funnel_match"]
    _start(spark, root, ["points"], written, days, overwrite)
    entering = table(spark, root, "points", days).where("is_valid_track").select(*TRACK, "source_row", "x", "y")
    raw = f"{root}/_matched"
    matching.matched(entering, matching.network_rows(segments, edges), p, TRACK, "source_row", True).write.mode("overwrite").parquet(raw)
    points, used, pieces = matching.tables_of(spark.read.parquet(raw), TRACK, "source_row")
    if polygons is not None:
        pieces = pieces.withColumn("on_area", spatial.path_inside(polygons, tolerance)("line.x", "line.y"))
    _write(points, root, "match_points", ["track_id", "source_row"])
    _write(used, root, "match_edges", ["track_id", "piece", "seq"])
    _write(pieces, root, "match_pieces", ["track_id", "piece"])
    legal = edges.select(F.col("edge_index").alias("edge"), "is_legal_direction")
    judged = matching.judge_matches(table(spark, root, "match_points", days), table(spark, root, "match_pieces", days), TRACK, "source_row", p, legal, "on_area" if polygons is not None else None)
    _write(judged, root, "track_match", ["track_id"])
    _write(tracks.funnel(table(spark, root, "track_match", days), MATCH_FUNNEL, [DAY], "points"), root, "funnel_match", ["stage_index"])
    path = spark._jvm.org.apache.hadoop.fs.Path(raw)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return _record(spark, root, "match", {"match": asdict(p)}, written, days)


def valid_pieces(spark: SparkSession, root: str, days: Sequence[date]) -> DataFrame:
    """Pieces of tracks whose match is valid."""
    valid = table(spark, root, "track_match", days).where("is_valid").select(*TRACK)
    return table(spark, root, "match_pieces", days).join(valid, TRACK, "left_semi")


def cells(spark: SparkSession, root: str, days: Sequence[date], size: float = 150.0, overwrite: bool = False) -> dict:
    """Valid pieces over the grid, and the links between cells that tracks use: tables track_cells, cell_links."""
    written = ["track_cells", "cell_links"]
    _start(spark, root, ["match_pieces", "track_match"], written, days, overwrite)
    _write(grid.traverse(matching.piece_points(valid_pieces(spark, root, days), TRACK), PIECE, "seq", size), root, "track_cells", ["track_id", "piece", "run_index"])
    _write(grid.cell_links(table(spark, root, "track_cells", days), DAY, ["track_id"], ["piece"]), root, "cell_links", ["from_x", "from_y", "to_x", "to_y"])
    return _record(spark, root, "cells", {"size": size}, written, days)


def regions(spark: SparkSession, root: str, region_cells: DataFrame, days: Sequence[date], p: DebounceParams = DebounceParams(), overwrite: bool = False) -> dict:
    """Visits of tracks to regions (cell_x, cell_y, region), what they say of passing through, and flows: tables visits, votes, flow_channel, flow_track_od, funnel_visits."""
    written = ["visits", "votes", "flow_channel", "flow_track_od", "funnel_visits"]
    _start(spark, root, ["track_cells", "match_points", "tracks"], written, days, overwrite)
    crossings = table(spark, root, "track_cells", days).join(region_cells.select("cell_x", "cell_y", "region"), ["cell_x", "cell_y"], "left")
    offsets = table(spark, root, "match_points", days).where("piece is not null").select(*PIECE, "offset_m")
    hours = table(spark, root, "tracks", days).select(*TRACK, F.hour("start_time").alias("start_hour"))
    _write(visits.debounce_pieces(crossings, offsets, PIECE, p).join(hours, TRACK), root, "visits", ["track_id", "piece", "visit_index"])
    found = table(spark, root, "visits", days)
    _write(profiles.transit_votes(found, [*TRACK, "start_hour"], ["piece", "visit_index"]), root, "votes", ["track_id", "region"])
    moves = profiles.transitions(found, PIECE, "visit_index", F.col("gap_before"))
    _write(profiles.flow_channel(moves, [DAY, "start_hour"], ["track_id"]), root, "flow_channel", ["start_hour", "from_region", "to_region"])
    at = found.withColumn("__at", F.struct("piece", "visit_index"))
    _write(profiles.flow_track_od(at, TRACK, "__at", [DAY, "start_hour"]), root, "flow_track_od", ["start_hour", "from_region", "to_region"])
    cuts = visits.piece_cuts(crossings, offsets, PIECE, p).groupBy(DAY).agg(F.count("*").alias("pieces"), F.sum("candidates").alias("candidates"), F.sum("visits").alias("visits"), F.sum("cuts").alias("cuts"))
    _write(tracks.wide_funnel(cuts, [("debounce", "candidates", "visits")], [DAY, "pieces", "cuts"]), root, "funnel_visits")
    return _record(spark, root, "regions", {"debounce": asdict(p)}, written, days)


def frequent(spark: SparkSession, root: str, codes: DataFrame, adjacency: DataFrame, days: Sequence[date], clear: Sequence[date] = (), p: SequenceParams = SequenceParams(), hours: Sequence[int] = (6, 7, 8, 9), overwrite: bool = False) -> dict:
    """Sequences of regions, and the patterns of each day and of all clear days together: tables sequences (by day) and patterns (one table, with scope)."""
    _start(spark, root, ["visits"], ["sequences"], days, overwrite)
    if not overwrite:
        sinks.refuse_existing(spark, [f"{root}/patterns"])
    found = table(spark, root, "visits", days)
    _write(sequences.cut_sequences(found, [*TRACK, "start_hour"], "piece", "visit_index", "region", "gap_before", p.min_length), root, "sequences", ["track_id", "piece", "segment_index"])
    rows = table(spark, root, "sequences", days).withColumn("day", F.col(DAY).cast("string"))
    scopes = sequences.scopes_of([str(d) for d in days], [str(d) for d in clear])
    mined = None
    for name in dict.fromkeys(s for s, _ in scopes):
        own = rows.where(F.col("day").isin([d for s, d in scopes if s == name]))
        least = sequences.support_threshold(own.count(), p)
        if least is not None:
            part = sequences.mine(own, least, p).select(F.lit(name).alias("scope"), "pattern", "support")
            mined = part if mined is None else mined.union(part)
    if mined is None:
        mined = rows.limit(0).select(F.lit("").alias("scope"), F.col("regions").alias("pattern"), F.lit(0).cast("long").alias("support"))
    of_day = spark.createDataFrame(scopes, "scope string, day string")
    out = sequences.attribute_patterns(rows, mined, of_day, adjacency, codes, hours=hours)
    sinks.write_sorted(out, f"{root}/patterns", ["scope", F.desc("support"), "pattern"], overwrite)
    return _record(spark, root, "sequences", {"sequences": asdict(p)}, ["sequences"], days) | {"patterns": list(unordered_digest(spark.read.parquet(f"{root}/patterns")))}
