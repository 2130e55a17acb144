"""Timed trajectories: road vertices get times by mileage between observations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metres by which offsets may differ and still be the same place.
SAME = 1e-6


def interpolate(line: np.ndarray, offsets: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, str | None]:
    """(rows of x, y, microseconds; None) of a line and the observed places on it, or (no rows, what is wrong).

    Observed times stay as they are. A vertex between two observations has a time
    linear in mileage, rounded to a microsecond, after the row before it and before
    the next observation; observations at a vertex take its place.
    """
    none = np.zeros((0, 3))
    if not len(offsets) or not np.isfinite(offsets).all():
        return none, "offsets must be finite"
    order = np.argsort(times, kind="stable")
    offsets, times = offsets[order].copy(), times[order]
    if (np.diff(times) <= 0).any():
        return none, "times must increase"
    back = np.flatnonzero(np.diff(offsets) < 0)
    for i in back:
        if abs(offsets[i + 1] - offsets[i]) > SAME:
            return none, "offsets must not decrease"
        offsets[i + 1] = offsets[i]
    if len(line) < 2 or not (size := np.hypot(*np.diff(line, axis=0).T)).sum() > 0:
        if len(line) and len(offsets) == 1 and abs(offsets[0]) <= SAME:
            return np.array([[*line[0], times[0]]]), None
        return none, "a line needs a length"
    marks = np.concatenate([[0.0], np.cumsum(size)])
    if abs(offsets[0]) > SAME or abs(offsets[-1] - marks[-1]) > max(SAME, 1e-9 * marks[-1]):
        return none, "observations must begin and end with the line"
    near = np.abs(marks[None, :] - offsets[:, None]).argmin(axis=1)
    offsets = np.where(np.abs(marks[near] - offsets) <= np.maximum(SAME, 1e-9 * offsets), marks[near], offsets)
    inner = np.arange(1, len(marks) - 1)
    after = np.searchsorted(offsets, marks[inner], side="left")
    between = (after > 0) & (after < len(offsets))
    inner, after = inner[between], after[between]
    inner, after = inner[offsets[after] != marks[inner]], after[offsets[after] != marks[inner]]
    start, end = after - 1, after
    part = (marks[inner] - offsets[start]) / (offsets[end] - offsets[start])
    t = times[start] + np.rint((times[end] - times[start]) * part).astype(np.int64)
    t = np.minimum(t, times[end] - 1)
    for i in range(len(t)):  # at least a microsecond after the row before
        floor = times[start[i]] if i == 0 or after[i - 1] != after[i] else t[i - 1]
        t[i] = max(t[i], floor + 1)
        if t[i] >= times[end[i]]:
            return none, "no room for the times of vertices"
    seen = np.stack([np.interp(offsets, marks, line[:, 0]), np.interp(offsets, marks, line[:, 1]), times.astype(np.float64)], axis=1)
    rows = np.concatenate([seen, np.concatenate([line[inner], t[:, None].astype(np.float64)], axis=1)])
    return rows[np.argsort(np.concatenate([times, t]), kind="stable")], None


def trajectories(pieces: DataFrame, key: Sequence[str], piece: str | None = None) -> DataFrame:
    """Timed points of each piece, a sequence of its own: key, piece, trajectory (array of x, y, us), problem.

    ``pieces`` has line (array of x, y) and seen (array of offset_m, us). A piece
    that breaks a rule has a null trajectory and the rule as problem: observed
    times must increase, also from piece to piece of a track; offsets must be
    finite, not decrease, begin at 0 and end with the line; a line needs a length,
    unless it is one place with one observation.
    """

    @F.pandas_udf("struct<x:array<double>,y:array<double>,us:array<long>,problem:string>")
    def run(xs: pd.Series, ys: pd.Series, offsets: pd.Series, times: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, o, t in zip(xs, ys, offsets, times, strict=True):
            line = np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1)
            us = np.asarray(t, np.int64)
            origin = int(us.min()) if len(us) else 0
            rows, problem = interpolate(line, np.asarray(o, float), us - origin)
            out.append((None, None, None, problem) if problem else (rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int64) + origin, None))
        return pd.DataFrame(out, columns=["x", "y", "us", "problem"])

    at = [*key, *([piece] if piece else [])]
    done = pieces.select(*at, F.array_max("seen.us").alias("__last"), F.array_min("seen.us").alias("__first"), run.asNondeterministic()(F.col("line.x"), F.col("line.y"), F.col("seen.offset_m"), F.col("seen.us")).alias("__t"))
    problem = F.col("__t.problem")
    if piece:
        late = F.col("__first") <= F.lag("__last").over(Window.partitionBy(*key).orderBy(piece))
        problem = F.coalesce(problem, F.when(late, "times must increase from piece to piece"))
    done = done.withColumn("problem", problem)
    points = F.transform(F.arrays_zip("__t.x", "__t.y", "__t.us"), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["us"].alias("us")))
    return done.select(*at, F.when(F.col("problem").isNull(), points).alias("trajectory"), "problem")
