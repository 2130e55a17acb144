"""Map matching: hidden Markov model over road candidates, many tracks at a time.

Candidates of all points of a batch are found together, by cell of the search
radius. Ways between nodes come from a table of all pairs within the cut-off,
grown by Dijkstra's rule from the nodes that a batch needs. The dynamic program
then goes through the points of all tracks in step: each step is one array of
tracks x candidates x candidates.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import MatchParams

#: Segments that a network may have to be sent to every worker; a larger one has to be cut by area first.
MAX_SEGMENTS = 5_000_000
FAR = 1e300


class Roads:
    """Directed edges with straight or bent geometry. Edge 2 * segment + direction; direction 1 runs against the segment.

    ``segments`` are (segment, first node, last node, line, legal along, legal
    against). Within this class nodes and edges have dense numbers.
    """

    def __init__(self, segments: Sequence[tuple[int, int, int, Sequence[tuple[float, float]], bool, bool]], p: MatchParams):
        self.p = p
        rows = sorted(segments, key=lambda s: s[0])
        n = len(rows)
        self.lines = [np.asarray(s[3], float) for s in rows]
        nodes = {x: i for i, x in enumerate(sorted({x for s in rows for x in s[1:3]}))}
        ends = np.array([(nodes[s[1]], nodes[s[2]]) for s in rows], np.int64).reshape(-1, 2)
        self.nodes, self.n_nodes = nodes, max(1, len(nodes))
        self.tail, self.head = ends.reshape(-1), ends[:, ::-1].reshape(-1)
        self.length = np.repeat([float(np.hypot(*np.diff(x, axis=0).T).sum()) for x in self.lines], 2)
        self.legal = np.array([s[4:6] for s in rows], bool).reshape(-1)
        self.edge = np.array([2 * s[0] + d for s in rows for d in (0, 1)], np.int64)
        self.out: dict[int, list[tuple[int, float, int]]] = {}
        for e in range(2 * n):
            self.out.setdefault(int(self.tail[e]), []).append((int(self.head[e]), float(self.length[e]), e))
        self.cells: dict[tuple[int, int], set[int]] = {}
        r = p.radius_m
        for k, pts in enumerate(self.lines):
            for (x0, y0), (x1, y1) in zip(pts[:-1], pts[1:], strict=True):
                for i in range(math.floor(min(x0, x1) / r) - 1, math.floor(max(x0, x1) / r) + 2):
                    for j in range(math.floor(min(y0, y1) / r) - 1, math.floor(max(y0, y1) / r) + 2):
                        self.cells.setdefault((i, j), set()).add(k)
        self.near: dict[tuple[int, int], tuple | None] = {}
        self.known = np.zeros(self.n_nodes, bool)
        self.keys, self.ways = np.zeros(0, np.int64), np.zeros(0)
        self.routes: dict[tuple[int, int], list[int] | None] = {}

    def _around(self, cell: tuple[int, int]) -> tuple | None:
        """Straight legs of the segments near a cell as arrays, by segment: start, direction, squared length, length, place of the start, first leg of each segment, legs of each, segments."""
        if cell not in self.near:
            segs = sorted(self.cells.get(cell, ()))
            if not segs:
                self.near[cell] = None
            else:
                lines = [self.lines[s] for s in segs]
                a = np.concatenate([x[:-1] for x in lines])
                d = np.concatenate([np.diff(x, axis=0) for x in lines])
                size = np.hypot(d[:, 0], d[:, 1])
                at = np.concatenate([np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(x, axis=0).T))[:-1]]) for x in lines])
                legs = np.array([len(x) - 1 for x in lines])
                self.near[cell] = a, d, np.where(size > 0, size * size, 1.0), size, at, np.cumsum(legs) - legs, legs, np.array(segs)
        return self.near[cell]

    def candidates(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, edge, place along it) of the nearest segments of each point, both directions; by distance, then segment, then direction. Edge -1 where there are no more."""
        k = self.p.candidates
        dist, edge, along = np.full((len(xy), k), np.inf), np.full((len(xy), k), -1, np.int64), np.zeros((len(xy), k))
        cells = np.floor(xy / self.p.radius_m).astype(np.int64)
        order = np.lexsort((cells[:, 1], cells[:, 0]))
        changes = np.flatnonzero(np.any(np.diff(cells[order], axis=0) != 0, axis=1)) + 1
        for own in np.split(order, changes) if len(xy) else ():
            found = self._around((int(cells[own[0], 0]), int(cells[own[0], 1])))
            if found is None:
                continue
            a, d, size2, size, at, first, legs, segs = found
            for part in np.split(own, range(4096, len(own), 4096)):
                rel = xy[part][:, None, :] - a
                t = np.clip((rel[..., 0] * d[:, 0] + rel[..., 1] * d[:, 1]) / size2, 0.0, 1.0)
                away = np.hypot(rel[..., 0] - t * d[:, 0], rel[..., 1] - t * d[:, 1])
                least = np.minimum.reduceat(away, first, axis=1)
                best = np.argsort(least, axis=1, kind="stable")[:, :k]
                leg = np.minimum.reduceat(np.where(away == np.repeat(least, legs, axis=1), np.arange(len(a)), len(a)), first, axis=1)
                rows = np.arange(len(part))[:, None]
                m, leg = least[rows, best], leg[rows, best]
                near = m <= self.p.radius_m
                put = part[:, None], np.arange(best.shape[1])[None, :]
                dist[put], edge[put] = np.where(near, m, np.inf), np.where(near, 2 * segs[best], -1)
                along[put] = at[leg] + t[rows, leg] * size[leg]
        both = np.repeat(edge, 2, axis=1)
        back = np.tile([False, True], k)
        places = np.repeat(along, 2, axis=1)
        both = np.where((both >= 0) & back, both + 1, both)
        places = np.where(back, self.length[both] - places, places) if len(self.length) else places
        return np.repeat(dist, 2, axis=1), both, places

    def _learn(self, sources: np.ndarray) -> None:
        """Ways from more nodes to all within the cut-off."""
        new = np.unique(sources)
        new = new[~self.known[new]]
        if not len(new):
            return
        keys, ways = [self.keys], [self.ways]
        for a in new.tolist():
            done: dict[int, float] = {}
            heap = [(0.0, a)]
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done[x] = d
                for y, size, _ in self.out.get(x, ()):
                    if y not in done and d + size <= self.p.cutoff_m:
                        heapq.heappush(heap, (d + size, y))
            keys.append(a * self.n_nodes + np.fromiter(done.keys(), np.int64, len(done)))
            ways.append(np.fromiter(done.values(), float, len(done)))
        self.known[new] = True
        keys, ways = np.concatenate(keys), np.concatenate(ways)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ways = keys[order], ways[order]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shortest way from node to node, infinite beyond the cut-off."""
        self._learn(a)
        key = a * self.n_nodes + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ways[at], np.inf)

    def moves(self, e: np.ndarray, s: np.ndarray, f: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Length of the way from a place on one edge to a place on another; infinite if there is none."""
        over = self.length[e] - s + self.between(self.head[e], self.tail[f]) + t
        return np.where(e == f, np.where(t - s < -self.p.backtrack_m, np.inf, np.maximum(0.0, t - s)), over)

    def emission(self, dist: np.ndarray, edge: np.ndarray) -> np.ndarray:
        at = np.where(edge >= 0, -np.square(np.where(edge >= 0, dist, 0.0)) / (2 * self.p.sigma_m**2), -FAR)
        return at - np.where((edge >= 0) & ~self.legal[edge], self.p.contraflow_penalty, 0.0) if len(self.legal) else at

    def viterbi(self, xy: np.ndarray, dist: np.ndarray, edge: np.ndarray, along: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Chosen candidate of each point of the stretches that begin at ``first`` with ``size`` points; the first of equal ones."""
        chosen = np.zeros(len(xy), np.int64)
        if not len(first):
            return chosen
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        emit = self.emission(dist, edge)
        back = np.zeros(edge.shape, np.int64)
        score = emit[first]
        last = np.zeros((len(first), edge.shape[1]))
        longest = int(size[0])
        for step in range(1, longest):
            live = int(np.searchsorted(-size, -step, side="left"))  # stretches with more points than ``step``
            ended = slice(live, len(score))
            last[ended] = score[ended]
            i = first[:live] + step
            e, f = edge[i - 1][:, :, None], edge[i][:, None, :]
            real = np.nonzero((e >= 0) & (f >= 0))
            rows, p, q = real
            gone = np.hypot(*(xy[i] - xy[i - 1]).T)
            way = self.moves(edge[i - 1][rows, p], along[i - 1][rows, p], edge[i][rows, q], along[i][rows, q])
            cost = np.full((live, edge.shape[1], edge.shape[1]), FAR)
            cost[real] = np.where(np.isinf(way), self.p.no_path_cost, np.abs(np.where(np.isinf(way), 0.0, way) - gone[rows]) / self.p.beta_m)
            ways = score[:live, :, None] - cost + emit[i][:, None, :]
            back[i] = ways.argmax(axis=1)
            score = np.take_along_axis(ways, back[i][:, None, :], axis=1)[:, 0, :]
        last[: len(score)] = score
        state = last.argmax(axis=1)
        for step in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-size, -step, side="left"))
            i = first[:live] + step
            chosen[i] = state[:live]
            state[:live] = back[i, state[:live]]
        return chosen

    def match_all(self, xy: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Matches of the points of many tracks, one after another: edge (dense, -1 if none), snap, along, piece within the track (-1 if none), offset in the piece, and the inferred metres before the point.

        A point without candidates parts stretches. Where there is no way on, a new
        piece begins; a piece without any length is none, though its points keep
        their edges.
        """
        n = len(xy)
        dist, edge, along = self.candidates(xy)
        track = np.repeat(np.arange(len(sizes)), sizes)
        has = edge[:, 0] >= 0 if n else np.zeros(0, bool)
        opens = has & ~(np.concatenate([[False], has[:-1]]) & np.concatenate([[False], track[1:] == track[:-1]])) if n else has
        first = np.flatnonzero(opens)
        stretch = np.cumsum(opens) - 1
        size = np.bincount(stretch[has], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        k = self.viterbi(xy, dist, edge, along, first, size)
        rows = np.arange(n)
        e = np.where(has, edge[rows, k], -1) if n else np.zeros(0, np.int64)
        snap, place = (dist[rows, k], along[rows, k]) if n else (np.zeros(0), np.zeros(0))
        step, inferred = np.zeros(n), np.zeros(n)
        goes_on = np.flatnonzero(has & ~opens)
        way = self.moves(e[goes_on - 1], place[goes_on - 1], e[goes_on], place[goes_on]) if len(goes_on) else np.zeros(0)
        new = opens.copy()
        new[goes_on[np.isinf(way)]] = True
        linked, way = goes_on[np.isfinite(way)], way[np.isfinite(way)]
        step[linked] = way
        over = linked[e[linked - 1] != e[linked]]
        inferred[over] = self.between(self.head[e[over - 1]], self.tail[e[over]]) if len(over) else 0.0
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        offset = np.zeros(n)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=False):
            offset[a:b] = np.cumsum(step[a:b])  # by piece, so that a sum never depends on the other tracks of a batch
        long_enough = np.zeros(len(starts), bool)
        np.logical_or.at(long_enough, run[has], step[has] > 1e-9)
        number = np.cumsum(long_enough) - long_enough
        before = np.zeros(len(sizes) + 1, np.int64)
        if len(starts):
            np.add.at(before, track[starts] + 1, long_enough)
        before = np.cumsum(before)
        whole = has & (long_enough[run] if len(starts) else False)
        piece = np.where(whole, (number[run] if len(starts) else 0) - before[track], -1)
        return {"edge": e, "snap_m": snap, "along_m": place, "piece": piece, "offset_m": offset, "inferred_m": np.where(whole, inferred, 0.0)}

    def way(self, a: int, b: int) -> list[int]:
        """Edges of the shortest way from node to node; of parallel or equally long ones the smallest edge."""
        if (a, b) not in self.routes:
            done: set[int] = set()
            heap: list[tuple[float, int, tuple]] = [(0.0, a, ())]
            while heap:
                d, x, back = heapq.heappop(heap)
                if x == b:
                    edges = []
                    while back:
                        edges.append(back[0])
                        back = back[1]
                    self.routes[a, b] = edges[::-1]
                    break
                if x in done:
                    continue
                done.add(x)
                for y, size, e in self.out.get(x, ()):
                    if y not in done and d + size <= self.p.cutoff_m:
                        heapq.heappush(heap, (d + size, y, (e, back)))
        return self.routes[a, b]

    def stretch_of(self, e: int, start: float, end: float) -> np.ndarray:
        """Vertices of an edge between two places along it."""
        pts = self.lines[e // 2][:: 1 - 2 * (e % 2)]
        marks = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(pts, axis=0).T))])
        at = np.concatenate([[start], marks[(marks > start + 1e-9) & (marks < end - 1e-9)], [end]])
        return np.stack([np.interp(at, marks, pts[:, 0]), np.interp(at, marks, pts[:, 1])], axis=1)

    def paths(self, found: dict[str, np.ndarray], low: int, high: int) -> tuple[list[tuple], list[tuple]]:
        """Edges (piece, seq, edge, start, end, inferred) and pieces (piece, line, length, observed, inferred length) of one track's points low to high."""
        edges, pieces = [], []
        own = [i for i in range(low, high) if found["piece"][i] >= 0]
        at = 0
        while at < len(own):
            piece = int(found["piece"][own[at]])
            stop = at
            while stop < len(own) and found["piece"][own[stop]] == piece:
                stop += 1
            rows: list[tuple[int, float, float, bool]] = []
            for i, j in zip(own[at : stop - 1], own[at + 1 : stop], strict=True):
                e, f, s, t = int(found["edge"][i]), int(found["edge"][j]), float(found["along_m"][i]), float(found["along_m"][j])
                if e == f:
                    rows.append((e, s, max(s, t), False))
                else:
                    rows.append((e, s, float(self.length[e]), False))
                    rows += [(c, 0.0, float(self.length[c]), True) for c in self.way(int(self.head[e]), int(self.tail[f]))]
                    rows.append((f, 0.0, t, False))
            parts = [self.stretch_of(e, a, b) for e, a, b, _ in rows if b - a > 1e-9]
            line = np.concatenate(parts)
            line = line[np.concatenate([[True], (np.diff(line, axis=0) != 0).any(axis=1)])]
            seen, guessed = (sum(b - a for _, a, b, i in rows if i == kind) for kind in (False, True))
            edges += [(piece, seq, int(self.edge[e]), a, b, i) for seq, (e, a, b, i) in enumerate(rows)]
            pieces.append((piece, line, seen + guessed, seen, guessed))
            at = stop
        return edges, pieces


def network_rows(segments: DataFrame, edges: DataFrame) -> list[tuple]:
    """Segments for ``Roads`` from the tables of ``network.build_network``, in order of segment_id. A network is as large as its map; more than MAX_SEGMENTS are refused, not cut."""
    of = edges.groupBy("segment_id").agg(
        F.max(F.when(F.col("direction") == 0, F.col("u"))).alias("u"), F.max(F.when(F.col("direction") == 0, F.col("v"))).alias("v"),
        F.max(F.when(F.col("direction") == 0, F.col("is_legal_direction"))).alias("forth"), F.max(F.when(F.col("direction") == 1, F.col("is_legal_direction"))).alias("back"),
    )
    rows = segments.select("segment_id", "line").join(of, "segment_id").orderBy("segment_id").limit(MAX_SEGMENTS + 1).collect()
    if len(rows) > MAX_SEGMENTS:
        raise ValueError(f"a network of more than {MAX_SEGMENTS} segments has to be cut by area before it is sent to workers")
    return [(r["segment_id"], r["u"], r["v"], [(p["x"], p["y"]) for p in r["line"]], r["forth"], r["back"]) for r in rows]


_ROADS: dict[str, Roads] = {}


def matched(points: DataFrame, segments: Sequence[tuple], p: MatchParams, key: Sequence[str], order: str, with_paths: bool) -> DataFrame:
    """Key, ``o`` (the order's values) and ``m``: one struct of arrays for each track. ``segments`` is a road network of checked size, sent once to each worker."""
    shared = points.sparkSession.sparkContext.broadcast(list(segments))
    name = uuid.uuid4().hex
    point = "edge:array<long>,snap_m:array<double>,along_m:array<double>,piece:array<int>,offset_m:array<double>,inferred_m:array<double>"
    path = ",e_piece:array<int>,e_seq:array<int>,e_edge:array<long>,e_start:array<double>,e_end:array<double>,e_inferred:array<boolean>,p_piece:array<int>,p_x:array<array<double>>,p_y:array<array<double>>,p_length:array<double>,p_observed:array<double>,p_inferred:array<double>"

    @F.pandas_udf(f"struct<{point}{path if with_paths else ''}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        roads = _ROADS.get(name)
        if roads is None:
            _ROADS.clear()
            roads = _ROADS[name] = Roads(shared.value, p)
        for xs, ys in batches:
            if not len(xs):
                continue
            sizes = np.array([len(x) for x in xs], np.int64)
            xy = np.stack([np.concatenate(xs.to_list()), np.concatenate(ys.to_list())], axis=1).astype(float) if len(xs) else np.zeros((0, 2))
            found = roads.match_all(xy, sizes)
            stops = np.cumsum(sizes)
            shown = found | {"edge": np.where(found["edge"] >= 0, roads.edge[found["edge"]], -1) if len(roads.edge) else found["edge"], "piece": found["piece"].astype(np.int32)}
            out = {c: np.split(v, stops[:-1]) for c, v in shown.items()}
            if with_paths:
                made = [roads.paths(found, int(b - n), int(b)) for n, b in zip(sizes, stops, strict=True)]
                for i, c in enumerate(("e_piece", "e_seq", "e_edge", "e_start", "e_end", "e_inferred")):
                    out[c] = [[r[i] for r in e] for e, _ in made]
                out["p_piece"] = [[r[0] for r in q] for _, q in made]
                for i, c in enumerate(("p_x", "p_y")):
                    out[c] = [[r[1][:, i].tolist() for r in q] for _, q in made]
                for i, c in enumerate(("p_length", "p_observed", "p_inferred"), 2):
                    out[c] = [[float(r[i]) for r in q] for _, q in made]
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    # Few bytes, much work: as many tasks as the session has partitions, whatever the size.
    dealt = points.select(*key, order, "x", "y").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    tracks = dealt.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "x", "y"))).alias("p"))
    return tracks.select(*key, F.col(f"p.{order}").alias("o"), run.asNondeterministic()(F.col("p.x"), F.col("p.y")).alias("m"))


def _points(done: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    z = F.arrays_zip("o", "m.edge", "m.snap_m", "m.along_m", "m.piece", "m.offset_m", "m.inferred_m")
    rows = done.select(*key, F.explode(z).alias("z"))
    on, whole = F.col("z.edge") >= 0, F.col("z.piece") >= 0
    return rows.select(*key, F.col("z.o").alias(order), F.when(on, F.col("z.edge")).alias("edge"), F.when(on, F.col("z.snap_m")).alias("snap_m"), F.when(on, F.col("z.along_m")).alias("along_m"), F.when(whole, F.col("z.piece")).alias("piece"), F.when(whole, F.col("z.offset_m")).alias("offset_m"), F.col("z.inferred_m").alias("inferred_m"))


def match_tracks(points: DataFrame, segments: Sequence[tuple], p: MatchParams, key: Sequence[str], order: str) -> DataFrame:
    """Matched points of each track: key, order, edge, snap_m, along_m, piece, offset_m, inferred_m (metres of connecting edges before the point). Points without a candidate have nulls; those of a piece without length have an edge but no piece."""
    return _points(matched(points, segments, p, key, order, False), key, order)


def match_tables(points: DataFrame, segments: Sequence[tuple], p: MatchParams, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, edges, pieces) of matched tracks.

    Edges: key, piece, seq, edge, start_m, end_m, is_inferred: what each step
    rides over, the rest of an edge, connecting edges, the beginning of the next.
    Pieces: key, piece, line (array of x, y), length_m, observed_m, inferred_m.
    Each table runs the matcher when it is read; write them, or persist what is
    read more than once.
    """
    return tables_of(matched(points, segments, p, key, order, True), key, order)


def tables_of(done: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, edges, pieces) from what ``matched`` returned with paths."""
    e = done.select(*key, F.explode(F.arrays_zip("m.e_piece", "m.e_seq", "m.e_edge", "m.e_start", "m.e_end", "m.e_inferred")).alias("z"))
    edges = e.select(*key, *[F.col(f"z.{a}").alias(b) for a, b in (("e_piece", "piece"), ("e_seq", "seq"), ("e_edge", "edge"), ("e_start", "start_m"), ("e_end", "end_m"), ("e_inferred", "is_inferred"))])
    q = done.select(*key, F.explode(F.arrays_zip("m.p_piece", "m.p_x", "m.p_y", "m.p_length", "m.p_observed", "m.p_inferred")).alias("z"))
    line = F.transform(F.arrays_zip(F.col("z.p_x").alias("x"), F.col("z.p_y").alias("y")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    pieces = q.select(*key, F.col("z.p_piece").alias("piece"), line.alias("line"), F.col("z.p_length").alias("length_m"), F.col("z.p_observed").alias("observed_m"), F.col("z.p_inferred").alias("inferred_m"))
    return _points(done, key, order), edges, pieces


def piece_points(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """Vertices of each piece in order: key, piece, seq, x, y; the input of ``grid.traverse``."""
    return pieces.select(*key, "piece", F.posexplode("line").alias("seq", "v")).select(*key, "piece", "seq", "v.x", "v.y")


def judge_matches(points: DataFrame, pieces: DataFrame, key: Sequence[str], order: str, p: MatchParams, legal: DataFrame | None = None, inside: str | None = None) -> DataFrame:
    """Rates, lengths and independent flags of each matched track.

    ``legal`` (edge, is_legal_direction) counts points against the legal
    direction; it is as large as the map and left to Spark's size check.
    ``inside`` names a boolean column of ``pieces`` that is false for a path off
    the area. A path break is a change of piece between matched neighbours.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    held = F.when(F.col("edge").isNotNull(), F.coalesce("piece", F.lit(-1)))
    rows = points.withColumn("is_path_break", F.coalesce(held != F.lag(held).over(w), F.lit(False)))
    rows = rows.join(legal.select("edge", "is_legal_direction"), "edge", "left") if legal is not None else rows.withColumn("is_legal_direction", F.lit(True))
    rates = rows.groupBy(*key).agg(F.count("*").alias("points"), F.count("edge").alias("matched_points"), F.count_if("is_path_break").alias("path_breaks"), F.count_if(F.col("is_legal_direction") == F.lit(False)).alias("contraflow_points"))
    lengths = pieces.groupBy(*key).agg(F.count("*").alias("pieces"), *[F.sum(c).alias(c) for c in ("length_m", "observed_m", "inferred_m")], (F.bool_and(inside) if inside else F.lit(True)).alias("path_inside"))
    out = rates.join(lengths, list(key), "left").fillna(0, ["length_m", "observed_m", "inferred_m", "pieces"]).fillna(True, ["path_inside"])
    out = out.withColumns({"match_rate": F.col("matched_points") / F.col("points"), "inferred_share": F.when(F.col("length_m") > 0, F.col("inferred_m") / F.col("length_m")).otherwise(1.0)})
    out = out.withColumns({"fails_rate": F.col("match_rate") < p.min_match_rate, "fails_length": F.col("length_m") < p.min_length_m, "fails_inferred": F.col("inferred_share") > p.max_inferred_share, "fails_inside": ~F.col("path_inside")})
    return out.withColumn("is_valid", ~(F.col("fails_rate") | F.col("fails_length") | F.col("fails_inferred") | F.col("fails_inside")))
