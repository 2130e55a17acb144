"""Nodes, ways and relations of OpenStreetMap PBF files as a DataFrame.

Spark reads the files from any store; a task cuts them into their compressed
blocks, and blocks are decoded in parallel. The format is the public one: a
length, a block header, a block; protocol-buffer fields inside.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "kind string, id long, tags map<string,string>, lat double, lon double, refs array<long>, members array<struct<kind:string,id:long,role:string>>"


def fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a message; bytes for length-delimited ones."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, bytes(data[at : at + size])
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


def packed(data: memoryview | int | None, signed: bool = False, delta: bool = False) -> list[int]:
    """Numbers of a packed field, zigzag if signed, summed up if delta."""
    if data is None:
        return []
    if isinstance(data, int):
        raw = np.array([data], np.uint64)
    else:
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return []
        ends = np.flatnonzero(b < 128)
        starts = np.concatenate([[0], ends[:-1] + 1])
        within = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
        raw = np.add.reduceat((b & 127).astype(np.uint64) << (7 * within).astype(np.uint64), starts)
    out = (raw >> np.uint64(1)).astype(np.int64) ^ -(raw & np.uint64(1)).astype(np.int64) if signed else raw.astype(np.int64)
    return (np.cumsum(out) if delta else out).tolist()


def blocks(raw: bytes) -> Iterator[bytes]:
    """Compressed data blocks of a file."""
    at = 0
    while at + 4 <= len(raw):
        size = struct.unpack_from(">I", raw, at)[0]
        head = dict(fields(memoryview(raw)[at + 4 : at + 4 + size]))
        at += 4 + size
        if bytes(head[1]) == b"OSMData":
            yield raw[at : at + head[3]]
        at += head[3]


def elements(block: bytes) -> Iterator[tuple]:
    """Rows (kind, id, tags, lat, lon, refs, members) of one block."""
    blob = dict(fields(memoryview(block)))
    body = memoryview(bytes(blob[1]) if 1 in blob else zlib.decompress(blob[3]))
    texts: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in fields(body):
        if k == 1:
            texts = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k in (19, 20):
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if k == 19 else (lat0, v)
    place = lambda v, base: 1e-9 * (base + scale * v)
    zigzag = lambda v: (v >> 1) ^ -(v & 1)
    for group in groups:
        for k, v in fields(group):
            m = dict(fields(v))
            if k == 2:
                ids, lats, lons = (packed(m.get(i), True, True) for i in (1, 8, 9))
                keys, i = packed(m.get(10)), 0
                for n, la, lo in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while i < len(keys) and keys[i]:
                        tags[texts[keys[i]]] = texts[keys[i + 1]]
                        i += 2
                    i += 1
                    yield "node", n, tags, place(la, lat0), place(lo, lon0), None, None
            elif k in (1, 3, 4):
                tags = {texts[a]: texts[b] for a, b in zip(packed(m.get(2)), packed(m.get(3)), strict=True)}
                if k == 1:
                    yield "node", zigzag(m[1]), tags, place(zigzag(m[8]), lat0), place(zigzag(m[9]), lon0), None, None
                elif k == 3:
                    yield "way", m[1], tags, None, None, packed(m.get(8), True, True), None
                else:
                    who = zip(packed(m.get(10)), packed(m.get(9), True, True), packed(m.get(8)), strict=True)
                    yield "relation", m[1], tags, None, None, None, [{"kind": ("node", "way", "relation")[t], "id": i, "role": texts[r]} for t, i, r in who]


def read_pbf(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All elements of the PBF files at the path."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                for b in blocks(raw):
                    yield pd.DataFrame({"block": [b]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["block"]:
                yield pd.DataFrame(elements(b), columns=["kind", "id", "tags", "lat", "lon", "refs", "members"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "block binary").repartition(n, F.xxhash64("block")).mapInPandas(decode, ELEMENTS)


def relation_rings(elements_: DataFrame, relation: int) -> list[list[tuple[float, float]]]:
    """Closed outer rings (lon, lat) of one relation, its ways joined end to end."""
    members = elements_.where((F.col("kind") == "relation") & (F.col("id") == relation)).select(F.posexplode("members").alias("i", "m")).where("m.kind = 'way' and m.role in ('outer', '')").select("i", F.col("m.id").alias("way"))
    ways = elements_.where("kind = 'way'").join(F.broadcast(members), F.col("id") == F.col("way")).select("i", F.posexplode("refs").alias("j", "ref"))
    nodes = elements_.where("kind = 'node'").select(F.col("id").alias("ref"), "lat", "lon")
    lines: dict[int, list[tuple[int, tuple[float, float]]]] = {}
    for r in ways.join(nodes, "ref").orderBy("i", "j").collect():
        lines.setdefault(r["i"], []).append((r["ref"], (r["lon"], r["lat"])))
    left, rings = list(lines.values()), []
    while left:
        ring = left.pop(0)
        while ring[0][0] != ring[-1][0]:
            for k, line in enumerate(left):
                if ring[-1][0] in (line[0][0], line[-1][0]):
                    ring = ring + (line if line[0][0] == ring[-1][0] else line[::-1])[1:]
                    left.pop(k)
                    break
            else:
                raise ValueError("the relation's outer ways do not close")
        rings.append([p for _, p in ring])
    return rings
