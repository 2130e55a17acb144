import struct
import zlib

from pyspark.sql import functions as F

from trailweave.operators.network import AccessRules, accessible, both_ways, build_network, classify, direction_sign
from trailweave.sources.osm import read_pbf, relation_rings


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def zigzag(n):
    return (n << 1) ^ (n >> 63)


def deltas(values):
    return b"".join(varint(zigzag(b - a)) for a, b in zip([0, *values], values))


def blob(kind, body):
    data = field(2, len(body)) + field(3, zlib.compress(body))
    head = field(1, kind) + field(3, len(data))
    return struct.pack(">I", len(head)) + head + data


def write_pbf(path, nodes, ways, relations):
    """nodes (id, lat, lon, tags), ways (id, tags, refs), relations (id, tags, members)."""
    table = [""]
    at = lambda s: table.index(s) if s in table else (table.append(s), len(table) - 1)[1]
    keys = b"".join(b"".join(varint(at(k)) + varint(at(v)) for k, v in t.items()) + varint(0) for *_, t in nodes)
    dense = field(1, deltas([n[0] for n in nodes])) + field(8, deltas([round(n[1] * 1e7) for n in nodes])) + field(9, deltas([round(n[2] * 1e7) for n in nodes])) + field(10, keys)
    tags = lambda t: field(2, b"".join(varint(at(k)) for k in t)) + field(3, b"".join(varint(at(v)) for v in t.values()))
    groups = field(2, field(2, dense))
    groups += field(2, b"".join(field(3, field(1, i) + tags(t) + field(8, deltas(refs))) for i, t, refs in ways))
    groups += field(2, b"".join(field(4, field(1, i) + tags(t) + field(8, b"".join(varint(at(r)) for _, _, r in m)) + field(9, deltas([x for _, x, _ in m])) + field(10, b"".join(varint(k) for k, _, _ in m))) for i, t, m in relations))
    body = field(1, b"".join(field(1, s.encode()) for s in table)) + groups
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", body))


def test_pbf(spark, tmp_path):
    p = tmp_path / "t.osm.pbf"
    nodes = [(10, 24.5, 118.1, {}), (12, 24.6, 118.1, {"amenity": "school", "name": "校"}), (11, 24.6, 118.2, {}), (900000000000, -1.25, -2.5, {})]
    write_pbf(p, nodes, [(5, {"highway": "path"}, [10, 12, 11]), (6, {}, [11, 10])], [(7, {"type": "boundary"}, [(1, 5, "outer"), (1, 6, "outer"), (0, 12, "label")])])
    rows = {(r.kind, r.id): r for r in read_pbf(spark, str(p)).collect()}
    assert len(rows) == 7
    far = rows["node", 900000000000]
    assert (round(far.lat, 7), round(far.lon, 7), far.tags) == (-1.25, -2.5, {})
    assert rows["node", 12].tags == {"amenity": "school", "name": "校"} and rows["way", 5].refs == [10, 12, 11]
    assert [m.role for m in rows["relation", 7].members] == ["outer", "outer", "label"]
    ring = relation_rings(read_pbf(spark, str(p)), 7)
    assert [[(round(x, 6), round(y, 6)) for x, y in r] for r in ring] == [[(118.1, 24.5), (118.1, 24.6), (118.2, 24.6), (118.1, 24.5)]]


def test_tag_rules(spark):
    r = AccessRules(never=["construction"], motorway=["motorway"], foot=["footway"], service_private=["driveway"])
    cases = [
        ({"highway": "residential"}, True),
        ({}, False),
        ({"highway": "construction"}, False),
        ({"highway": "footway"}, False),
        ({"highway": "footway", "bicycle": "yes"}, True),
        ({"highway": "motorway", "bicycle": "designated"}, True),
        ({"highway": "residential", "access": "private"}, False),
        ({"highway": "residential", "access": "private", "bicycle": "yes"}, True),
        ({"highway": "residential", "bicycle": "no"}, False),
        ({"highway": "service", "service": "driveway"}, False),
        ({"highway": "service"}, True),
        ({"highway": "residential", "area": "yes"}, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [x.a for x in df.select("i", accessible(F.col("tags"), r).alias("a")).orderBy("i").collect()] == [w for _, w in cases]
    ways = spark.createDataFrame([(0, {"oneway": "yes"}), (1, {"oneway": "-1"}), (2, {}), (3, {"oneway": "yes", "oneway:bicycle": "no"})], "i int, tags map<string,string>")
    got = ways.select("i", direction_sign(F.col("tags"), r).alias("s"), both_ways(F.col("tags"), r).alias("b")).orderBy("i").collect()
    assert [(x.s, x.b) for x in got] == [(1, False), (-1, False), (0, False), (1, True)]
    rules = [("education", [("amenity", ["school"])]), ("work", [("shop", []), ("amenity", ["cafe"])])]
    t = spark.createDataFrame([(0, {"amenity": "school", "shop": "x"}), (1, {"shop": "x"}), (2, {"shop": ""}), (3, {"amenity": "cafe"})], "i int, tags map<string,string>")
    got = t.select("i", classify(F.col("tags"), rules).alias("c")).orderBy("i").collect()
    assert [x.c and tuple(x.c) for x in got] == [("education", "amenity=school"), ("work", "shop=x"), None, ("work", "amenity=cafe")]


def test_network(spark):
    ways = spark.createDataFrame([(1, {"highway": "a", "oneway": "yes"}, [1, 2, 3]), (2, {"highway": "b", "name": "B"}, [2, 4]), (3, {}, [5, 5])], "osmid long, tags map<string,string>, refs array<long>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 6.0, 8.0), (4, 3.0, 5.0), (5, 9.0, 9.0)], "id long, x double, y double")
    segments, edges = build_network(ways, nodes, AccessRules())
    assert [(r.segment_id, r.osmid, r.length_m, len(r.line)) for r in segments.orderBy("segment_id").collect()] == [(0, 1, 5.0, 2), (1, 1, 5.0, 2), (2, 2, 1.0, 2)]
    got = [(r.edge_index, r.u, r.v, r.is_legal_direction) for r in edges.orderBy("edge_index").collect()]
    assert got == [(0, 1, 2, True), (1, 2, 1, False), (2, 2, 3, True), (3, 3, 2, False), (4, 2, 4, True), (5, 4, 2, True)]
