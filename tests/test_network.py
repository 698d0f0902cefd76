"""Map files, restrictions, clusters, layers and streams on small inputs with known answers."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from wayfold.operators import clusters, geo, restrictions
from wayfold.sources import layers, pbf
from wayfold.streaming import traffic


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _packed(values, signed=False) -> bytes:
    return b"".join(_varint(_zigzag(v) if signed else v) for v in values)


def _deltas(values):
    return [v - before for v, before in zip(values, [0, *values], strict=False)]


def _blob(kind: bytes, payload: bytes) -> bytes:
    blob = _field(2, len(payload)) + _field(3, zlib.compress(payload))
    header = _field(1, kind) + _field(3, len(blob))
    return len(header).to_bytes(4, "big") + header + blob


def _block(strings, group: bytes) -> bytes:
    return _field(1, b"".join(_field(1, s.encode()) for s in strings)) + _field(2, group)


def map_file(path) -> None:
    strings = ["", "highway", "crossing", "name", "Zürich", "from", "to"]
    dense = _field(1, _packed(_deltas([5, 9, 12]), True)) + _field(8, _packed(_deltas([473000000, -5, 7]), True)) + _field(9, _packed(_deltas([85000000, 3, 2]), True)) + _field(10, _packed([1, 2, 0, 0, 3, 4, 1, 2, 0]))
    way = _field(1, 77) + _field(2, _packed([3])) + _field(3, _packed([4])) + _field(8, _packed(_deltas([5, 12, 9]), True))
    relation = _field(1, 8) + _field(8, _packed([5, 6])) + _field(9, _packed(_deltas([77, 5]), True)) + _field(10, _packed([1, 0]))
    blobs = [_blob(b"OSMHeader", b"")] + [_blob(b"OSMData", _block(strings, g)) for g in (_field(2, dense), _field(2, dense), _field(3, way), _field(4, relation))]
    path.write_bytes(b"".join(blobs))


def test_map_file(spark, tmp_path):
    file = tmp_path / "x.osm.pbf"
    map_file(file)
    pbf.register(spark)

    def read(kind):
        return spark.read.format("mappbf").option("path", str(file)).option("kind", kind).load()

    nodes = sorted([(r.id, r.lat_e7, r.lon_e7, [tuple(t) for t in r.tags]) for r in read("nodes").collect()])
    one = [(5, 473000000, 85000000, [("highway", "crossing")]), (9, -5, 3, []), (12, 7, 2, [("name", "Zürich"), ("highway", "crossing")])]
    assert nodes == sorted(one * 2)
    way = read("ways").first()
    assert (way.id, way.refs, [tuple(t) for t in way.tags]) == (77, [5, 12, 9], [("name", "Zürich")])
    relation = read("relations").first()
    assert (relation.id, [tuple(m) for m in relation.members]) == (8, [(0, "way", "from", 77), (1, "node", "to", 5)])
    assert sorted((r.kind, r.entries, r.min_id, r.max_id) for r in read("blobs").collect()) == [("nodes", 3, 5, 12)] * 2 + [("relations", 1, 8, 8), ("ways", 1, 77, 77)]


def test_restriction_kinds(spark):
    member = lambda role, kind, ref: (role, kind, ref)
    via = member("via", "node", 9)
    rows = [
        (1, "no_right_turn", [member("from", "way", 1), via, member("to", "way", 2)]),
        (2, "only_right_turn", [member("from", "way", 1), via, member("to", "way", 2)]),
        (3, "no_exit", [member("from", "way", 1), via, member("to", "way", 2), member("to", "way", 3)]),
        (4, "no_entry", [member("from", "way", 1), member("from", "way", 2), via, member("to", "way", 3)]),
        (5, "no_blabla", [member("from", "way", 1), via, member("to", "way", 2)]),
        (6, "no_left_turn", [member("from", "way", 1), member("from", "way", 4), via, member("to", "way", 2)]),
    ]
    frame = spark.createDataFrame(rows, "id long, kind string, members array<struct<role:string,type:string,ref:long>>")
    found = restrictions.parse(frame).groupBy("relation_id").count().collect()
    assert {r[0]: r[1] for r in found} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_chain(spark):
    rows = [(1, 10, 5, 6), (1, 11, 7, 6), (1, 12, 7, 8), (2, 20, 1, 2), (2, 21, 5, 6)]
    got = {(r.group, r.piece): (r.pos, r.reverse) for r in restrictions.chained(spark.createDataFrame(rows, "group long, piece long, first long, last long")).collect()}
    assert got == {(1, 10): (0, False), (1, 11): (1, True), (1, 12): (2, False), (2, 20): (0, False), (2, 21): (None, False)}


def test_two_triangles_are_two_clusters(spark):
    pairs = [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 3), (4, 5), (10, 11)]
    found = clusters.louvain(spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, weight long"))
    by: dict[int, set[int]] = {}
    for r in found.collect():
        by.setdefault(r.cluster, set()).add(r.node)
    assert by == {0: {0, 2, 3}, 1: {1, 4, 5}, 10: {10, 11}}


def test_neighbours_get_other_colors():
    found = clusters.colors(pd.DataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], columns=["a", "b"]))
    assert all(found[a] != found[b] for a, b in [(1, 2), (2, 3), (3, 1), (3, 4)])


def test_country_of_points(spark):
    square = [(0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]
    lines = spark.createDataFrame([(*s, 7) for s in square], "x0 int, y0 int, x1 int, y1 int, ncc int")
    points = spark.createDataFrame([(1, 50, 50), (2, 50, 150), (3, 150, 50), (4, -1, 50)], "id long, lat_e6 int, lon_e6 int")
    assert {r.id: r.ncc for r in geo.countries(points, lines).collect()} == {1: 7, 2: 0, 3: 0, 4: 0}


def test_polyline(spark):
    points = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((3850000, -12020000), (4070000, -12095000), (4325200, -12645300))])
    assert spark.range(1).select(geo.encode_polyline(points)).first()[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_layers(spark):
    lines = spark.createDataFrame([("f", 0, "poly-start"), ("f", 1, "pt,1.5,2"), ("f", 2, "pt,1.5,3"), ("f", 3, "poly-start"), ("f", 4, "pt,0,0"), ("f", 5, "pt,-1,0")], "file string, pos int, value string")
    got = sorted((r.poly, r.x0, r.y0, r.x1, r.y1) for r in layers.polygon_segments(lines).collect())
    assert got == [(1, 2000000, 1500000, 3000000, 1500000), (2, 0, 0, 0, -1000000)]


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a" if m % 2 else "b", 1.0) for m in range(40)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = traffic.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.n, r.total) for r in spark.table("windows").collect()} <= {(2, 2.0), (3, 3.0)} and spark.table("windows").count() == 16
