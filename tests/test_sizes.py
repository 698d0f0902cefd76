"""What only larger tables show: other paths of the operators, on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalars
from wayfold.operators import clusters, components, geo, map_layers, points, road_graph, routing
from wayfold.sources import derived


def graph(spark, parts=3, nodes=12, links=30, seed=5):
    """Directed edges of several parts that are apart; ways have equal metrics here and there."""
    rng = random.Random(seed)
    rows = {(100 * p + rng.randrange(nodes), 100 * p + rng.randrange(nodes), rng.randint(1, 4) * 1000) for p in range(parts) for _ in range(links)}
    return spark.createDataFrame(sorted(rows), "from_id long, to_id long, weight long")


@pytest.mark.parametrize("most", [0, 40])
def test_distances_of_a_graph_that_is_not_sent(spark, monkeypatch, most):
    edges, sources = graph(spark), spark.createDataFrame([(3,), (5,), (101,), (103,), (202,), (999,), (3,)], "source long")
    wanted = sorted(tuple(r) for r in routing.many_distances(edges, sources).collect())
    monkeypatch.setattr(routing, "MOST_SENT", most)
    assert sorted(tuple(r) for r in routing.many_distances(edges, sources).collect()) == wanted


def test_traffic_of_a_graph_that_is_not_sent(spark, monkeypatch):
    edges, sources = graph(spark), spark.createDataFrame([(n,) for n in (3, 5, 101, 103, 202, 999)], "source long")
    wanted = sorted(tuple(r) for r in routing.traffic(edges, sources).collect())
    assert wanted
    monkeypatch.setattr(routing, "MOST_SENT", 40)
    assert sorted(tuple(r) for r in routing.traffic(edges, sources).collect()) == wanted


def test_routes_keep_the_sources_components(spark, monkeypatch):
    edges = graph(spark)
    requests = spark.createDataFrame([(1, 3, 7), (2, 3, 107), (3, 5, 999)], "req_id long, source long, target long")
    wanted = sorted(map(str, routing.routes(edges, requests).collect()))
    kept, nodes = routing.near_sources(edges, requests)
    assert kept.count() == edges.where("from_id < 100").count() and nodes.where("node >= 100").isEmpty()
    monkeypatch.setattr(routing, "MOST_SENT", 40)
    monkeypatch.setattr(routing, "_joined_routes", None)
    assert sorted(map(str, routing.routes(edges, requests).collect())) == wanted


def test_contracted_components_are_the_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1100)] + [(2000 - i, 2000 + i) for i in range(30)] + [(3000, 3001 + i) for i in range(40)] + [(3500, 3499 - i) for i in range(40)]
    frame = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + chain + [(7, 7), (None, 8)], "a long, b long")
    found = [sorted(tuple(r) for r in f(frame, checkpoint=routing.checkpointed).collect()) for f in (components.connected_components, components.contracted_components)]
    assert found[0] == found[1]


def test_varints_beyond_a_double(spark):
    values = [0, 127, 128, (1 << 53) + 1, (1 << 56) - 1, (1 << 62) + 12_345, (1 << 63) - 1]

    def digits(n):
        out = ""
        while n > 127:
            out, n = out + f"{n & 127 | 128:02X}", n >> 7
        return out + f"{n:02X}"

    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", scalars.varint_hex(F.col("v")).alias("h")).collect()
    assert {r.v: r.h for r in got} == {v: digits(v) for v in values}


def test_ranks_with_ties_and_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(5_000), n * 1_000_003) for n in range(400)]
    frame = spark.createDataFrame(rows, "g long, k long, id long")
    order = sorted((k, n) for _, k, n in rows)
    assert {r.id: r.idx for r in road_graph.dense_index(frame, "k", ties=("id",)).collect()} == {n: at for at, (_, n) in enumerate(order)}
    own = {n: at for g in range(3) for at, (_, n) in enumerate(sorted((k, n) for h, k, n in rows if h == g))}
    assert {r.id: r.idx for r in road_graph.dense_index(frame, "k", ties=("id",), within=("g",), width=16).collect()} == own


def test_repeats_of_ways_that_batches_cut(spark):
    rng = random.Random(4)
    rows = [(way, pos, rng.randrange(4)) for way in range(50) for pos in range(rng.randrange(1, 60))]
    wanted = []
    for way in range(50):
        last, seen = None, set()
        for _, pos, node in sorted(r for r in rows if r[0] == way):
            pair = frozenset((last, node))
            if last is None or (last != node and pair not in seen):
                wanted.append((way, pos, node))
                seen |= {pair} if last is not None else set()
                last = node
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in points.without_repeats(spark.createDataFrame(rows, "way_id long, pos int, ref long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted


def test_cluster_paths_look_at_what_they_reach(spark, monkeypatch):
    # clusters 1 and 2 alternate along pairs of nodes; each pair is a part of its cluster
    edges = [(n, n + 1, 10 + n) for n in range(40)] + [(n + 1, n, 10 + n) for n in range(40)]
    own = [(n, 1 + n // 2 % 2) for n in range(41)]
    monkeypatch.setattr(clusters, "GROUP_LINKS", 5)
    got = {tuple(r) for r in clusters.cluster_paths(spark.createDataFrame(edges, "from_id long, to_id long, weight long"), spark.createDataFrame(own, "node long, cluster long")).collect()}
    inside = {(1 + n // 2 % 2, *pair, 10 + n) for n in range(2, 40, 2) for pair in ((n, n + 1), (n + 1, n))}
    assert got == inside


def test_broken_graphs_are_told(spark):
    good = [(1, 2, 7, False, True), (2, 1, 7, False, True), (2, 3, 8, False, False), (3, 2, 8, True, False), (4, 4, 9, False, True)]
    bad = [(1, 3, 5, True, False), (3, 4, 6, False, True), (2, 3, 8, False, False), (5, 5, 1, True, False), (1, 90, 2, False, False)]
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5)], "id long")
    schema = "from_id long, to_id long, way_id long, inverted boolean, both_directions boolean"
    told = lambda rows: {r.invariant: r.broken for r in road_graph.validation(spark.createDataFrame(rows, schema), nodes, 2).collect()}
    assert set(told(good).values()) == {0}
    wanted = {"edges in order": 0, "no edge twice": 1, "inverted edges have a driven twin": 2, "two-way edges come back": 1, "targets are nodes": 1, "nodes in order": 0}
    assert told(good + bad) == wanted
    frame = spark.createDataFrame(good + bad, schema)
    e = frame.select("from_id", "to_id", "way_id")
    back = e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "way_id")
    assert road_graph.one_sided(frame).first()[0] == e.exceptAll(back).count() + back.exceptAll(e).count()


def test_edges_are_found_in_several_pieces(spark):
    edges = spark.createDataFrame([(1, 2, 7, False), (1, 2, 8, True), (1, 3, 7, False), (2, 1, 7, False)], "from_id long, to_id long, way_id long, inverted boolean")
    wanted = spark.createDataFrame([(1, 3, 7), (1, 3, 7), (1, 2, 8), (9, 9, 9)], "from_id long, to_id long, way_id long")
    assert sorted(tuple(r) for r in map_layers.found_edges(edges, wanted, 3).collect()) == [(1, 2, 8, 1, None), (1, 3, 7, 1, 1), (9, 9, 9, 0, None)]


def test_located_links_are_the_joined_ones(spark):
    smoke = "/root/testdata/sf0.001"
    links = derived.links(spark, smoke)
    joined = road_graph.located(links, derived.nodes(links))
    assert sorted(map(str, derived.located(spark, smoke).select(*joined.columns).collect())) == sorted(map(str, joined.collect()))


def test_polylines_of_many_texts(spark):
    rng = random.Random(6)
    lines = [(n, [(rng.randint(-9_000_000, 9_000_000), rng.randint(-18_000_000, 18_000_000)) for _ in range(rng.randrange(5))]) for n in range(60)]
    frame = spark.createDataFrame([*lines, (99, None)], "id long, line array<struct<lat:long,lon:long>>").withColumn("text", geo.encode_polyline(F.col("line")))

    def text(line):
        out, before = "", (0, 0)
        for place in line:
            for value in (b - a for a, b in zip(before, place, strict=True)):
                value = value * 2 if value >= 0 else -2 * value - 1
                while value >= 32:
                    out, value = out + chr(value % 32 + 95), value >> 5
                out += chr(value + 63)
            before = place
        return out

    got = {r.id: (r.text, r.back) for r in frame.withColumn("back", geo.decode_polyline(F.col("text"))).collect()}
    assert got.pop(99) == (None, None)
    assert {n: (t, [tuple(p) for p in b]) for n, (t, b) in got.items()} == {n: (text(line), line) for n, line in lines}
    odd = spark.createDataFrame([("_p~iF",), ("_p~iF~ps|",)], "t string").select(geo.decode_polyline(F.col("t"))).collect()
    assert [[tuple(p) for p in r[0]] for r in odd] == [[(3850000, None)], [(3850000, None)]]
