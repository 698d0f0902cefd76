"""Fixpoints and searches on small graphs with known answers."""

from __future__ import annotations

from wayfold.operators import road_graph, routing

DEAD_ENDS = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("C", "G"), ("G", "D")]


def links(spark, pairs):
    return spark.createDataFrame([(ord(a), ord(b)) for a, b in pairs], "a long, b long")


def test_bridges_and_dead_ends(spark):
    frame = links(spark, DEAD_ENDS)
    found = routing.bridges(frame)
    assert {(chr(r.a), chr(r.b)) for r in found.collect()} == {("A", "B"), ("B", "C"), ("D", "E"), ("E", "F")}
    dead = {chr(r.node): r.dead_end for r in routing.dead_ends(frame, found).collect()}
    assert {n for n, d in dead.items() if d} == set("ABEF")


def test_bridge_between_two_rings(spark):
    ring = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4), (1, 2)]
    frame = spark.createDataFrame(ring, "a long, b long")
    assert [(r.a, r.b) for r in routing.bridges(frame).collect()] == [(3, 4)]


def test_components_of_long_chain(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: (r.component, r.size) for r in routing.components(frame).collect()}
    assert found == {**{i: (0, 201) for i in range(201)}, 500: (500, 2), 501: (500, 2)}


def test_no_links(spark):
    frame = spark.createDataFrame([], "a long, b long")
    assert routing.components(frame).collect() == [] and routing.bridges(frame).collect() == []


def test_routers_agree(spark):
    rows = [(ord(a), ord(b), 1000) for a, b in DEAD_ENDS] + [(ord(b), ord(a), 1000) for a, b in DEAD_ENDS]
    edges = spark.createDataFrame(rows, "from_id long, to_id long, weight long")
    sources = spark.createDataFrame([(ord("A"),), (ord("B"),)], "source long")
    joined = {tuple(r) for r in routing.distances(edges, sources).collect()}
    assert joined == {tuple(r) for r in routing.many_distances(edges, sources).collect()}
    assert (ord("A"), ord("F"), 5000) in joined and (ord("B"), ord("E"), 3000) in joined
    requests = spark.createDataFrame([(1, ord("A"), ord("F")), (2, ord("A"), 999)], "req_id long, source long, target long")
    got = {r.req_id: (r.metric, len(r.path)) for r in routing.routes(edges, requests).collect()}
    assert got == {1: (5000, 6), 2: (None, 0)}


def test_modularity_of_two_triangles(spark):
    pairs = [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 3), (4, 5)]
    frame = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, weight long")
    alone = spark.createDataFrame([(n, n) for n in range(6)], "node long, cluster long")
    pair = spark.createDataFrame([(n, int(n in (1, 4, 5))) for n in range(6)], "node long, cluster long")
    q = [round(sum(r.q for r in routing.modularity(frame, c).collect()), 12) for c in (alone, pair)]
    assert q == [-0.173469387755, 0.357142857143]


def test_dense_index_crosses_buckets(spark):
    frame = spark.createDataFrame([(i * 700,) for i in range(500)] + [(10**9,)], "id long")
    got = {r.id: r.idx for r in road_graph.dense_index(frame, "id").collect()}
    assert got == {**{i * 700: i for i in range(500)}, 10**9: 500}
