"""Queries over the derived road graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars
from wayfold.operators import road_graph, routing
from wayfold.plans.tag_queries import LOCATED
from wayfold.sources import derived


def _located(spark, sf_dir) -> DataFrame:
    return derived.located(spark, sf_dir)


def _edges(spark, sf_dir) -> DataFrame:
    return road_graph.edges(_located(spark, sf_dir))


def _edges_at(spark, sf_dir, *columns: str) -> DataFrame:
    """Some columns of the edges, all edges of a node in one partition: aggregates and windows by node need no further exchange."""
    return _edges(spark, sf_dir).select("from_id", *columns).repartition(derived.pieces(spark, sf_dir), "from_id")


def _way_nodes(spark, sf_dir) -> DataFrame:
    w = derived.ways(spark, sf_dir)
    return w.withColumns({"lat_e6": derived.latitude(F.col("ref")), "lon_e6": derived.longitude(F.col("ref"))})


def _weighted(spark, sf_dir) -> DataFrame:
    """Driven edges with their travel time."""
    e = _edges(spark, sf_dir).where(~F.col("inverted"))
    return e.select("from_id", "to_id", scalars.time_metric(F.col("distance_cm"), F.col("maxspeed"), F.lit(0).cast("long")).alias("weight"))


def flt01(spark, sf_dir):
    kept = derived.links(spark, sf_dir).where(F.col("highway") < 15)
    return kept.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def flt02(spark, sf_dir):
    links = derived.links(spark, sf_dir)
    touched = flt01(spark, sf_dir)
    return derived.nodes(links).join(touched, "id", "left_semi")


def flt03(spark, sf_dir):
    """Ways with the reason why they are left out, if any."""
    ways, links = derived.ways(spark, sf_dir), derived.links(spark, sf_dir)
    known = derived.tagged_ways(spark, sf_dir).select("way_id", F.get(F.filter("tags", lambda t: t["k"] == "highway"), 0)["v"].alias("highway"))
    return road_graph.rejected_ways(ways, known, derived.nodes(links).where("id % 97 <> 1"))


def jon01(spark, sf_dir):
    links = derived.links(spark, sf_dir)
    n = derived.nodes(links).select(F.col("id").alias("ref"), "lat_e6", "lon_e6")
    return derived.ways(spark, sf_dir).join(n, "ref")


def jon02(spark, sf_dir):
    links = derived.links(spark, sf_dir)
    n = road_graph.dense_index(derived.nodes(links), "id").select("id", "idx")
    a, b = n.select(F.col("id").alias("a"), F.col("idx").alias("a_idx")), n.select(F.col("id").alias("b"), F.col("idx").alias("b_idx"))
    return links.join(a, "a").join(b, "b").select("a", "b", "a_idx", "b_idx")


def jon03(spark, sf_dir):
    """Edges with their target's coordinates and their way's attributes, summed by class."""
    links = _located(spark, sf_dir).select("a", "b", "way_id", "oneway", "highway", "distance_cm")
    target = derived.nodes(derived.links(spark, sf_dir)).select(F.col("id").alias("to_id"), F.col("lat_e6").alias("to_lat"))
    ways = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), "o_orderpriority")
    # a link and its two edges have one way, which is joined before there are two of them
    met = road_graph.edges(links.join(ways, "way_id")).select("to_id", "highway", "o_orderpriority", "distance_cm").join(target, "to_id")
    return met.groupBy("highway", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("distance_cm").alias("cm"), F.max("to_lat").alias("north"))


def jon04(spark, sf_dir):
    e = _edges(spark, sf_dir).where(~F.col("inverted"))
    return e.groupBy(F.col("to_id").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))


def jon05(spark, sf_dir):
    return road_graph.edge_pairs(_edges(spark, sf_dir)).groupBy("n1").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n0") == F.col("n2")).alias("uturns"))


def jon09(spark, sf_dir):
    """Nearest graph node of each point: grid cells, in rings until the found distance is inside them."""
    from wayfold.operators import nearest

    return nearest.nearest_nodes(derived.events_tags(spark, sf_dir), derived.nodes(derived.links(spark, sf_dir)))


def jon17(spark, sf_dir):
    links = derived.links(spark, sf_dir)
    used = derived.ways(spark, sf_dir).select(F.col("ref").alias("id")).distinct()
    return derived.nodes(links).join(used, "id", "left_anti").select("id")


def agg04(spark, sf_dir):
    d = agg06(spark, sf_dir)
    return d.groupBy(F.least(F.col("uniq"), F.lit(6)).alias("neighbours")).agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("example"))


def agg03(spark, sf_dir):
    """Counters of a graph build, one row each."""
    edges = _edges_at(spark, sf_dir, "to_id", "inverted", "both_directions", "contra_way", "restricted", "highway", "distance_cm", "maxspeed")
    return road_graph.build_statistics(derived.ways(spark, sf_dir), edges)


def agg05(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("pos"))
    return road_graph.deduped(o, "value")


def agg06(spark, sf_dir):
    return road_graph.degrees(_edges_at(spark, sf_dir, "to_id", "inverted"))


def agg07(spark, sf_dir):
    return road_graph.best_highway(_edges(spark, sf_dir), derived.pieces(spark, sf_dir))


def agg08(spark, sf_dir):
    w = _way_nodes(spark, sf_dir)
    by = w.groupBy("way_id").agg(F.sum(F.col("lat_e6").cast("long")).alias("lat"), F.sum(F.col("lon_e6").cast("long")).alias("lon"), F.count(F.lit(1)).alias("points"))
    return by.select("way_id", "points", scalars.whole_div(F.col("lat"), F.col("points")).alias("lat_e6"), scalars.whole_div(F.col("lon"), F.col("points")).alias("lon_e6"))


def agg09(spark, sf_dir):
    return _way_nodes(spark, sf_dir).groupBy((F.col("way_id") % 16).alias("cluster")).agg(F.min("lat_e6").alias("low_lat"), F.max("lat_e6").alias("high_lat"), F.min("lon_e6").alias("low_lon"), F.max("lon_e6").alias("high_lon"))


def agg12(spark, sf_dir):
    return derived.links(spark, sf_dir).groupBy((F.col("a") % 32).alias("c0"), (F.col("b") % 32).alias("c1")).agg(F.sum("maxspeed").alias("weight"))


def agg13(spark, sf_dir):
    links = derived.links(spark, sf_dir).withColumn("weight", F.lit(1).cast("long"))
    clusters = derived.nodes(links).select(F.col("id").alias("node"), (F.col("id") % 8).alias("cluster"))
    return routing.modularity(links, clusters).select("cluster", "inner", "total", F.round("q", 9).alias("q"))


def agg17(spark, sf_dir):
    by = _located(spark, sf_dir).groupBy("highway").agg(F.min("distance_cm").alias("least"), F.max("distance_cm").alias("most"), F.sum("distance_cm").alias("total"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("mean", scalars.whole_div(F.col("total"), F.col("n")))


def win01(spark, sf_dir):
    return road_graph.way_positions(_way_nodes(spark, sf_dir)).select("way_id", "pos", "before_cm", "step_cm")


def win02(spark, sf_dir):
    ways = _way_nodes(spark, sf_dir)
    return road_graph.way_edges(road_graph.way_positions(ways), road_graph.needed_nodes(ways)).select("way_id", "pos", "from_id", "to_id", "distance_cm")


def win03(spark, sf_dir):
    e = road_graph.ordered_edges(_edges_at(spark, sf_dir, "to_id", "way_id", "inverted"))
    return e.select("from_id", "to_id", "way_id", "off", "inverted", "unique_target")


def win05(spark, sf_dir):
    """Start of each node's edges: the edges of all nodes before it, by the dense index of edges."""
    e = road_graph.ordered_edges(_edges_at(spark, sf_dir, "to_id", "way_id", "inverted")).select("from_id", "off")
    return road_graph.dense_index(e, "from_id", "start", ties=("off",), width=64).where("off = 0").select("from_id", "start")


def win07(spark, sf_dir):
    w = derived.ways(spark, sf_dir).withColumn("ref", F.col("ref") % 7)
    twice = w.groupBy("way_id", "ref").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).where("lo < hi")
    return twice


def win08(spark, sf_dir):
    return road_graph.dense_index(derived.nodes(derived.links(spark, sf_dir)), "id").select("id", "idx")


def srt01(spark, sf_dir):
    return derived.links(spark, sf_dir).orderBy(F.col("maxspeed").desc(), "a", "b").limit(16).select("a", "b", "maxspeed")


def srt02(spark, sf_dir):
    c = routing.components(derived.links(spark, sf_dir)).select("component", "size").distinct()
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.col("size").desc(), "component")))


def set01(spark, sf_dir):
    links = derived.links(spark, sf_dir)
    used = derived.ways(spark, sf_dir).select(F.col("ref").alias("id"))
    return links.select(F.col("b").alias("id")).intersect(used)


def set03(spark, sf_dir):
    return road_graph.one_sided(_edges(spark, sf_dir))


def grf01(spark, sf_dir):
    return road_graph.needed_nodes(derived.ways(spark, sf_dir))


def grf02(spark, sf_dir):
    return _edges(spark, sf_dir).select("from_id", "to_id", "way_id", "inverted", "contra_way", "both_directions", "distance_cm")


def grf04(spark, sf_dir):
    return routing.components(derived.links(spark, sf_dir))


def set04(spark, sf_dir):
    return routing.large_components(routing.components(derived.links(spark, sf_dir)), 10).select("node", "component")


def grf05(spark, sf_dir):
    return routing.bridges(derived.streets(spark, sf_dir))


def grf06(spark, sf_dir):
    links = derived.streets(spark, sf_dir)
    return routing.dead_ends(links, routing.checkpointed(routing.bridges(links)))


def _sources(spark, sf_dir) -> DataFrame:
    """The nodes that are nearest to a point and within 100 m of it."""
    return jon09(spark, sf_dir).where(F.col("distance_cm") < 10_000).select(F.col("node").alias("source")).distinct()


def grf30(spark, sf_dir):
    return routing.many_distances(_weighted(spark, sf_dir), _sources(spark, sf_dir))


def _requests(spark, sf_dir) -> DataFrame:
    """A route from each nation's customer to its part; some of them are no nodes of the graph."""
    k = F.col("n_nationkey").cast("long")
    return derived.table(spark, sf_dir, "nation").select(k.alias("req_id"), ((k * 7 + 1) * 2).alias("source"), ((k * 11 + 3) * 2 + 1).alias("target"))


def grf33(spark, sf_dir):
    return routing.routes(_weighted(spark, sf_dir), _requests(spark, sf_dir)).select("req_id", "metric")


def grf52(spark, sf_dir):
    return routing.traffic(_weighted(spark, sf_dir), _sources(spark, sf_dir))


def grf54(spark, sf_dir):
    """Invariants of the graph with the number of rows that break them."""
    held = routing.checkpointed(_edges(spark, sf_dir).select("from_id", "to_id", "way_id", "inverted", "both_directions"))
    return road_graph.validation(held, derived.nodes(derived.links(spark, sf_dir)), derived.pieces(spark, sf_dir))


def snk01(spark, sf_dir):
    l = _located(spark, sf_dir)
    color = F.when(F.col("restricted"), "red").when(F.col("oneway"), "blue").otherwise("black")
    kept = l.select(F.format_string("line,%s,%d,%d,%d,%d", color, "a_lat", "a_lon", "b_lat", "b_lon").alias("line"))
    return kept


def snk13(spark, sf_dir):
    """Bits and bytes that the edges' columns take."""
    e = road_graph.ordered_edges(_edges(spark, sf_dir))
    return road_graph.disk_usage(e, ["from_id", "to_id", "way_id", "distance_cm", "highway", "maxspeed", "off"])


def snk14(spark, sf_dir):
    """Route answers as JSON, those without a route included."""
    weighted, links = _weighted(spark, sf_dir), derived.links(spark, sf_dir)
    steps = _edges(spark, sf_dir).where(~F.col("inverted")).select("from_id", "to_id", "distance_cm", F.concat(F.lit("way "), F.col("way_id").cast("string")).alias("name"))
    found = routing.routes(weighted, _requests(spark, sf_dir))
    return road_graph.route_answers(found, _requests(spark, sf_dir), steps, weighted, derived.nodes(links))


E = f"""{LOCATED},
edges AS (SELECT a AS from_id, b AS to_id, false AS inverted, false AS contra_way, NOT oneway AS both_directions, located.* FROM located
  UNION ALL SELECT b, a, oneway, NOT oneway, NOT oneway, located.* FROM located)"""
WN = f"WITH {derived.WAYS}, wn AS (SELECT *, CAST(45000000 + (ref * 7919) % 3000000 AS INTEGER) AS lat_e6, CAST(6000000 + (ref * 104729) % 4000000 AS INTEGER) AS lon_e6 FROM ways)"
_H = "pow(sin((radians({q}_lat / 1e6) - radians({p}_lat / 1e6)) / 2), 2) + cos(radians({p}_lat / 1e6)) * cos(radians({q}_lat / 1e6)) * pow(sin((radians({q}_lon / 1e6) - radians({p}_lon / 1e6)) / 2), 2)"
WP = f"""{WN},
w1 AS (SELECT way_id, pos, ref, lat_e6 AS p_lat, lon_e6 AS p_lon, lead(lat_e6) OVER w AS q_lat, lead(lon_e6) OVER w AS q_lon FROM wn WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
w2 AS (SELECT *, {_H.format(p='p', q='q')} AS h FROM w1),
w3 AS (SELECT *, coalesce(CAST(round(2.0e0 * 637100000.0e0 * atan2(sqrt(h), sqrt(1.0e0 - h))) AS BIGINT), 0) AS step_cm FROM w2),
wp AS (SELECT *, CAST(sum(step_cm) OVER (PARTITION BY way_id ORDER BY pos) - step_cm AS BIGINT) AS before_cm FROM w3)"""
NEED = """need AS (
  SELECT ref AS id FROM (SELECT ref, pos, min(pos) OVER (PARTITION BY way_id) AS lo, max(pos) OVER (PARTITION BY way_id) AS hi FROM ways) WHERE pos IN (lo, hi)
  UNION SELECT ref FROM ways GROUP BY ref HAVING count(*) > 1
  UNION SELECT w.ref FROM ways w JOIN (SELECT way_id, ref, min(pos) AS lo, max(pos) AS hi FROM ways GROUP BY way_id, ref HAVING count(*) > 1) t ON w.way_id = t.way_id AND w.pos BETWEEN lo AND hi)"""
COMP = f"""WITH RECURSIVE {derived.LINKS},
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, label) USING KEY (node) AS (
  SELECT DISTINCT a AS node, a AS label FROM sym
  UNION
  SELECT s.b, min(r.label) FROM reach r JOIN sym s ON r.node = s.a JOIN recurring.reach o ON o.node = s.b WHERE r.label < o.label GROUP BY s.b),
comp AS (SELECT node, label AS component FROM reach),
sized AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM comp)"""
WEIGHTED = f"{E}, weighted AS (SELECT from_id, to_id, 36 * distance_cm // maxspeed AS weight FROM edges WHERE NOT inverted)"

QUERIES = {
    "flt01_highway_nodes": flt01,
    "flt02_touched_nodes": flt02,
    "flt03_way_rejection": flt03,
    "jon01_way_coordinates": jon01,
    "jon02_index_lookup": jon02,
    "jon03_edge_attributes": jon03,
    "jon04_incoming_edges": jon04,
    "jon05_edge_pairs": jon05,
    "jon08_jon09_nearest_node": jon09,
    "jon17_anti_nodes": jon17,
    "agg03_build_statistics": agg03,
    "agg04_degree_histogram": agg04,
    "agg05_dictionary": agg05,
    "agg06_degrees": agg06,
    "agg07_best_highway": agg07,
    "agg08_centroids": agg08,
    "agg09_bounding_rects": agg09,
    "agg12_cluster_weights": agg12,
    "agg13_modularity": agg13,
    "agg17_min_max_avg": agg17,
    "win01_cumulative_distance": win01,
    "win02_way_edges": win02,
    "win03_win04_edge_order": win03,
    "win05_edge_starts": win05,
    "win07_loops": win07,
    "win08_dense_index": win08,
    "srt01_top_n": srt01,
    "srt02_components_by_size": srt02,
    "set01_intersection": set01,
    "set03_graph_equality": set03,
    "set04_large_components": set04,
    "grf01_needed_nodes": grf01,
    "grf02_edges": grf02,
    "grf04_components": grf04,
    "grf05_bridges": grf05,
    "grf06_dead_ends": grf06,
    "grf30_single_source": grf30,
    "grf33_routes": grf33,
    "grf52_traffic": grf52,
    "grf54_validation": grf54,
    "snk01_graph_csv": snk01,
    "snk13_statistics": snk13,
    "snk14_route_json": snk14,
}

_A17 = f"{LOCATED} SELECT highway AS {{k}}, min(distance_cm) AS least, max(distance_cm) AS most, CAST(sum(distance_cm) AS BIGINT) AS total, count(*) AS n, CAST(sum(distance_cm) AS BIGINT) // count(*) AS mean FROM located GROUP BY highway"
ORACLE_SQL = {
    "flt01_highway_nodes": f"WITH {derived.LINKS} SELECT a AS id FROM links WHERE highway < 15 UNION SELECT b FROM links WHERE highway < 15",
    "flt02_touched_nodes": f"WITH {derived.LINKS}, {derived.NODES} SELECT * FROM nodes WHERE id IN (SELECT a FROM links WHERE highway < 15 UNION SELECT b FROM links WHERE highway < 15)",
    "flt03_way_rejection": f"""WITH {derived.LINKS}, {derived.NODES}, {derived.WAYS},
      j AS (SELECT way_id, pos, ref, lag(ref) OVER (PARTITION BY way_id ORDER BY pos) AS before, id IS NULL OR id % 97 = 1 AS lacking FROM ways LEFT JOIN nodes ON ref = id),
      c AS (SELECT way_id, count(*) AS n, count(*) FILTER (before IS NULL OR ref <> before) AS uniq, bool_or(lacking) AS lacking FROM j GROUP BY way_id)
      SELECT way_id, n, uniq, CASE WHEN n <= 1 THEN 'one node' WHEN way_id % 27 IN (1, 11) THEN 'no road' WHEN lacking THEN 'missing node' WHEN uniq <= 1 THEN 'no length' END AS reason FROM c""",
    "jon01_way_coordinates": f"WITH {derived.LINKS}, {derived.NODES}, {derived.WAYS} SELECT way_id, pos, ref, lat_e6, lon_e6 FROM ways JOIN nodes ON ref = id",
    "jon02_index_lookup": f"WITH {derived.LINKS}, {derived.NODES}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes) SELECT a, b, x.idx AS a_idx, y.idx AS b_idx FROM links JOIN i x ON a = x.id JOIN i y ON b = y.id",
    "jon03_edge_attributes": f"{E} SELECT highway, o_orderpriority, count(*) AS n, CAST(sum(distance_cm) AS BIGINT) AS cm, max(lat_e6) AS north FROM edges JOIN nodes ON to_id = id JOIN orders ON way_id = o_orderkey GROUP BY ALL",
    "jon04_incoming_edges": f"{E} SELECT to_id AS node, count(*) AS incoming FROM edges WHERE NOT inverted GROUP BY to_id",
    "jon05_edge_pairs": f"{E} SELECT e.to_id AS n1, count(*) AS pairs, count(*) FILTER (e.from_id = f.to_id) AS uturns FROM edges e JOIN edges f ON e.to_id = f.from_id WHERE NOT e.inverted AND NOT f.inverted GROUP BY e.to_id",
    "jon08_jon09_nearest_node": f"""WITH {derived.LINKS}, {derived.NODES}, {derived.POINTS},
      d AS (SELECT p.id, n.id AS node, CAST(round(2.0e0 * 637100000.0e0 * atan2(sqrt(h), sqrt(1.0e0 - h))) AS BIGINT) AS distance_cm, p.id AS pid
        FROM (SELECT p.id AS id, n.id AS nid, {_H.format(p='p', q='q')} AS h FROM (SELECT id, lat_e6 AS p_lat, lon_e6 AS p_lon FROM points) p, (SELECT id, lat_e6 AS q_lat, lon_e6 AS q_lon FROM nodes) n) x
        JOIN points p ON p.id = x.id JOIN nodes n ON n.id = x.nid)
      SELECT id, arg_min(node, (distance_cm, node)) AS node, min(distance_cm) AS distance_cm FROM d GROUP BY id""",
    "jon17_anti_nodes": f"WITH {derived.LINKS}, {derived.NODES}, {derived.WAYS} SELECT id FROM nodes WHERE id NOT IN (SELECT ref FROM ways)",
    "agg03_build_statistics": f"""{E}, {derived.WAYS}, d AS (SELECT from_id, count(*) AS n, count(*) FILTER (NOT inverted) AS f FROM edges GROUP BY 1), y AS (SELECT way_id, count(*) AS n FROM ways GROUP BY 1)
      SELECT counter, CAST(value AS BIGINT) AS value FROM (
        SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'edges inverted', count(*) FILTER (inverted) FROM edges UNION ALL SELECT 'edges both directions', count(*) FILTER (both_directions) FROM edges
        UNION ALL SELECT 'edges contra way', count(*) FILTER (contra_way) FROM edges UNION ALL SELECT 'edges restricted', count(*) FILTER (restricted) FROM edges UNION ALL SELECT 'edges self', count(*) FILTER (from_id = to_id) FROM edges
        UNION ALL SELECT 'edges unique target', count(*) FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE from_id <> to_id) UNION ALL SELECT 'edges important', count(*) FILTER (highway <= 4) FROM edges
        UNION ALL SELECT 'cm sum', sum(distance_cm) FROM edges UNION ALL SELECT 'cm max', max(distance_cm) FROM edges UNION ALL SELECT 'cm min', min(distance_cm) FROM edges
        UNION ALL SELECT 'speed max', max(maxspeed) FROM edges UNION ALL SELECT 'speed min', min(maxspeed) FROM edges
        UNION ALL SELECT 'nodes', count(*) FROM d UNION ALL SELECT 'node edges max', max(n) FROM d UNION ALL SELECT 'node edges min', min(n) FROM d UNION ALL SELECT 'nodes one edge', count(*) FILTER (n = 1) FROM d UNION ALL SELECT 'nodes no way out', count(*) FILTER (f = 0) FROM d
        UNION ALL SELECT 'ways', count(*) FROM y UNION ALL SELECT 'way nodes', sum(n) FROM y UNION ALL SELECT 'way nodes max', max(n) FROM y UNION ALL SELECT 'way nodes min', min(n) FROM y UNION ALL SELECT 'ways one node', count(*) FILTER (n = 1) FROM y) t(counter, value)""",
    "agg04_degree_histogram": f"{E}, d AS (SELECT from_id AS node, count(DISTINCT to_id) AS u FROM edges GROUP BY from_id) SELECT least(u, 6) AS neighbours, count(*) AS nodes, min(node) AS example FROM d GROUP BY 1",
    "agg05_dictionary": "WITH c AS (SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1) SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INTEGER) AS place FROM c",
    "agg06_degrees": f"{E} SELECT from_id AS node, count(*) FILTER (NOT inverted) AS forward, count(*) FILTER (inverted) AS inverted, count(DISTINCT to_id) AS uniq FROM edges GROUP BY from_id",
    "agg07_best_highway": f"""{E}, x AS (SELECT from_id AS node, highway, 1 AS o FROM edges WHERE NOT inverted UNION ALL SELECT to_id, highway, 0 FROM edges WHERE NOT inverted),
      m AS (SELECT node, min(highway) AS best FROM x GROUP BY node)
      SELECT m.node, best, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in FROM m JOIN x ON m.node = x.node AND best = highway GROUP BY m.node, best""",
    "agg08_centroids": f"{WN} SELECT way_id, count(*) AS points, CAST(sum(lat_e6) AS BIGINT) // count(*) AS lat_e6, CAST(sum(lon_e6) AS BIGINT) // count(*) AS lon_e6 FROM wn GROUP BY way_id",
    "agg09_bounding_rects": f"{WN} SELECT way_id % 16 AS cluster, min(lat_e6) AS low_lat, max(lat_e6) AS high_lat, min(lon_e6) AS low_lon, max(lon_e6) AS high_lon FROM wn GROUP BY 1",
    "agg12_cluster_weights": f"WITH {derived.LINKS} SELECT a % 32 AS c0, b % 32 AS c1, CAST(sum(maxspeed) AS BIGINT) AS weight FROM links GROUP BY 1, 2",
    "agg13_modularity": f"""WITH {derived.LINKS}, s AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      c AS (SELECT a % 8 AS cluster, count(*) FILTER (a % 8 = b % 8) AS inner_, count(*) AS total FROM s GROUP BY 1), m AS (SELECT sum(total) AS m2 FROM c)
      SELECT cluster, CAST(inner_ AS BIGINT) AS inner, total, round(inner_ / m2 - (total / m2) * (total / m2), 9) AS q FROM c, m""",
    "agg17_min_max_avg": _A17.format(k="highway"),
    "win01_cumulative_distance": f"{WP} SELECT way_id, pos, before_cm, step_cm FROM wp",
    "win02_way_edges": f"{WP}, {NEED}, k AS (SELECT way_id, pos, ref AS from_id, lead(ref) OVER w AS to_id, lead(before_cm) OVER w - before_cm AS distance_cm FROM wp WHERE ref IN (SELECT id FROM need) WINDOW w AS (PARTITION BY way_id ORDER BY pos)) SELECT * FROM k WHERE to_id IS NOT NULL",
    "win03_win04_edge_order": f"{E} SELECT from_id, to_id, way_id, inverted, CAST(row_number() OVER (PARTITION BY from_id ORDER BY inverted, to_id, way_id) - 1 AS INTEGER) AS off, row_number() OVER (PARTITION BY from_id, to_id ORDER BY inverted, way_id) = 1 AND from_id <> to_id AS unique_target FROM edges",
    "win05_edge_starts": f"{E}, d AS (SELECT from_id, count(*) AS n FROM edges GROUP BY from_id) SELECT from_id, CAST(sum(n) OVER (ORDER BY from_id) - n AS BIGINT) AS start FROM d",
    "win07_loops": f"WITH {derived.WAYS} SELECT way_id, ref % 7 AS ref, min(pos) AS lo, max(pos) AS hi FROM ways GROUP BY 1, 2 HAVING min(pos) < max(pos)",
    "win08_dense_index": f"WITH {derived.LINKS}, {derived.NODES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes",
    "srt01_top_n": f"WITH {derived.LINKS} SELECT a, b, maxspeed FROM links ORDER BY maxspeed DESC, a, b LIMIT 16",
    "srt02_components_by_size": f"{COMP}, c AS (SELECT DISTINCT component, size FROM sized) SELECT component, size, CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS place FROM c",
    "set01_intersection": f"WITH {derived.LINKS}, {derived.WAYS} SELECT b AS id FROM links INTERSECT SELECT ref FROM ways",
    "set03_graph_equality": "SELECT CAST(0 AS BIGINT) AS different",
    "set04_large_components": f"{COMP}, top AS (SELECT component AS c FROM sized ORDER BY size DESC, component LIMIT 1) SELECT node, component FROM sized, top WHERE size >= 10 OR component = c",
    "grf01_needed_nodes": f"WITH {derived.WAYS}, {NEED} SELECT id FROM need",
    "grf02_edges": f"{E} SELECT from_id, to_id, way_id, inverted, contra_way, both_directions, distance_cm FROM edges",
    "grf04_components": f"{COMP} SELECT node, component, size FROM sized",
    "grf30_single_source": f"""{WEIGHTED.replace('WITH ', 'WITH RECURSIVE ', 1)}, src AS ({{SOURCES}}),
      best(source, node, metric) USING KEY (source, node) AS (
        SELECT source, source, CAST(0 AS BIGINT) FROM src
        UNION
        SELECT b.source, w.to_id, min(b.metric + w.weight) FROM best b JOIN weighted w ON b.node = w.from_id
        LEFT JOIN recurring.best o ON o.source = b.source AND o.node = w.to_id
        WHERE o.metric IS NULL OR b.metric + w.weight < o.metric GROUP BY b.source, w.to_id)
      SELECT source, node, metric FROM best""",
    "grf05_bridges": f"WITH RECURSIVE {derived.STREETS} SELECT a, b FROM bridges",
    "grf06_dead_ends": f"WITH RECURSIVE {derived.STREETS} SELECT node, label <> (SELECT label FROM core) AS dead_end FROM part",
    "grf54_validation": "SELECT unnest(['edges in order', 'no edge twice', 'inverted edges have a driven twin', 'two-way edges come back', 'targets are nodes', 'nodes in order']) AS invariant, CAST(0 AS BIGINT) AS broken",
    "snk01_graph_csv": f"{LOCATED} SELECT 'line,' || CASE WHEN restricted THEN 'red' WHEN oneway THEN 'blue' ELSE 'black' END || ',' || a_lat || ',' || a_lon || ',' || b_lat || ',' || b_lon AS line FROM located",
    "snk13_statistics": f"""{E}, o AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY inverted, to_id, way_id) - 1 AS off FROM edges),
      l AS (SELECT unnest(['from_id', 'to_id', 'way_id', 'distance_cm', 'highway', 'maxspeed', 'off']) AS col, unnest([from_id, to_id, way_id, distance_cm, highway, maxspeed, off]) AS v FROM o),
      m AS (SELECT col, count(*) AS n, min(v) AS least, max(v) AS most, CAST(sum(v) AS BIGINT) AS total FROM l GROUP BY col)
      SELECT col, n, least, most, CAST(total // n AS BIGINT) AS mean, CAST(greatest(1, length(ltrim(CAST(CAST(most AS BIT) AS VARCHAR), '0'))) AS INTEGER) AS bits,
        CAST((n * greatest(1, length(ltrim(CAST(CAST(most AS BIT) AS VARCHAR), '0'))) + 7) // 8 AS BIGINT) AS bytes FROM m""",
}
_SEARCH = ORACLE_SQL["grf30_single_source"]
_MATCHED = ORACLE_SQL["jon08_jon09_nearest_node"].split("d AS (", 1)[1].rsplit("SELECT id, arg_min", 1)[0]
ORACLE_SQL["grf30_single_source"] = _SEARCH.replace("src AS ({SOURCES})", f"""{derived.POINTS}, d AS ({_MATCHED},
      src AS (SELECT DISTINCT node AS source FROM (SELECT id, arg_min(node, (distance_cm, node)) AS node, min(distance_cm) AS cm FROM d GROUP BY id) WHERE cm < 10000)""")
ORACLE_SQL["grf33_routes"] = _SEARCH.replace("src AS ({SOURCES})", """req AS (SELECT CAST(n_nationkey AS BIGINT) AS req_id, CAST((n_nationkey * 7 + 1) * 2 AS BIGINT) AS source, CAST((n_nationkey * 11 + 3) * 2 + 1 AS BIGINT) AS target FROM nation),
      src AS (SELECT DISTINCT source FROM req)""").replace("SELECT source, node, metric FROM best", "SELECT req_id, metric FROM req LEFT JOIN best ON best.source = req.source AND node = target")
