"""Queries over countries, clusters, restrictions, layers and sinks, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars
from wayfold.operators import clusters, geo, restrictions, road_graph, routing
from wayfold.plans.graph_queries import COMP, WP, E, _edges, _located
from wayfold.plans.tag_queries import LOCATED
from wayfold.sources import derived, layers

#: Countries as boxes on a 5 by 5 grid over the derived coordinates, 600,000 by 800,000 microdegrees each.
_BOX = "CAST(6000000 + (n_nationkey % 5) * 800000 AS INT)", "CAST(45000000 + CAST(floor(n_nationkey / 5) AS INT) * 600000 AS INT)"


def _borders(spark, sf_dir) -> DataFrame:
    n = derived.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_BOX[0]} AS w", f"{_BOX[1]} AS s")
    n = n.selectExpr("CAST(n_nationkey + 1 AS INT) AS ncc", "w", "s", "w + 800000 AS e", "s + 600000 AS n")
    sides = "array(" + ", ".join(f"named_struct('x0', {a}, 'y0', {b}, 'x1', {c}, 'y1', {d})" for a, b, c, d in ("wses", "esen", "enwn", "wnws")) + ")"
    return n.selectExpr("ncc", f"explode({sides}) AS l").selectExpr("l.x0", "l.y0", "l.x1", "l.y1", "ncc")


def jon06(spark, sf_dir):
    return geo.countries(derived.events_tags(spark, sf_dir), _borders(spark, sf_dir))


def agg15(spark, sf_dir):
    return geo.shared_borders(_borders(spark, sf_dir))


def jon10(spark, sf_dir):
    found = geo.nearest_links(derived.events_tags(spark, sf_dir), _located(spark, sf_dir))
    return found.select("id", F.round(F.col("d") / 1000, 1).alias("d"))


_CLIP = (1_000.0, 900.0, 3_000.0, 2_500.0)


def _pixels(spark, sf_dir) -> DataFrame:
    k = F.col("l_partkey")
    return derived.table(spark, sf_dir, "lineitem").select("l_orderkey", *[((k * m + F.col("l_orderkey") * c) % 4000).cast("double").alias(n) for n, m, c in (("x0", 37, 11), ("y0", 53, 7), ("x1", 71, 5), ("y1", 97, 3))])


def prj22(spark, sf_dir):
    cut = geo.clipped(_pixels(spark, sf_dir), _CLIP)
    return cut.groupBy("l_orderkey").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("x0", "y0", "x1", "y1")], F.count(F.lit(1)).alias("n"))


def prj29(spark, sf_dir):
    """Polylines of links in 1e-5 degrees, and the coordinates that decoding gives back."""
    l = _located(spark, sf_dir)
    at = lambda p: F.struct(F.floor(F.col(f"{p}_lat") / 10).alias("lat"), F.floor(F.col(f"{p}_lon") / 10).alias("lon"))
    line = geo.encode_polyline(F.array(at("a"), at("b")))
    back = l.select("a", "b", "way_id", line.alias("line")).withColumn("back", geo.decode_polyline(F.col("line")))
    return back.select("a", "b", "line", *[F.get("back", n)[c].alias(f"{c}_{n}") for n in (0, 1) for c in ("lat", "lon")])


def _relations(spark, sf_dir) -> DataFrame:
    kinds = "element_at(array('no_left_turn','only_right_turn','no_exit','no_entry','no_blabla'), CAST(o_orderkey % 5 + 1 AS INT))"
    member = "struct('{r}' AS role, '{t}' AS type, {v} AS ref)"
    members = [member.format(r="from", t="way", v="o_custkey"), member.format(r="to", t="way", v="o_orderkey"), member.format(r="via", t="node", v="o_custkey * 2")]
    more = f"CASE WHEN o_orderkey % 5 = 2 THEN array({member.format(r='to', t='way', v='o_orderkey + 1')}) WHEN o_orderkey % 5 = 3 THEN array({member.format(r='from', t='way', v='o_custkey + 1')}) ELSE array() END"
    return derived.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{kinds} AS kind", f"concat(array({', '.join(members)}), {more}) AS members")


def grf13(spark, sf_dir):
    r = restrictions.parse(_relations(spark, sf_dir))
    return r.select("relation_id", "forbidden", "direction", "from_way", "to_way", F.get("via", 0).alias("via"), "via_is_node")


def grf16(spark, sf_dir):
    rules = restrictions.parse(_relations(spark, sf_dir))
    o = derived.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_way"), (F.col("o_custkey") * 2).alias("node"), F.col("o_orderkey").alias("to_way"))
    other = o.select("from_way", "node", (F.col("to_way") + 7).alias("to_way"))
    turns = o.unionAll(other).distinct().withColumn("u_turn", F.col("to_way") % 4 == 0)
    return restrictions.judge_turns(turns, rules)


def flt05(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.where(~F.col("inverted") & ~F.col("restricted") & (F.col("highway") < 20)).groupBy("highway").agg(F.count(F.lit(1)).alias("kept"))


def flt12(spark, sf_dir):
    """Nodes that clusters are made of: of large components, without dead ends."""
    links = derived.streets(spark, sf_dir)
    alive = routing.dead_ends(links, routing.checkpointed(routing.bridges(links))).where("NOT dead_end")
    large = routing.large_components(routing.components(links), 1_000_000)
    return large.join(alive, "node", "left_semi").select("node")


def _clusters(spark, sf_dir) -> DataFrame:
    return derived.nodes(derived.links(spark, sf_dir)).select(F.col("id").alias("node"), (F.col("id") % 12).alias("cluster"))


def agg10(spark, sf_dir):
    return clusters.cluster_header(_edges(spark, sf_dir).where("NOT inverted").select("from_id", "to_id"), _clusters(spark, sf_dir))


def agg11(spark, sf_dir):
    h = agg10(spark, sf_dir)
    share = F.round(100 * F.col("outer_edges") / F.greatest(F.col("inner_edges"), F.lit(1)), 4)
    return h.select("cluster", share.alias("percent")).withColumn("place", F.rank().over(Window.orderBy(F.col("percent").desc())))


def agg16(spark, sf_dir):
    e = _edges(spark, sf_dir).where("NOT inverted")
    return e.groupBy((F.col("from_id") % 50).alias("f"), (F.col("to_id") % 50).alias("t"), "restricted").agg(F.min("distance_cm").alias("weight"))


def grf08(spark, sf_dir):
    """Regions of links between restricted ones, labelled by size and what they touch."""
    links = routing.checkpointed(derived.links(spark, sf_dir).select("a", "b", "restricted", "highway"))
    plain = links.where("NOT restricted")
    comp = routing.contracted_components(plain.select("a", "b"), checkpoint=routing.checkpointed)
    edges = plain.join(comp.select(F.col("node").alias("a"), F.col("component").alias("region")), "a").select("region", (F.col("highway") >= 11).alias("residential"))
    ends = links.where("restricted").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    touched = comp.join(ends, "node", "left_semi").select(F.col("component").alias("region"))
    return routing.label_regions(edges, touched, small=50, large=1000)


def grf22(spark, sf_dir):
    return clusters.louvain(derived.streets(spark, sf_dir).select("a", "b", F.lit(1).cast("long").alias("weight")))


def grf39(spark, sf_dir):
    """Ways between the border nodes of each nation's streets, inside it."""
    links = derived.streets(spark, sf_dir)
    edges = links.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")).unionAll(links.select("b", "a")).distinct().withColumn("weight", F.col("from_id") + F.col("to_id"))
    own = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("cluster"))
    return clusters.cluster_paths(edges, own)


def grf53(spark, sf_dir):
    """Tiles that border lines cross: the others have one country."""
    lines = _borders(spark, sf_dir)
    tile = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi) / 200_000), F.floor(F.greatest(lo, hi) / 200_000))
    return lines.select("ncc", F.explode(tile("x0", "x1")).alias("x"), "y0", "y1").select("ncc", "x", F.explode(tile("y0", "y1")).alias("y")).groupBy("x", "y").agg(F.count_distinct("ncc").alias("countries"))


def win06(spark, sf_dir):
    """Places where a way goes from one country to the next, and whether its way has one country only."""
    w = derived.ways(spark, sf_dir)
    ids = w.select(F.col("ref").alias("id")).distinct()
    at = geo.countries(ids.select("id", derived.latitude(F.col("id")).alias("lat_e6"), derived.longitude(F.col("id")).alias("lon_e6")), _borders(spark, sf_dir))
    return road_graph.country_changes(w.join(at.select(F.col("id").alias("ref"), "ncc"), "ref"))


def win09(spark, sf_dir):
    own, other = _clusters(spark, sf_dir), _clusters(spark, sf_dir)
    e = _edges(spark, sf_dir).where("NOT inverted").select("from_id", "to_id", "way_id")
    out = e.join(own.select(F.col("node").alias("from_id"), "cluster"), "from_id").join(other.select(F.col("node").alias("to_id"), F.col("cluster").alias("other")), "to_id").where("cluster <> other")
    # a cluster has too many edges for one task's sort
    ranked = road_graph.dense_index(out.select("cluster", "from_id", "to_id"), "from_id", "place", ties=("to_id",), within=("cluster",))
    return ranked.select("cluster", "from_id", "to_id", F.col("place").cast("int").alias("place"))


def win10(spark, sf_dir):
    p = road_graph.way_positions(derived.ways(spark, sf_dir).withColumns({"lat_e6": derived.latitude(F.col("ref")), "lon_e6": derived.longitude(F.col("ref"))}))
    return p.select("way_id", "pos", (F.col("before_cm") - F.lag("before_cm", 1, 0).over(Window.partitionBy("way_id").orderBy("pos"))).alias("step"))


def srt03(spark, sf_dir):
    e = derived.events_tags(spark, sf_dir).select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit("-1"))).alias("draw"))
    return e.orderBy("draw", "id").limit(50).select("id", "draw")


def srt04(spark, sf_dir):
    return road_graph.dense_index(derived.nodes(derived.links(spark, sf_dir)).select("lon_e6", "id"), "lon_e6", "at", ties=("id",)).select("id", "at")


def set02(spark, sf_dir):
    nodes = derived.events_tags(spark, sf_dir).select(F.lit("n").alias("kind"), "id", "lat_e6", "lon_e6")
    w = derived.ways(spark, sf_dir).where("pos = 1").select(F.lit("w").alias("kind"), F.col("way_id").alias("id"), derived.latitude(F.col("ref")).alias("lat_e6"), derived.longitude(F.col("ref")).alias("lon_e6"))
    return nodes.unionByName(w)


def snk04(spark, sf_dir):
    kind = F.when(F.col("restricted"), "restricted").when(F.col("highway") == 15, "service").when(F.col("highway") == 12, "residential").when(F.col("highway") == 13, "unclassified")
    return _located(spark, sf_dir).withColumn("kind", kind).where("kind IS NOT NULL").select("a", "b", "kind", "distance_cm")


def src11(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit(":"), F.lit("motor*,trunk"), F.lit(" speed_max="), (F.col("n_nationkey") * 5 + 10).cast("string"), F.lit("  # rule")).alias("value"))
    r = layers.routing_rules(n)
    return r.select("pos", F.array_join("countries", "+").alias("countries"), F.array_join("selectors", "+").alias("selectors"), "speed_max")


def flt09(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation")
    every = spark.createDataFrame([(-1, "ALL:* speed_max=10")], "pos int, value string")
    rules = layers.routing_rules(every.unionAll(n.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit(":trunk* speed_max=80")))))
    wanted = n.select(F.upper(F.substring("n_name", 1, 2)).alias("country")).distinct().select("country", F.explode(F.array(F.lit("trunk"), F.lit("trunk_link"), F.lit("path"))).alias("key"))
    return layers.last_rule(rules, wanted).select("country", "key", "speed_max")


def src12(spark, sf_dir):
    return layers.country_list(derived.table(spark, sf_dir, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit(" # "), F.col("n_name")).alias("value")))


def ext_stream(spark, sf_dir):
    """Extension: the batch twin of the windowed stream."""
    e = derived.table(spark, sf_dir, "events")
    by = e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


QUERIES = {
    "jon06_point_in_country": jon06,
    "jon10_nearest_link": jon10,
    "agg10_cluster_header": agg10,
    "agg11_cluster_report": agg11,
    "agg15_shared_borders": agg15,
    "agg16_edge_dedup": agg16,
    "prj22_line_clip": prj22,
    "prj29_polyline": prj29,
    "grf08_region_labels": grf08,
    "grf13_restrictions": grf13,
    "grf16_turn_status": grf16,
    "grf22_louvain": grf22,
    "grf39_cluster_paths": grf39,
    "grf53_border_tiles": grf53,
    "flt05_edge_filter": flt05,
    "flt09_config_rules": flt09,
    "flt12_eligible_nodes": flt12,
    "win06_country_change": win06,
    "win09_border_positions": win09,
    "win10_step_metric": win10,
    "set02_poi_union": set02,
    "srt03_seeded_limit": srt03,
    "srt04_longitude_index": srt04,
    "snk04_restricted_roads": snk04,
    "src11_routing_rules": src11,
    "src12_country_list": src12,
    "ext_event_windows": ext_stream,
}

_NB = """nb AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS ncc, CAST(6000000 + (n_nationkey % 5) * 800000 AS INTEGER) AS w, CAST(45000000 + (n_nationkey // 5) * 600000 AS INTEGER) AS s FROM nation),
borders AS (SELECT w AS x0, s AS y0, w + 800000 AS x1, s AS y1, ncc FROM nb UNION ALL SELECT w + 800000, s, w + 800000, s + 600000, ncc FROM nb
  UNION ALL SELECT w + 800000, s + 600000, w, s + 600000, ncc FROM nb UNION ALL SELECT w, s + 600000, w, s, ncc FROM nb)"""
_CL = "cl AS (SELECT id AS node, id % 12 AS cluster FROM nodes)"
_X0, _Y0, _X1, _Y1 = _CLIP
_RAW = "SELECT l_orderkey, " + ", ".join(f"CAST((l_partkey * {m} + l_orderkey * {c}) % 4000 AS DOUBLE) AS {n}" for n, m, c in (("x0", 37, 11), ("y0", 53, 7), ("x1", 71, 5), ("y1", 97, 3))) + " FROM lineitem"
_REL = """rel AS (SELECT o_orderkey AS relation_id, o_orderkey % 5 <> 1 AS forbidden,
   CASE o_orderkey % 5 WHEN 0 THEN 'left_turn' WHEN 1 THEN 'right_turn' WHEN 2 THEN 'exit' WHEN 3 THEN 'entry' END AS direction,
   unnest(CASE WHEN o_orderkey % 5 = 3 THEN [o_custkey, o_custkey + 1] ELSE [o_custkey] END) AS from_way, o_custkey * 2 AS via, o_orderkey FROM orders WHERE o_orderkey % 5 < 4),
rules AS (SELECT relation_id, forbidden, direction, from_way, unnest(CASE WHEN o_orderkey % 5 = 2 THEN [o_orderkey, o_orderkey + 1] ELSE [o_orderkey] END) AS to_way, via, true AS via_is_node FROM rel)"""

ORACLE_SQL = {
    "jon06_point_in_country": f"""WITH {derived.POINTS}, {_NB} SELECT id, coalesce((SELECT max(ncc) FROM nb WHERE s < lat_e6 AND lat_e6 <= s + 600000 AND w <= lon_e6 AND lon_e6 < w + 800000), 0) AS ncc FROM points""",
    "agg10_cluster_header": f"""{E}, {_CL}, j AS (SELECT x.cluster, y.cluster AS other, from_id FROM edges JOIN cl x ON from_id = x.node JOIN cl y ON to_id = y.node WHERE NOT inverted),
      b AS (SELECT cluster, count(DISTINCT from_id) FILTER (cluster <> other) AS border_nodes, count(*) FILTER (cluster = other) AS inner_edges, count(*) FILTER (cluster <> other) AS outer_edges FROM j GROUP BY cluster)
      SELECT cl.cluster, count(*) AS nodes, any_value(coalesce(border_nodes, 0)) AS border_nodes, any_value(coalesce(inner_edges, 0)) AS inner_edges, any_value(coalesce(outer_edges, 0)) AS outer_edges FROM cl LEFT JOIN b ON b.cluster = cl.cluster GROUP BY cl.cluster""",
    "agg15_shared_borders": f"""WITH {_NB}, o AS (SELECT CASE WHEN (x0, y0) <= (x1, y1) THEN [x0, y0, x1, y1] ELSE [x1, y1, x0, y0] END AS k, ncc FROM borders)
      SELECT k[1] AS x0, k[2] AS y0, k[3] AS x1, k[4] AS y1, min(ncc) AS ncc_1, CASE WHEN max(ncc) <> min(ncc) THEN max(ncc) ELSE 0 END AS ncc_2 FROM o GROUP BY k""",
    "agg16_edge_dedup": f"{E} SELECT from_id % 50 AS f, to_id % 50 AS t, restricted, min(distance_cm) AS weight FROM edges WHERE NOT inverted GROUP BY ALL",
    "prj22_line_clip": f"""WITH l AS ({_RAW}), e AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM l),
      t AS (SELECT *, greatest(0.0e0, CASE WHEN dx > 0 THEN ({_X0}e0 - x0) / dx WHEN dx < 0 THEN ({_X1}e0 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN ({_Y0}e0 - y0) / dy WHEN dy < 0 THEN ({_Y1}e0 - y0) / dy ELSE 0 END) AS i,
        least(1.0e0, CASE WHEN dx > 0 THEN ({_X1}e0 - x0) / dx WHEN dx < 0 THEN ({_X0}e0 - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ({_Y1}e0 - y0) / dy WHEN dy < 0 THEN ({_Y0}e0 - y0) / dy ELSE 1 END) AS o FROM e
        WHERE NOT (dx = 0 AND (x0 < {_X0} OR x0 > {_X1})) AND NOT (dy = 0 AND (y0 < {_Y0} OR y0 > {_Y1})))
      SELECT l_orderkey, round(sum(x0 + i * dx), 4) AS x0, round(sum(y0 + i * dy), 4) AS y0, round(sum(x0 + o * dx), 4) AS x1, round(sum(y0 + o * dy), 4) AS y1, count(*) AS n FROM t WHERE i <= o GROUP BY l_orderkey""",
    "grf08_region_labels": f"""{COMP.replace('sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links)', 'sym AS (SELECT a, b FROM links WHERE NOT restricted UNION SELECT b, a FROM links WHERE NOT restricted)')},
      e AS (SELECT component AS region, count(*) AS n, bool_and(highway >= 11) AS only_ FROM links JOIN comp ON a = node WHERE NOT restricted GROUP BY 1),
      t AS (SELECT DISTINCT component AS region FROM comp WHERE node IN (SELECT a FROM links WHERE restricted UNION SELECT b FROM links WHERE restricted))
      SELECT e.region, n, CASE WHEN t.region IS NULL THEN 'free' WHEN n < 50 AND only_ THEN 'secondary' WHEN n > 1000 THEN 'free' ELSE 'secondary' END AS label FROM e LEFT JOIN t ON e.region = t.region""",
    "grf13_restrictions": f"WITH {_REL} SELECT relation_id, forbidden, direction, from_way, to_way, via, via_is_node FROM rules",
    "grf16_turn_status": f"""WITH {_REL}, r AS (SELECT * FROM rules),
      turns AS (SELECT o_custkey AS from_way, o_custkey * 2 AS node, o_orderkey AS to_way FROM orders UNION SELECT o_custkey, o_custkey * 2, o_orderkey + 7 FROM orders)
      SELECT t.from_way, node, t.to_way, t.to_way % 4 = 0 AS u_turn,
        CASE WHEN bool_or(r.to_way = t.to_way) THEN NOT bool_or(r.forbidden) FILTER (r.to_way = t.to_way) WHEN t.to_way % 4 = 0 THEN true ELSE NOT coalesce(bool_or(r.to_way <> t.to_way AND NOT r.forbidden), false) END AS allowed
      FROM turns t LEFT JOIN r ON r.from_way = t.from_way AND r.via = node GROUP BY t.from_way, node, t.to_way""",
    "grf53_border_tiles": f"""WITH {_NB}, x AS (SELECT ncc, unnest(range(least(x0, x1) // 200000, greatest(x0, x1) // 200000 + 1)) AS x, y0, y1 FROM borders),
      y AS (SELECT ncc, x, unnest(range(least(y0, y1) // 200000, greatest(y0, y1) // 200000 + 1)) AS y FROM x) SELECT x, y, count(DISTINCT ncc) AS countries FROM y GROUP BY x, y""",
    "flt05_edge_filter": f"{E} SELECT highway, count(*) AS kept FROM edges WHERE NOT inverted AND NOT restricted AND highway < 20 GROUP BY highway",
    "flt09_config_rules": """WITH w AS (SELECT DISTINCT upper(substr(n_name, 1, 2)) AS country FROM nation), k AS (SELECT country, unnest(['trunk', 'trunk_link', 'path']) AS key FROM w)
      SELECT country, key, CAST(CASE WHEN key LIKE 'trunk%' AND country IN (SELECT upper(substr(n_name, 1, 2)) FROM nation WHERE n_nationkey % 2 = 0) THEN 80 ELSE 10 END AS INTEGER) AS speed_max FROM k""",
    "win06_country_change": f"""WITH {derived.WAYS}, {_NB}, x AS (SELECT way_id, pos, coalesce((SELECT max(ncc) FROM nb WHERE s < 45000000 + (ref * 7919) % 3000000 AND 45000000 + (ref * 7919) % 3000000 <= s + 600000 AND w <= 6000000 + (ref * 104729) % 4000000 AND 6000000 + (ref * 104729) % 4000000 < w + 800000), 0) AS ncc FROM ways),
      y AS (SELECT way_id, pos, ncc, lead(ncc) OVER (PARTITION BY way_id ORDER BY pos) AS after FROM x) SELECT way_id, pos, ncc, after FROM y WHERE after <> ncc""",
    "prj29_polyline": f"""{LOCATED}, p AS (SELECT a, b, [a_lat // 10, a_lon // 10, b_lat // 10 - a_lat // 10, b_lon // 10 - a_lon // 10] AS d, a_lat // 10 AS lat_0, a_lon // 10 AS lon_0, b_lat // 10 AS lat_1, b_lon // 10 AS lon_1 FROM located),
      z AS (SELECT *, list_transform(d, lambda v: CAST(CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS BIGINT)) AS q FROM p)
      SELECT a, b, CAST(lat_0 AS BIGINT) AS lat_0, CAST(lon_0 AS BIGINT) AS lon_0, CAST(lat_1 AS BIGINT) AS lat_1, CAST(lon_1 AS BIGINT) AS lon_1,
        list_aggregate(list_transform(q, lambda v: list_aggregate(list_transform(list_filter(range(0, 8), lambda n: n = 0 OR v >> CAST(5 * n AS INTEGER) > 0), lambda n: chr(CAST((v >> CAST(5 * n AS INTEGER)) % 32 + CASE WHEN v >> CAST(5 * n + 5 AS INTEGER) > 0 THEN 32 ELSE 0 END + 63 AS INTEGER))), 'string_agg', '')), 'string_agg', '') AS line FROM z""",
    "flt12_eligible_nodes": f"WITH RECURSIVE {derived.STREETS} SELECT node FROM part WHERE label = (SELECT label FROM core)",
    "win10_step_metric": f"{WP} SELECT way_id, pos, CAST(before_cm - lag(before_cm, 1, 0) OVER (PARTITION BY way_id ORDER BY pos) AS BIGINT) AS step FROM wp",
    "win09_border_positions": f"{E}, {_CL} SELECT x.cluster, from_id, to_id, CAST(row_number() OVER (PARTITION BY x.cluster ORDER BY from_id, to_id) - 1 AS INTEGER) AS place FROM edges JOIN cl x ON from_id = x.node JOIN cl y ON to_id = y.node WHERE NOT inverted AND x.cluster <> y.cluster",
    "set02_poi_union": f"WITH {derived.WAYS}, {derived.POINTS} SELECT 'n' AS kind, id, lat_e6, lon_e6 FROM points UNION ALL SELECT 'w', way_id, CAST(45000000 + (ref * 7919) % 3000000 AS INTEGER), CAST(6000000 + (ref * 104729) % 4000000 AS INTEGER) FROM ways WHERE pos = 1",
    "srt03_seeded_limit": "SELECT event_id AS id, md5(event_id || '-1') AS draw FROM events ORDER BY draw, id LIMIT 50",
    "srt04_longitude_index": f"WITH {derived.LINKS}, {derived.NODES} SELECT id, row_number() OVER (ORDER BY lon_e6, id) - 1 AS at FROM nodes",
    "snk04_restricted_roads": f"{LOCATED}, k AS (SELECT a, b, distance_cm, CASE WHEN restricted THEN 'restricted' WHEN highway = 15 THEN 'service' WHEN highway = 12 THEN 'residential' WHEN highway = 13 THEN 'unclassified' END AS kind FROM located) SELECT * FROM k WHERE kind IS NOT NULL",
    "src11_routing_rules": "SELECT n_nationkey AS pos, upper(substr(n_name, 1, 2)) AS countries, 'motor*+trunk' AS selectors, CAST(n_nationkey * 5 + 10 AS INTEGER) AS speed_max FROM nation",
    "src12_country_list": "SELECT DISTINCT upper(substr(n_name, 1, 2)) AS code FROM nation",
    "ext_event_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
ORACLE_SQL["agg11_cluster_report"] = f"""WITH h AS ({ORACLE_SQL['agg10_cluster_header']}), p AS (SELECT cluster, round(100 * outer_edges / greatest(inner_edges, 1), 4) AS percent FROM h)
  SELECT cluster, percent, CAST(rank() OVER (ORDER BY percent DESC) AS INTEGER) AS place FROM p"""
