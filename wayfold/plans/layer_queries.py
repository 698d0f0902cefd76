"""Queries over map layers, tiles, cluster borders and small scalar functions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import scalars
from wayfold.operators import geo, map_layers, road_graph, routing
from wayfold.plans.graph_queries import E, _edges, _located
from wayfold.plans.network_queries import _NB, ORACLE_SQL as NETWORK_SQL, _borders
from wayfold.plans.tag_queries import LOCATED
from wayfold.sources import derived


def snk02(spark, sf_dir):
    edges = _located(spark, sf_dir).select("a_lat", "a_lon", "b_lat", "b_lon", F.when(F.col("restricted"), "restricted").otherwise("free").alias("label"), (F.col("restricted") & (F.col("highway") < 10)).alias("strange"))
    return map_layers.labelled_lines(edges, "restricted", True, "red")


def snk05(spark, sf_dir):
    """Lines between consecutive nodes of ways that lie in different countries."""
    w = derived.ways(spark, sf_dir)
    ids = w.select(F.col("ref").alias("id")).distinct()
    at = geo.tiled_countries(ids.select("id", derived.latitude(F.col("id")).alias("lat_e6"), derived.longitude(F.col("id")).alias("lon_e6")), _borders(spark, sf_dir))
    placed = w.join(at.select(F.col("id").alias("ref"), "ncc"), "ref")
    changes = road_graph.country_changes(placed).select("way_id", "pos")
    ends = placed.select("way_id", "pos", derived.latitude(F.col("ref")).alias("lat"), derived.longitude(F.col("ref")).alias("lon"))
    after = ends.select("way_id", (F.col("pos") - 1).alias("pos"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    met = changes.join(ends, ["way_id", "pos"]).join(after, ["way_id", "pos"])
    return met.select("way_id", "pos", map_layers.line_text(F.lit("black"), F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")).alias("line"))


def snk06(spark, sf_dir):
    """Streets in the colors of their customers' nations."""
    c = derived.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    nodes = c.select(k.alias("id"), derived.latitude(k).alias("lat_e6"), derived.longitude(k).alias("lon_e6"), F.col("c_nationkey").alias("cluster"), F.col("c_nationkey").alias("color"))
    return map_layers.cluster_lines(derived.streets(spark, sf_dir), nodes)


def snk08(spark, sf_dir):
    """Traffic on the halved ways as lines and records, with the dead ends of the streets."""
    links = derived.streets(spark, sf_dir)
    dead = routing.dead_ends(links, routing.checkpointed(routing.bridges(links)))
    k = F.col("node")
    nodes = dead.select(k.alias("id"), derived.latitude(k).alias("lat_e6"), derived.longitude(k).alias("lon_e6"), "dead_end")
    return map_layers.traffic_lines(agg14(spark, sf_dir).withColumn("way_id", F.col("to_id")), nodes)


def flt13(spark, sf_dir):
    """Which nations' boxes the tiles of half a degree show."""
    b = _borders(spark, sf_dir)
    rects = b.groupBy(F.col("ncc").alias("cluster")).agg(F.min("y0").alias("low_lat"), F.max("y0").alias("high_lat"), F.min("x0").alias("low_lon"), F.max("x0").alias("high_lon"))
    n = F.col("n_nationkey")
    tiles = derived.table(spark, sf_dir, "nation").select(n.alias("tile"), (F.lit(45_100_000) + n * 110_000).alias("low_lat"), (F.lit(6_050_000) + n * 150_000).alias("low_lon")).select("tile", "low_lat", "low_lon", (F.col("low_lat") + 500_000).alias("high_lat"), (F.col("low_lon") + 500_000).alias("high_lon"))
    return map_layers.seen_in_tiles(rects, tiles, 500_000)


def jon07(spark, sf_dir):
    return geo.tiled_countries(derived.events_tags(spark, sf_dir), _borders(spark, sf_dir))


def jon14(spark, sf_dir):
    """Edges between nations: customers belong to theirs, parts to that of the same number."""
    e = _edges(spark, sf_dir).where("NOT inverted").select("from_id", "to_id", "way_id")
    c = derived.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").cast("long").alias("cluster"))
    p = derived.table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("node"), (F.col("p_partkey") % 25).cast("long").alias("cluster"))
    return map_layers.border_twins(e, c.unionAll(p))


def grf03(spark, sf_dir):
    """Edges from customers to the parts of their orders' first lines, and the way back."""
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("x"))
    l = derived.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 2 + 1).alias("y"))
    met = l.join(o, "o_orderkey")
    wanted = met.select(F.col("x").alias("from_id"), F.col("y").alias("to_id"), F.col("o_orderkey").alias("way_id")).unionAll(met.select("y", "x", "o_orderkey"))
    return map_layers.found_edges(_edges(spark, sf_dir), wanted, derived.pieces(spark, sf_dir))


def agg14(spark, sf_dir):
    """How many customers lie at or behind each on the halved ways from customer 0: sums of one search's tree."""
    c = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).where("k > 0")
    edges = c.select(F.floor(F.col("k") / 2).alias("from_id"), F.col("k").alias("to_id"), F.lit(1).cast("long").alias("weight"))
    return routing.traffic(edges, spark.range(1).select(F.col("id").alias("source")))


def prj32(spark, sf_dir):
    """Curve speeds and braking distances over line items' numbers."""
    l = derived.table(spark, sf_dir, "lineitem")
    arc, turn = F.col("l_partkey") + 400, F.col("l_suppkey") % 170 + 5
    a, b = (F.col("l_quantity").cast("double") * 2), (F.col("l_linenumber") * 15).cast("double")
    return l.select("l_orderkey", "l_linenumber", F.round(scalars.curve_speed(arc, turn), 4).alias("kmh"), *[scalars.speed_change_cm(a, b, kind).alias(kind) for kind in scalars.PACES])


def prj42(spark, sf_dir):
    """Names of edges with their length in metres, and texts without a prefix."""
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    cut = scalars.without_prefix(F.col("o_orderpriority"), "1-")
    return o.select("o_orderkey", scalars.edge_name(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") + 1).alias("name"), scalars.round_1(F.floor("o_totalprice") / 8).alias("metres"), cut["had"].alias("had"), cut["rest"].alias("rest"))


def prj37(spark, sf_dir):
    """Bytes of whole numbers and of the differences between neighbours."""
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", scalars.varint_hex(F.col("o_orderkey")).alias("plain"), scalars.varint_hex(scalars.zigzag(F.col("o_custkey") - F.col("o_orderkey"))).alias("signed"), scalars.varint_hex(F.col("o_orderkey") * 1_000_003 * 65_537).alias("long"))


def flt08(spark, sf_dir):
    """Boundaries of countries among relations made of nations."""
    n = "n_nationkey"
    said = {
        "admin_level": f"CASE {n} % 5 WHEN 0 THEN '4' WHEN 1 THEN 'two' ELSE '2' END",
        "type": f"CASE {n} % 7 WHEN 0 THEN 'multipolygon' ELSE 'boundary' END",
        "boundary": f"CASE {n} % 11 WHEN 0 THEN 'maritime' ELSE 'administrative' END",
        "name:en": "n_name",
        "name:de": f"CASE {n} % 2 WHEN 0 THEN lower(n_name) END",
        "ISO3166-1": f"CASE {n} % 3 WHEN 0 THEN upper(substr(n_name, 1, 2)) END",
        "country_code": f"CASE {n} % 4 WHEN 0 THEN 'XX' END",
        "driving_side": f"CASE {n} % 6 WHEN 0 THEN 'left' END",
    }
    pairs = ", ".join(f"struct('{k}' AS k, {v} AS v)" for k, v in said.items())
    rows = derived.table(spark, sf_dir, "nation").selectExpr(f"{n} AS id", f"map_from_entries(filter(array({pairs}), t -> t.v IS NOT NULL)) AS tags")
    return map_layers.countries_of_relations(rows)


QUERIES = {
    "snk02_labelled_edges": snk02,
    "snk05_cross_country_edges": snk05,
    "snk06_cluster_lines": snk06,
    "snk08_traffic_lines": snk08,
    "flt08_admin_relations": flt08,
    "flt13_tile_culling": flt13,
    "jon07_tiled_countries": jon07,
    "jon14_neighbour_edges": jon14,
    "grf03_find_edges": grf03,
    "agg14_tree_sums": agg14,
    "prj32_curve_speeds": prj32,
    "prj37_varints": prj37,
    "prj42_prj44_names": prj42,
}

_LINE = lambda color, *c: "'line,' || " + color + " || ',' || " + " || ',' || ".join(f"printf('%.6f', {x} / 1e6)" for x in c)
_COLORS = ", ".join(f"'{c}'" for c in map_layers.CLUSTER_COLORS)
_AT = lambda k: (f"CAST(45000000 + ({k} * 7919) % 3000000 AS INTEGER)", f"CAST(6000000 + ({k} * 104729) % 4000000 AS INTEGER)")
_BYTES = "(SELECT string_agg(printf('%02X', (v >> CAST(7 * n AS INTEGER)) % 128 + CASE WHEN n < 8 AND v >> CAST(7 * n + 7 AS INTEGER) > 0 THEN 128 ELSE 0 END), '' ORDER BY n) FROM (SELECT CAST({v} AS BIGINT) AS v), (SELECT unnest(range(0, 9)) AS n) WHERE n = 0 OR v >> CAST(7 * n AS INTEGER) > 0)"
_PACE = lambda name: "CAST(abs(round(100.0e0 * ((l_quantity * 2 / 3.6e0) * (l_quantity * 2 / 3.6e0) - (l_linenumber * 15 / 3.6e0) * (l_linenumber * 15 / 3.6e0)) / (2.0e0 * CASE WHEN l_quantity * 2 / 3.6e0 >= l_linenumber * 15 / 3.6e0 THEN %se0 ELSE %se0 END))) AS BIGINT)" % tuple(reversed(scalars.PACES[name]))

ORACLE_SQL = {
    "snk02_labelled_edges": f"{LOCATED} SELECT {_LINE(chr(39) + 'red' + chr(39), 'a_lat', 'a_lon', 'b_lat', 'b_lon')} AS line FROM located WHERE restricted AND highway < 10",
    "snk05_cross_country_edges": f"WITH {derived.WAYS}, c AS ({NETWORK_SQL['win06_country_change']}) SELECT c.way_id, c.pos, {_LINE(chr(39) + 'black' + chr(39), *_AT('x.ref'), *_AT('y.ref'))} AS line FROM c JOIN ways x ON x.way_id = c.way_id AND x.pos = c.pos JOIN ways y ON y.way_id = c.way_id AND y.pos = c.pos + 1",
    "snk06_cluster_lines": f"""WITH s AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_custkey > 0 UNION SELECT x.c_custkey, y.c_custkey FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_nationkey = y.c_nationkey)
      SELECT {_LINE(f"CASE WHEN x.c_nationkey = y.c_nationkey THEN ([{_COLORS}])[x.c_nationkey % 17 + 1] ELSE 'dpink' END", *_AT('a'), *_AT('b'))} AS line FROM s JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b""",
    "flt08_admin_relations": """SELECT n_nationkey AS id, CASE n_nationkey % 2 WHEN 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN upper(substr(n_name, 1, 2)) ELSE 'XX' END AS iso, CASE n_nationkey % 6 WHEN 0 THEN 'left' ELSE '' END AS driving_side
      FROM nation WHERE n_nationkey % 5 > 1 AND n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0 AND (n_nationkey % 3 = 0 OR n_nationkey % 4 = 0)""",
    "flt13_tile_culling": f"WITH {_NB}, t AS (SELECT n_nationkey AS tile, 45100000 + n_nationkey * 110000 AS y, 6050000 + n_nationkey * 150000 AS x FROM nation) SELECT ncc AS cluster, tile FROM nb, t WHERE s <= y + 500000 AND s + 600000 >= y AND w <= x + 500000 AND w + 800000 >= x",
    "jon07_tiled_countries": NETWORK_SQL["jon06_point_in_country"],
    "jon14_neighbour_edges": f"""{E}, k AS (SELECT c_custkey * 2 AS node, CAST(c_nationkey AS BIGINT) AS cluster FROM customer UNION ALL SELECT p_partkey * 2 + 1, p_partkey % 25 FROM part),
      x AS (SELECT from_id, to_id, way_id, a.cluster AS out_cluster, b.cluster AS in_cluster FROM edges JOIN k a ON from_id = a.node JOIN k b ON to_id = b.node WHERE NOT inverted AND a.cluster <> b.cluster)
      SELECT *, CAST(row_number() OVER (PARTITION BY out_cluster ORDER BY from_id, to_id, way_id) - 1 AS INTEGER) AS out_pos, CAST(row_number() OVER (PARTITION BY in_cluster ORDER BY from_id, to_id, way_id) - 1 AS INTEGER) AS in_pos FROM x""",
    "grf03_find_edges": f"""{E}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY from_id ORDER BY inverted, to_id, way_id) - 1 AS INTEGER) AS off FROM edges),
      m AS (SELECT o_custkey * 2 AS x, l_partkey * 2 + 1 AS y, o_orderkey AS way_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), q AS (SELECT x AS from_id, y AS to_id, way_id FROM m UNION SELECT y, x, way_id FROM m)
      SELECT q.from_id, q.to_id, q.way_id, count(o.from_id) AS n, min(off) FILTER (NOT inverted) AS off FROM q LEFT JOIN o ON o.from_id = q.from_id AND o.to_id = q.to_id AND o.way_id = q.way_id GROUP BY ALL""",
    "agg14_tree_sums": """WITH RECURSIVE up AS (SELECT c_custkey AS k, c_custkey AS x FROM customer WHERE c_custkey > 0 UNION ALL SELECT k, x // 2 FROM up WHERE x > 1)
      SELECT x // 2 AS from_id, x AS to_id, count(*) AS visits FROM up GROUP BY x""",
    "prj32_curve_speeds": f"SELECT l_orderkey, l_linenumber, round(sqrt(3.6e0 * 3.6e0 * 0.5e0 * 9.81e0 * 0.01e0 * (l_partkey + 400) / ((l_suppkey % 170 + 5) * pi() / 180.0e0)), 4) AS kmh, {', '.join(f'{_PACE(n)} AS {n}' for n in scalars.PACES)} FROM lineitem",
    "prj37_varints": f"SELECT o_orderkey, {_BYTES.format(v='o_orderkey')} AS plain, {_BYTES.format(v='CASE WHEN o_custkey < o_orderkey THEN 2 * (o_orderkey - o_custkey) - 1 ELSE 2 * (o_custkey - o_orderkey) END')} AS signed, {_BYTES.format(v='o_orderkey * 1000003 * 65537')} AS long FROM orders",
    "prj42_prj44_names": "SELECT o_orderkey, '<' || o_orderpriority || '> (w:' || o_orderkey || ' ' || o_custkey || '->' || (o_custkey + 1) || ')' AS name, floor(floor(o_totalprice) / 8 * 10.0e0 + 0.5e0) / 10.0e0 AS metres, starts_with(o_orderpriority, '1-') AS had, CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS rest FROM orders",
}
ORACLE_SQL["snk08_traffic_lines"] = f"""WITH RECURSIVE {derived.STREETS}, up AS (SELECT c_custkey AS k, c_custkey AS x FROM customer WHERE c_custkey > 0 UNION ALL SELECT k, x // 2 FROM up WHERE x > 1),
t AS (SELECT x // 2 AS a, x AS b, count(*) AS visits FROM up GROUP BY x), m AS (SELECT greatest(1, (max(visits) + 9999) // 10000) AS unit FROM t),
d AS (SELECT node, label <> (SELECT label FROM core) AS dead FROM part)
SELECT a AS from_id, b AS to_id, {_LINE("CASE WHEN visits // unit < 1 THEN 'red25' WHEN visits // unit < 10 THEN 'red50' WHEN visits // unit < 100 THEN 'red75' ELSE 'red' END", *_AT('a'), *_AT('b'))} AS line,
  b || ',' || {" || ',' || ".join(f"printf('%.6f', {x} / 1e6)" for x in (*_AT('a'), *_AT('b')))} || ',' || visits || ',' || CAST(x.dead OR y.dead AS INTEGER) AS record
FROM t, m JOIN d x ON x.node = a JOIN d y ON y.node = b"""
