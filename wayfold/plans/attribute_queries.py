"""Queries over way attributes, node tags, turns, points of interest and edge routes, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import dims, scalars
from wayfold.operators import edge_routing, junctions, points, road_graph, routing, tags
from wayfold.plans.graph_queries import E, _edges, _requests
from wayfold.plans.tag_queries import _TURN, ORACLE_SQL as TAG_SQL, _steep
from wayfold.sources import derived

YES = dims.ACCESS.index("yes")


def _ways(spark, sf_dir) -> DataFrame:
    w = derived.richly_tagged_ways(spark, sf_dir)
    return w.select("way_id", tags.tag_value(F.col("tags"), "highway").alias("highway"), tags.parse_tags(F.col("tags")).alias("p"))


def _sides(rows: DataFrame) -> DataFrame:
    return rows.select("way_id", F.col("s.forward").alias("forward"), F.col("s.backward").alias("backward"))


def prj06(spark, sf_dir):
    return _sides(_ways(spark, sf_dir).select("way_id", tags.bicycle_maxspeed(F.col("p")).alias("s")))


def prj08(spark, sf_dir):
    return _sides(_ways(spark, sf_dir).select("way_id", tags.bicycle_access(F.col("p"), F.lit(YES)).alias("s")))


def prj10(spark, sf_dir):
    return _ways(spark, sf_dir).select("way_id", tags.bicycle_direction(F.col("p"), F.col("highway")).alias("direction"))


def prj11(spark, sf_dir):
    return _ways(spark, sf_dir).select("way_id", tags.surface(F.col("p")).alias("s")).select("way_id", "s.*")


def prj12(spark, sf_dir):
    return _ways(spark, sf_dir).select("way_id", tags.zones(F.col("p")).alias("z")).select("way_id", "z.*")


def prj35(spark, sf_dir):
    """Car and bicycle attributes of ways, with 50 km/h where no tag says otherwise and no more than 120."""
    w = _ways(spark, sf_dir)
    both = [tags.way_attributes(F.col("p"), F.col("highway"), F.lit(YES), F.lit(speed), F.lit(limit), kind).alias(name) for name, kind, speed, limit in (("car", tags.CAR, 50, 120), ("bicycle", tags.BICYCLE, 20, 25))]
    found = w.select("way_id", *both)
    return found.select("way_id", *[F.col(f"{kind}.{side}.{part}").alias(f"{kind}_{side}_{part}") for kind in ("car", "bicycle") for side in ("forward", "backward") for part in ("access", "speed")])


def _nodes(spark, sf_dir) -> DataFrame:
    return derived.tagged_nodes(derived.links(spark, sf_dir))


def prj15(spark, sf_dir):
    return _nodes(spark, sf_dir).select("id", tags.parse_tags(F.col("tags")).alias("p")).select("id", junctions.node_tags(F.col("p")).alias("t")).select("id", "t.*")


def prj17(spark, sf_dir):
    records = junctions.node_records(_nodes(spark, sf_dir))
    return records.select("id", "barrier", "access_forward", "access_backward")


def flt07(spark, sf_dir):
    ways = derived.richly_tagged_ways(spark, sf_dir)
    return points.points_of_interest(_nodes(spark, sf_dir), ways, derived.ways(spark, sf_dir).select("way_id", "ref"))


def flt04(spark, sf_dir):
    """Ways over few nodes, so that nodes and segments repeat, without their repeats."""
    w = derived.ways(spark, sf_dir).withColumn("ref", F.col("ref") % 5)
    return points.without_repeats(w)


def _driven(spark, sf_dir, records: DataFrame) -> DataFrame:
    """Driven edges with what turns need; signs and signals of a node hold for all edges that arrive there."""
    e = _edges(spark, sf_dir).where(~F.col("inverted"))
    signs = records.where("stop OR give_way OR traffic_signals").select(F.col("id").alias("to_id"), "stop", "give_way", "traffic_signals")
    signed = e.join(signs, "to_id", "left")
    # an edge against its way begins at the link's second end
    end = lambda first, second, axis: F.when(F.col("contra_way"), F.col(f"{second}_{axis}")).otherwise(F.col(f"{first}_{axis}"))
    east = scalars.angle_to_east(end("a", "b", "lat"), end("a", "b", "lon"), end("b", "a", "lat"), end("b", "a", "lon"), F.col("distance_cm"))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    priority = F.when(on("traffic_signals"), "signals").when(on("give_way") | on("stop"), "low").when(F.col("way_id") % 17 == 0, "high")
    return signed.select(
        "from_id", "to_id", "way_id", "highway", "distance_cm", "restricted", F.when(F.col("restricted"), 4).otherwise(YES).alias("access"), priority.alias("priority"), on("stop").alias("stop"),
        on("traffic_signals").alias("signal"), (F.col("way_id") % 101 == 0).alias("reversible"), (F.col("way_id") % 89 == 0).alias("area"), east.alias("east"),
    )


def _rules(driven: DataFrame) -> DataFrame:
    """A restriction at every third node, from its least neighbour to its greatest: forbidden at even nodes, ordered at odd ones."""
    into = driven.where("to_id % 3 = 0").groupBy(F.col("to_id").alias("via")).agg(F.min(F.struct("from_id", "way_id")).alias("f"))
    out = driven.where("from_id % 3 = 0").groupBy(F.col("from_id").alias("via")).agg(F.max(F.struct("to_id", "way_id")).alias("t"))
    return into.join(out, "via").select(F.col("via").alias("relation_id"), "f.from_id", "f.way_id", "via", F.col("t.way_id").alias("to_way"), F.col("t.to_id").alias("to_id"), (F.col("via") % 2 == 0).alias("forbidden"))


def _turns(spark, sf_dir) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    records = routing.checkpointed(junctions.node_records(nodes))
    driven = routing.checkpointed(_driven(spark, sf_dir, records))
    return junctions.turn_costs(driven, records, _rules(driven), nodes.select("id", "lat_e6", "lon_e6"), derived.pieces(spark, sf_dir))


def grf17(spark, sf_dir):
    """Every turn's cost, summed for each node: turns, those without passage, u-turns, cost, codes."""
    turns = _turns(spark, sf_dir)
    u = F.col("n0") == F.col("n2")
    return turns.groupBy("n1").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("cost_ms").isNull()).alias("closed"), F.count_if(u & F.col("cost_ms").isNotNull()).alias("u_turns"), F.coalesce(F.sum("cost_ms"), F.lit(0)).alias("cost_ms"),
        F.max("cost_ms").alias("dearest"), F.sum("code").alias("codes"), F.sum(F.abs("angle")).alias("angles"),
    )


def _network(spark, sf_dir, sources: DataFrame) -> tuple[edge_routing.EdgeNetwork, DataFrame]:
    """The driven edges that sources' searches may meet, as a network with travel times; turning back is closed where one can go on."""
    e = _edges(spark, sf_dir).where(~F.col("inverted"))
    timed = e.select("from_id", "to_id", scalars.time_metric(F.col("distance_cm"), F.col("maxspeed"), F.lit(0).cast("long")).alias("weight"), "restricted")
    met, nodes = routing.near_sources(routing.checkpointed(timed), sources)
    edges = routing.checkpointed(road_graph.dense_index(met, "from_id", "edge_id", ties=("to_id",), width=64).select("edge_id", "from_id", "to_id", "weight", "restricted"))
    back = edges.select(F.col("edge_id").alias("edge_0"), F.col("from_id").alias("x"), F.col("to_id").alias("y")).join(edges.select(F.col("edge_id").alias("edge_1"), F.col("from_id").alias("y"), F.col("to_id").alias("x")), ["x", "y"])
    many = edges.groupBy(F.col("from_id").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    closed = back.join(many, "y").select("edge_0", "edge_1", F.lit(None).cast("long").alias("cost_ms"))
    placed = nodes.select(F.col("node").alias("id"), derived.latitude(F.col("node")).alias("lat_e6"), derived.longitude(F.col("node")).alias("lon_e6"))
    return edge_routing.edge_network(edges, closed, nodes=placed), edges


def grf34(spark, sf_dir):
    """Routes with restricted areas, guided by the great circle."""
    network, _ = _network(spark, sf_dir, _requests(spark, sf_dir))
    return edge_routing.edge_routes(network, _requests(spark, sf_dir), guided=True).select("req_id", "metric")


def grf31(spark, sf_dir):
    """From each nation's customer over all edges: the least metric at each node."""
    network, edges = _network(spark, sf_dir, _requests(spark, sf_dir))
    found = edge_routing.edge_distances(network, _requests(spark, sf_dir).select("source"))
    return edge_routing.node_metrics(found, edges).select("source", "node", "metric")


QUERIES = {
    "prj06_bicycle_maxspeed": prj06,
    "prj08_bicycle_access": prj08,
    "prj10_bicycle_direction": prj10,
    "prj11_surface": prj11,
    "prj12_way_zones": prj12,
    "prj35_way_attributes": prj35,
    "prj15_prj16_node_tags": prj15,
    "prj17_prj18_barriers": prj17,
    "flt07_jon16_points_of_interest": flt07,
    "flt04_repeated_segments": flt04,
    "grf17_grf19_grf20_grf21_flt10_flt11_turn_costs": grf17,
    "grf31_grf32_edge_distances": grf31,
    "grf34_grf35_grf37_edge_routes": grf34,
}

_K = "o_orderkey"
_SPEED = f"CASE {_K} % 9 WHEN 0 THEN 50 WHEN 1 THEN 48 WHEN 2 THEN 1023 WHEN 3 THEN 7 WHEN 4 THEN 80 WHEN 6 THEN 22 ELSE 0 END"
_ORD = lambda names, v: f"CAST(nullif(list_position([{', '.join(chr(39) + n + chr(39) for n in names)}], {v}), 0) - 1 AS INTEGER)"
_SURF = f"CASE {_K} % 10 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'moon dust' WHEN 3 THEN 'sett' END"
_SMOOTH = f"CASE {_K} % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'very_bad' END"
_WAY_ACCESS = f"CASE {_K} % 6 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN 6 ELSE 7 END"
_LANED = f"CASE WHEN ({_WAY_ACCESS}) = 0 THEN 0 WHEN {_K} % 10 = 0 THEN greatest({_WAY_ACCESS}, 7) WHEN {_K} % 10 = 4 THEN 3 ELSE {_WAY_ACCESS} END"
_BIKE = f"CASE {_K} % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 8 ELSE {{side}} END"
_BIKE_ACCESS = f"SELECT {_K} AS way_id, CAST({_BIKE.format(side=f'CASE WHEN {_K} % 12 = 0 THEN 1 ELSE {_LANED} END')} AS INTEGER) AS forward, CAST({_BIKE.format(side=_LANED)} AS INTEGER) AS backward FROM orders"
_BIKE_SPEED = f"""SELECT {_K} AS way_id, CAST(CASE WHEN {_K} % 5 = 0 THEN 20 WHEN {_K} % 11 = 0 THEN 60 WHEN {_K} % 13 = 0 THEN 70 ELSE {_SPEED} END AS INTEGER) AS forward,
  CAST(CASE WHEN {_K} % 5 = 0 THEN 20 WHEN {_K} % 11 = 0 THEN 60 ELSE {_SPEED} END AS INTEGER) AS backward FROM orders"""
_BIKE_WAY = f"""SELECT way_id, CASE WHEN way_id % 9 = 0 AND coalesce(d, 'none') NOT IN ('both', 'alternating', 'reversible') THEN CASE WHEN d IS NULL THEN 'backward' ELSE 'both' END ELSE d END AS direction
  FROM (SELECT {_K} AS way_id, CASE WHEN {_K} % 8 = 0 THEN 'both' WHEN {_K} % 7 = 0 THEN 'forward' WHEN {_K} % 7 = 1 THEN 'backward' WHEN {_K} % 7 = 2 THEN 'both' WHEN {_K} % 7 = 3 THEN 'alternating' WHEN {_K} % 7 = 4 THEN NULL
    WHEN {_K} % 27 <= 2 OR {_K} % 17 = 0 THEN 'forward' ELSE 'both' END AS d FROM orders)"""
_CAR_ACCESS = f"SELECT way_id, CASE WHEN way_id % 12 = 0 THEN 1 ELSE forward END AS forward, backward FROM ({TAG_SQL['prj07_car_access']})"


def _attributes(kind: str, access: str, speed: str, way: str, default: int, limit: int, third: bool) -> str:
    def side(name: str) -> str:
        tagged = f"least({limit}, CASE WHEN s.{name} > 0 THEN s.{name} ELSE {default} END)"
        own = f"CASE WHEN d.direction = 'alternating' THEN {tagged} // 3 ELSE {tagged} END" if third else tagged
        open_ = f"(d.direction IN ('both', 'alternating', 'reversible', '{name}') AND a.{name} >= 2 AND {own} > 0)"
        return f"CASE WHEN {open_} THEN a.{name} END AS {kind}_{name}_access, CAST(CASE WHEN {open_} THEN {own} END AS INTEGER) AS {kind}_{name}_speed"

    return f"SELECT way_id, {side('forward')}, {side('backward')} FROM ({access}) a JOIN ({speed}) s USING (way_id) JOIN ({way}) d USING (way_id)"


_NODE = f"WITH {derived.LINKS}, {derived.NODES}, {derived.NODE_TAGS}"
_RAIL = "coalesce(railway IN ('crossing', 'tram_crossing', 'level_crossing', 'tram_level_crossing'), false)"
_BARRIER = ", ".join(f"'{b}'" for b in dims.BARRIERS)
_OPEN = ", ".join(f"'{b}'" for b, v in dims.BARRIERS.items() if "motorcar" in v)
_RECORDS = f"""rec AS (SELECT id, highway = 'turning_circle' AS circle, coalesce(highway = 'crossing', false) AS crossing_, coalesce(highway = 'stop', false) AS stop_, coalesce(highway = 'give_way', false) AS give_way,
    coalesce(highway = 'traffic_signals', false) AS signals, {_RAIL} AS rail, {_RAIL} AND coalesce("crossing:barrier" IN ('yes', 'full', 'half', 'double_half', 'gate', 'chain', 'gates'), false) AS rail_barrier,
    coalesce(public_transport IN ('stop_position', 'platform', 'station'), false) AS transport, coalesce(traffic_calming NOT IN ('', 'no'), false) AS calming,
    CASE WHEN barrier IS NOT NULL THEN CASE WHEN barrier IN ({_BARRIER}) THEN barrier ELSE 'unknown' END END AS barrier_,
    CAST(CASE WHEN barrier IS NULL THEN 7 ELSE CASE motor_vehicle WHEN 'no' THEN 0 WHEN 'destination' THEN 4 WHEN 'yes' THEN 7 ELSE CASE WHEN barrier IN ({_OPEN}) THEN 7 ELSE 0 END END END AS INTEGER) AS acc
  FROM node_tags)"""

ORACLE_SQL = {
    "prj06_bicycle_maxspeed": _BIKE_SPEED,
    "prj08_bicycle_access": _BIKE_ACCESS,
    "prj10_bicycle_direction": _BIKE_WAY,
    "prj11_surface": f"""SELECT {_K} AS way_id, {_ORD(dims.SURFACES, f"CASE WHEN {_K} % 15 = 0 THEN 'asphalt' WHEN {_K} % 14 = 0 THEN 'dirt' ELSE {_SURF} END")} AS surface_forward,
      {_ORD(dims.SURFACES, f"CASE WHEN {_K} % 15 = 0 THEN 'asphalt' ELSE {_SURF} END")} AS surface_backward,
      {_ORD(dims.SMOOTHNESS, _SMOOTH)} AS smoothness_forward, {_ORD(dims.SMOOTHNESS, f"CASE WHEN {_K} % 22 = 0 THEN 'horrible' ELSE {_SMOOTH} END")} AS smoothness_backward,
      CAST(CASE WHEN {_K} % 8 = 0 THEN 2 END AS INTEGER) AS tracktype_forward, CAST(CASE WHEN {_K} % 8 = 0 THEN 2 END AS INTEGER) AS tracktype_backward FROM orders""",
    "prj12_way_zones": f"""SELECT {_K} AS way_id, CASE WHEN {_K} % 20 = 0 THEN 'IT' WHEN {_K} % 18 = 0 THEN 'FR' WHEN {_K} % 18 = 1 THEN 'DE' ELSE '--' END AS country,
      CASE WHEN {_K} % 20 = 0 THEN 'urban' WHEN {_K} % 18 = 0 THEN 'rural' WHEN {_K} % 18 IN (1, 3) THEN 'urban' END AS env_forward, CASE WHEN {_K} % 18 = 0 THEN 'rural' WHEN {_K} % 18 IN (1, 3) THEN 'urban' END AS env_backward,
      {_K} % 16 = 0 AS motorroad_forward, {_K} % 32 = 1 AS motorroad_backward FROM orders""",
    "prj35_way_attributes": f"""SELECT * FROM ({_attributes('car', _CAR_ACCESS, TAG_SQL['prj05_car_maxspeed'], TAG_SQL['prj09_car_direction'], 50, 120, True)}) JOIN ({_attributes('bicycle', _BIKE_ACCESS, _BIKE_SPEED, _BIKE_WAY, 20, 25, False)}) USING (way_id)""",
    "prj15_prj16_node_tags": f"""{_NODE} SELECT id, coalesce(highway = 'crossing', false) AS crossing,
      coalesce(highway = 'crossing', false) AND coalesce(CASE "crossing:signals" WHEN 'yes' THEN true WHEN 'no' THEN false ELSE crossing = 'traffic_signals' END, false) AS crossing_signals,
      coalesce(highway = 'crossing', false) AND coalesce(CASE WHEN "crossing:markings" IS NOT NULL THEN "crossing:markings" <> 'no' ELSE crossing IN ('uncontrolled', 'marked', 'zebra') END, false) AS crossing_markings,
      coalesce("traffic_signals:direction", direction) AS direction, coalesce(highway = 'turning_circle', false) AS turning_circle, coalesce(highway = 'stop', false) AS stop,
      coalesce(highway = 'stop' AND stop = 'all', false) AS stop_all, coalesce(highway = 'give_way', false) AS give_way, coalesce(highway = 'traffic_signals', false) AS traffic_signals,
      {_RAIL} AS railway_crossing, {_RAIL} AND coalesce("crossing:barrier" IN ('yes', 'full', 'half', 'double_half', 'gate', 'chain', 'gates'), false) AS railway_barrier,
      coalesce(public_transport IN ('stop_position', 'platform', 'station'), false) AS public_transport, coalesce(traffic_calming NOT IN ('', 'no'), false) AS traffic_calming FROM node_tags""",
    "prj17_prj18_barriers": f"""{_NODE}, {_RECORDS} SELECT id, barrier_ AS barrier, acc AS access_forward, acc AS access_backward FROM rec
      WHERE crossing_ OR coalesce(circle, false) OR stop_ OR give_way OR signals OR rail OR transport OR calming OR barrier_ IS NOT NULL""",
    "flt07_jon16_points_of_interest": f"""{_NODE}, {derived.WAYS},
      pn AS (SELECT 'n' AS kind, id, coalesce(tourism, shop, CASE WHEN amenity NOT IN ('bench', 'clock') THEN amenity END, CASE WHEN railway = 'stop' THEN 'railway-stop' END) AS name,
          CASE WHEN tourism IS NOT NULL THEN 'tourism' WHEN shop IS NOT NULL THEN 'shop' WHEN amenity NOT IN ('bench', 'clock') THEN 'amenity' WHEN railway = 'stop' THEN 'railway' END AS type,
          CAST(lat_e6 AS BIGINT) AS lat_e6, CAST(lon_e6 AS BIGINT) AS lon_e6, CAST(1 AS BIGINT) AS points FROM node_tags),
      pw AS (SELECT {_K} AS way_id, CASE WHEN {_K} % 70 = 0 THEN 'railway-stop' WHEN {_K} % 60 = 0 THEN 'hotel' WHEN {_K} % 40 = 0 THEN 'parking' END AS name,
          CASE WHEN {_K} % 70 = 0 THEN 'railway' WHEN {_K} % 60 = 0 THEN 'tourism' WHEN {_K} % 40 = 0 THEN 'amenity' END AS type FROM orders)
      SELECT * FROM pn WHERE name IS NOT NULL
      UNION ALL SELECT 'w', way_id, name, type, CAST(sum(lat_e6) AS BIGINT) // count(*), CAST(sum(lon_e6) AS BIGINT) // count(*), count(*) FROM pw JOIN ways USING (way_id) JOIN nodes ON ref = id WHERE name IS NOT NULL GROUP BY way_id, name, type""",
}
ORACLE_SQL["grf17_grf19_grf20_grf21_flt10_flt11_turn_costs"] = f"""{E}, {derived.NODE_TAGS}, {_RECORDS},
kept AS (SELECT * FROM rec WHERE crossing_ OR coalesce(circle, false) OR stop_ OR give_way OR signals OR rail OR transport OR calming OR barrier_ IS NOT NULL),
dr AS (SELECT from_id, to_id, way_id, highway, distance_cm, restricted, CASE WHEN restricted THEN 4 ELSE 7 END AS access,
    CASE WHEN k.signals THEN 'signals' WHEN k.give_way OR k.stop_ THEN 'low' WHEN way_id % 17 = 0 THEN 'high' END AS prio, coalesce(k.stop_, false) AS stop_, coalesce(k.signals, false) AS signal_,
    way_id % 101 = 0 AS rev, way_id % 89 = 0 AS area,
    CASE WHEN from_id = a THEN a_lat ELSE b_lat END AS p_lat, CASE WHEN from_id = a THEN a_lon ELSE b_lon END AS p_lon, CASE WHEN from_id = a THEN b_lat ELSE a_lat END AS q_lat, CASE WHEN from_id = a THEN b_lon ELSE a_lon END AS q_lon
  FROM edges LEFT JOIN kept k ON k.id = to_id WHERE NOT inverted),
x AS (SELECT *, {_steep('p', 'q')} AS east FROM dr),
ends AS (SELECT from_id AS n, to_id AS o FROM dr UNION SELECT to_id, from_id FROM dr),
uq AS (SELECT n, count(DISTINCT o) AS uniq FROM ends WHERE n <> o GROUP BY n),
hw AS (SELECT n, min(highway) AS best FROM (SELECT from_id AS n, highway FROM dr UNION ALL SELECT to_id, highway FROM dr) GROUP BY n),
inc AS (SELECT n, best, (SELECT count(*) FROM dr WHERE to_id = n AND highway = best) AS incoming FROM hw),
ou AS (SELECT from_id AS n, count(*) AS ways_out, count(*) FILTER (NOT restricted) AS free_out FROM dr WHERE from_id <> to_id GROUP BY 1),
ob AS (SELECT from_id AS n, to_id AS o, count(*) AS ways_back, count(*) FILTER (NOT restricted) AS free_back FROM dr WHERE from_id <> to_id GROUP BY 1, 2),
f1 AS (SELECT to_id AS via, min(from_id) AS rf FROM dr WHERE to_id % 3 = 0 GROUP BY 1), t1 AS (SELECT from_id AS via, max(to_id) AS rt FROM dr WHERE from_id % 3 = 0 GROUP BY 1),
ru AS (SELECT f1.via, rf, rt, f1.via % 2 = 0 AS forbidden FROM f1 JOIN t1 ON f1.via = t1.via),
e0 AS (SELECT x.*, uniq, best, incoming, coalesce(ways_out, 0) > coalesce(ways_back, 0) AS goes_on, coalesce(free_out, 0) > coalesce(free_back, 0) AS goes_free, k.id IS NOT NULL AS tagged, coalesce(k.circle, false) AS circle, k.acc,
    greatest(CASE WHEN x.stop_ THEN 3000 ELSE 0 END + CASE WHEN signal_ THEN 20000 ELSE 0 END + CASE WHEN k.crossing_ THEN 3000 ELSE 0 END
      + CASE WHEN k.rail THEN 500 + CASE WHEN k.rail_barrier AND (NOT coalesce(z.rail_barrier, false) OR distance_cm > 5000) THEN 40000 ELSE 0 END ELSE 0 END
      + CASE WHEN k.calming OR k.barrier_ IS NOT NULL THEN 1000 ELSE 0 END,
      CASE WHEN coalesce(uniq, 0) < 3 THEN 0 WHEN prio IN ('high', 'signals') THEN (uniq - 2) * 500 WHEN prio = 'low' THEN uniq * 2000
        WHEN highway < 13 AND highway = best THEN CASE WHEN incoming <= 1 THEN (uniq - 2) * 1000 ELSE incoming * 1500 END ELSE uniq * 1500 END) AS node_ms,
    CASE WHEN ru.via IS NOT NULL THEN ru.rt END AS rt, ru.forbidden
  FROM x LEFT JOIN uq ON uq.n = to_id LEFT JOIN inc ON inc.n = to_id LEFT JOIN ou ON ou.n = to_id LEFT JOIN ob ON ob.n = to_id AND ob.o = from_id LEFT JOIN kept k ON k.id = to_id LEFT JOIN kept z ON z.id = from_id
    LEFT JOIN ru ON ru.via = to_id AND ru.rf = from_id),
p AS (SELECT e.to_id AS n1, e.from_id = f.to_id AS u, e.way_id = f.way_id AS same, CAST({_TURN.format(d='(f.east - e.east)')} AS INTEGER) AS angle,
    CASE WHEN e.rt IS NULL THEN false WHEN e.rt = f.to_id THEN e.forbidden ELSE e.from_id <> f.to_id AND NOT e.forbidden END AS forbid, coalesce(e.rt = f.to_id AND NOT e.forbidden, false) AS allow,
    e.tagged AND (e.acc < 2 OR (e.acc < 5 AND e.access <> e.acc AND f.access <> e.acc)) AS blocked, e.area, e.circle, e.highway > 4 AS small, NOT e.goes_on OR (NOT e.restricted AND NOT e.goes_free) AS stuck, e.node_ms, f.rev AND NOT e.rev AS rev
  FROM e0 e JOIN x f ON e.to_id = f.from_id),
c AS (SELECT n1, u, angle, CASE WHEN forbid THEN NULL WHEN u THEN CASE WHEN allow OR circle OR (small AND ((area AND same) OR (blocked AND same) OR stuck)) THEN 20000 END WHEN blocked AND NOT (area AND same) THEN NULL
    ELSE greatest(node_ms, CASE WHEN abs(angle) <= 20 THEN 0 WHEN abs(angle) <= 60 THEN 500 WHEN abs(angle) <= 120 THEN 2000 WHEN abs(angle) <= 179 THEN 4000 ELSE 20000 END, CASE WHEN NOT same AND rev THEN 1800000 ELSE 0 END) END AS ms FROM p),
tc AS (SELECT unnest([{', '.join(map(str, dims.TURN_COSTS))}]) AS v, unnest(range(0, {len(dims.TURN_COSTS)})) AS i),
cd AS (SELECT ms, (SELECT arg_min(i, (abs(v - ms), i)) FROM tc) AS code FROM (SELECT DISTINCT ms FROM c WHERE ms IS NOT NULL))
SELECT n1, count(*) AS turns, count(*) FILTER (c.ms IS NULL) AS closed, count(*) FILTER (u AND c.ms IS NOT NULL) AS u_turns, CAST(coalesce(sum(c.ms), 0) AS BIGINT) AS cost_ms, CAST(max(c.ms) AS BIGINT) AS dearest,
  CAST(sum(coalesce(code, 63)) AS BIGINT) AS codes, CAST(sum(abs(angle)) AS BIGINT) AS angles FROM c LEFT JOIN cd ON cd.ms = c.ms GROUP BY n1"""
