"""Queries over tags and scalar functions, with SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import dims, scalars
from wayfold.operators import tags
from wayfold.sources import derived

GREP = "highway=.*ary&&!link"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = derived.tagged_ways(spark, sf_dir)
    return ways.select("way_id", "tags", tags.parse_tags(F.col("tags")).alias("ptags"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.tagged_ways(spark, sf_dir).withColumnRenamed("way_id", "id")


def src10(spark, sf_dir):
    w = derived.tagged_ways(spark, sf_dir)
    return w.select("way_id", *[tags.tag_value(F.col("tags"), k).alias(k) for k in ("highway", "oneway", "name")])


def flt06(spark, sf_dir):
    return tags.grep(_objects(spark, sf_dir), GREP)


def agg01(spark, sf_dir):
    return tags.frequencies(_objects(spark, sf_dir).select("id", F.explode("tags").alias("t")).select("id", "t.k", "t.v"), ["k"])


def agg02(spark, sf_dir):
    rows = _objects(spark, sf_dir).select("id", F.explode("tags").alias("t")).select("id", "t.k", "t.v")
    return tags.top_values(rows, 3)


def prj01(spark, sf_dir):
    return _parsed(spark, sf_dir).select("way_id", F.posexplode("ptags").alias("at", "t")).select(
        "way_id", "at", F.array_join("t.parts", ",").alias("parts"), F.col("t.first").alias("first"), F.col("t.val").alias("val"), F.col("t.sel").alias("sel")
    )


def prj03(spark, sf_dir):
    p = F.col("ptags")
    return _parsed(spark, sf_dir).select("way_id", tags.find_value(p, ("access", "lanes_inner")).alias("access_lanes"), tags.find_value(p, ("forward", "maxspeed")).alias("forward_speed"), F.exists(p, lambda t: tags.has_all(t["parts"], ("lanes",))).alias("has_lanes"))


def prj04(spark, sf_dir):
    w = derived.tagged_ways(spark, sf_dir)
    return w.select("way_id", scalars.parse_speed(tags.tag_value(F.col("tags"), "maxspeed")).alias("kmh"))


def prj05(spark, sf_dir):
    return _parsed(spark, sf_dir).select("way_id", tags.car_maxspeed(F.col("ptags")).alias("s")).select("way_id", F.col("s.forward").alias("forward"), F.col("s.backward").alias("backward"))


def prj07(spark, sf_dir):
    return _parsed(spark, sf_dir).select("way_id", tags.car_access(F.col("ptags"), F.lit(7)).alias("s")).select("way_id", F.col("s.forward").alias("forward"), F.col("s.backward").alias("backward"))


def prj09(spark, sf_dir):
    w = _parsed(spark, sf_dir)
    return w.select("way_id", tags.car_direction(F.col("ptags"), tags.tag_value(F.col("tags"), "highway")).alias("direction"))


def prj13(spark, sf_dir):
    w = _parsed(spark, sf_dir)
    return w.select("way_id", tags.lane_count(F.col("ptags")).alias("lanes"), (tags.lane_count(F.col("ptags")) > 2).alias("more_than_two"))


def prj14(spark, sf_dir):
    return _parsed(spark, sf_dir).select("way_id", tags.priority_road(F.col("ptags")).alias("priority"))


def prj36(spark, sf_dir):
    return derived.tagged_ways(spark, sf_dir).groupBy(tags.signature(F.col("tags")).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("way_id").alias("example"))


def prj19(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).cast("int").alias("place"))
    named = o.select("o_orderkey", "place", dims.name_of(dims.HIGHWAYS, F.col("place")).alias("highway"))
    return named.select("o_orderkey", "highway", dims.ordinal(dims.HIGHWAYS, F.col("highway")).alias("ordinal"))


_W = f"WITH {derived.TAGS}"
_FIRST = "coalesce((SELECT arg_min(v, pos) FROM tags t WHERE t.way_id = o_orderkey AND k = '{k}'), '')"
_SEL = (
    "(CASE WHEN list_has_any(parts, ['forward','backward','left','right','both','both_ways']) THEN 10 ELSE 0 END"
    " + CASE WHEN list_contains(parts, 'lanes_inner') THEN 100 ELSE 0 END + CASE WHEN list_contains(parts, 'vehicle') THEN 1000 ELSE 0 END"
    " + CASE WHEN list_has_any(parts, ['motor_vehicle','psv']) THEN 10000 ELSE 0 END"
    " + CASE WHEN list_has_any(parts, ['motorcar','motorcycle','moped','horse','foot','bus','hgv','bicycle']) THEN 100000 ELSE 0 END)"
)
_PARSED = f"""WITH {derived.TAGS},
p0 AS (SELECT way_id, pos, v, k, string_split(k, ':') AS raw FROM tags),
p1 AS (SELECT way_id, pos, v, raw[1] AS first, list_sort(list_distinct(list_prepend(raw[1], list_transform(raw[2:], lambda x: CASE WHEN x = 'lanes' THEN 'lanes_inner' ELSE x END)))) AS parts FROM p0),
parsed AS (SELECT way_id, pos, v, first, parts, {_SEL} AS sel FROM p1 WHERE first <> 'blabla')"""
_SPEED = """CASE WHEN {v} = 'none' THEN 1023 WHEN {v} = 'walk' THEN 7
 WHEN regexp_full_match({v}, '[0-9]{{1,5}}( km/h)?') THEN CAST(regexp_extract({v}, '[0-9]+') AS INTEGER)
 WHEN regexp_full_match({v}, '[0-9]{{1,5}} mph') THEN CAST(floor(CAST(regexp_extract({v}, '[0-9]+') AS INTEGER) * 1.609344e0 + 0.5) AS INTEGER)
 WHEN regexp_full_match({v}, '[0-9]{{1,5}} knots') THEN CAST(floor(CAST(regexp_extract({v}, '[0-9]+') AS INTEGER) * 1.852e0 + 0.5) AS INTEGER) END"""
_HW = "[" + ", ".join(f"'{h}'" for h in dims.HIGHWAYS) + "]"

QUERIES = {
    "src10_tag_lookup": src10,
    "flt06_tag_grep": flt06,
    "agg01_frequency_table": agg01,
    "agg02_tag_grep_top": agg02,
    "prj01_prj02_parse_tags": prj01,
    "prj03_find_value": prj03,
    "prj04_parse_maxspeed": prj04,
    "prj05_car_maxspeed": prj05,
    "prj07_car_access": prj07,
    "prj09_car_direction": prj09,
    "prj13_lane_count": prj13,
    "prj14_priority_road": prj14,
    "prj19_enum_names": prj19,
    "prj36_tag_signature": prj36,
}

ORACLE_SQL = {
    "src10_tag_lookup": f"{_W} SELECT o_orderkey AS way_id, " + ", ".join(f"{_FIRST.format(k=k)} AS {k}" for k in ("highway", "oneway", "name")) + " FROM orders",
    "flt06_tag_grep": f"{_W} SELECT way_id AS id, k, v FROM tags WHERE regexp_matches(k || '=' || v, '(?i)highway=.*ary') AND NOT regexp_matches(k || '=' || v, '(?i)link')",
    "agg01_frequency_table": f"{_W} SELECT k, count(*) AS n, min(way_id) AS example FROM tags GROUP BY k",
    "agg02_tag_grep_top": f"""{_W}, c AS (SELECT k, v, count(*) AS n, min(way_id) AS example FROM tags GROUP BY k, v),
      t AS (SELECT k, count(*) AS total, count(DISTINCT v) AS uniq FROM tags GROUP BY k),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS INTEGER) AS place FROM c)
      SELECT k, v, n, example, place, total, uniq FROM r JOIN t USING (k) WHERE place <= 3""",
    "prj01_prj02_parse_tags": f"{_PARSED} SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY sel, pos) - 1 AS INTEGER) AS at, array_to_string(parts, ',') AS parts, first, v AS val, sel FROM parsed",
    "prj03_find_value": f"""{_PARSED} SELECT o_orderkey AS way_id,
      coalesce((SELECT v FROM parsed p WHERE p.way_id = o_orderkey AND parts = ['access', 'lanes_inner']), '') AS access_lanes,
      coalesce((SELECT v FROM parsed p WHERE p.way_id = o_orderkey AND parts = ['forward', 'maxspeed']), '') AS forward_speed,
      EXISTS (SELECT 1 FROM parsed p WHERE p.way_id = o_orderkey AND list_contains(parts, 'lanes')) AS has_lanes FROM orders""",
    "prj04_parse_maxspeed": f"{_W}, m AS (SELECT o_orderkey, {_FIRST.format(k='maxspeed')} AS v FROM orders) SELECT o_orderkey AS way_id, {_SPEED.format(v='v')} AS kmh FROM m",
    "prj05_car_maxspeed": f"""{_PARSED},
      s AS (SELECT way_id, sel, pos, list_contains(parts, 'forward') AS f, list_contains(parts, 'backward') AS b,
              CASE WHEN list_contains(parts, 'lanes_inner') THEN list_max(list_transform(string_split(v, '|'), lambda x: coalesce({_SPEED.format(v='x')}, -1)))
                   ELSE coalesce({_SPEED.format(v='v')}, -1) END AS kmh
            FROM parsed WHERE list_contains(parts, 'maxspeed') AND NOT list_contains(parts, 'bicycle')),
      g AS (SELECT * FROM s WHERE kmh BETWEEN 1 AND 1023)
      SELECT o_orderkey AS way_id,
        coalesce((SELECT arg_max(kmh, sel * 100 + pos) FROM g WHERE g.way_id = o_orderkey AND (f OR NOT b)), 0) AS forward,
        coalesce((SELECT arg_max(kmh, sel * 100 + pos) FROM g WHERE g.way_id = o_orderkey AND NOT f), 0) AS backward FROM orders""",
    "prj07_car_access": """WITH d AS (SELECT o_orderkey AS way_id,
        CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN 6 ELSE 7 END AS a FROM orders),
      l AS (SELECT way_id, CASE WHEN a = 0 THEN 0 WHEN way_id % 10 = 0 THEN greatest(a, 7) WHEN way_id % 10 = 4 THEN 3 ELSE a END AS a FROM d)
      SELECT way_id, a AS forward, CASE WHEN way_id % 8 = 0 THEN 0 WHEN way_id % 8 = 3 THEN 1 ELSE a END AS backward FROM l""",
    "prj09_car_direction": """SELECT o_orderkey AS way_id, CASE o_orderkey % 7 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' WHEN 2 THEN 'both' WHEN 3 THEN 'alternating' WHEN 4 THEN NULL
      ELSE CASE WHEN o_orderkey % 27 < 3 OR o_orderkey % 17 = 0 THEN 'forward' ELSE 'both' END END AS direction FROM orders""",
    "prj13_lane_count": """WITH n AS (SELECT o_orderkey AS way_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 4 WHEN o_orderkey % 6 = 1 THEN 3 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END AS INTEGER) AS lanes FROM orders)
      SELECT way_id, lanes, lanes > 2 AS more_than_two FROM n""",
    "prj14_priority_road": "SELECT o_orderkey AS way_id, o_orderkey % 12 IN (0, 1) AS priority FROM orders",
    "prj19_enum_names": f"SELECT o_orderkey, CASE WHEN o_orderkey % 30 < 27 THEN list_extract({_HW}, o_orderkey % 30 + 1) END AS highway, CASE WHEN o_orderkey % 30 < 27 THEN CAST(o_orderkey % 30 AS INTEGER) END AS ordinal FROM orders",
    "prj36_tag_signature": f"{_W}, s AS (SELECT way_id, string_agg(k || '=' || v, ' ## ' ORDER BY k || '=' || v) AS signature FROM tags WHERE k <> 'name' GROUP BY way_id) SELECT signature, count(*) AS n, min(way_id) AS example FROM s GROUP BY signature",
}


# Scalars over pairs of derived nodes.
_RAD = math.pi / 180.0


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.located(spark, sf_dir)


def _ends(*names: str):
    return [F.col(n) for n in names]


def prj23(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", "distance_cm")


def prj24(spark, sf_dir):
    c = _ends("a_lat", "a_lon", "b_lat", "b_lon", "distance_cm")
    back = _ends("b_lat", "b_lon", "a_lat", "a_lon", "distance_cm")
    there, home = scalars.angle_to_east(*c), scalars.angle_to_east(*back)
    return _pairs(spark, sf_dir).select("a", "b", there.alias("angle"), scalars.turn_angle(there, home).alias("back"))


def prj26(spark, sf_dir):
    d, part = scalars.segment_distance(F.lit(46_000_000), F.lit(7_000_000), *_ends("a_lat", "a_lon", "b_lat", "b_lon"))
    return _pairs(spark, sf_dir).select("a", "b", F.round(d / 1000, 1).alias("d"), F.round(part, 6).alias("part"))


def prj27(spark, sf_dir):
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    west, east = F.least("a_lon", "b_lon"), F.greatest("a_lon", "b_lon")
    return _pairs(spark, sf_dir).select("a", "b", F.round(scalars.rect_distance(F.lit(46_000_000), F.lit(7_000_000), low, west, high, east) / 1000, 1).alias("d"))


def prj28(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(scalars.bearing_degrees(*_ends("a_lat", "a_lon", "b_lat", "b_lon")), 6).alias("bearing"))


def prj20(spark, sf_dir):
    x, y = scalars.mercator(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6)
    p = derived.events_tags(spark, sf_dir)
    return p.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), scalars.zoomed(F.round(x, 6), 10).alias("px"), scalars.zoomed(F.round(y, 6), 10).alias("py"))


def prj21(spark, sf_dir):
    p = derived.events_tags(spark, sf_dir)
    return p.select("id", scalars.tile_to_world((F.col("id") % 10).cast("int"), (F.col("id") % 512).cast("int")).alias("x"))


def prj30(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation").select("n_nationkey", F.upper(F.substring("n_name", 1, 2)).alias("code"))
    return n.select("n_nationkey", "code", scalars.country_number(F.col("code")).alias("number"), scalars.country_code(scalars.country_number(F.col("code"))).alias("again"))


def prj31(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") * F.col("event_id") * 37) % 60_000_000).alias("ms"))
    code = scalars.compress_turn_cost(F.col("ms"))
    return e.select("id", "ms", code.alias("code"), scalars.decompress_turn_cost(code).alias("again"))


def prj33(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", scalars.time_metric(F.col("distance_cm"), F.col("maxspeed"), F.lit(500).cast("long")).alias("ms"))


def prj34(spark, sf_dir):
    own = scalars.limited_speed(F.when(F.col("way_id") % 3 == 0, F.lit(0)).otherwise(F.col("maxspeed")), F.lit(50), F.when(F.col("way_id") % 5 == 0, F.lit(80)).otherwise(F.lit(0)))
    return derived.links(spark, sf_dir).select("a", "b", own.cast("long").alias("speed"))


def prj37(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") - 500).alias("v"))
    return e.select("id", scalars.zigzag(F.col("v")).alias("z"))


def prj43(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("acc"))
    return o.select("o_orderkey", scalars.routable(F.col("acc")).alias("routable"), scalars.free_access(F.col("acc")).alias("free"), scalars.restricted_access(F.col("acc")).alias("restricted"))


def grf18(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 360) - 179).cast("int").alias("angle"))
    return e.select("id", "angle", scalars.curve_cost(F.col("angle")).alias("ms"))


LOCATED = f"""WITH {derived.LINKS}, {derived.NODES},
l0 AS (SELECT links.*, n.lat_e6 AS a_lat, n.lon_e6 AS a_lon, m.lat_e6 AS b_lat, m.lon_e6 AS b_lon
       FROM links JOIN nodes n ON a = n.id JOIN nodes m ON b = m.id),
located AS (SELECT *, CAST(round(2.0e0 * 637100000.0e0 * atan2(sqrt(h), sqrt(1.0e0 - h))) AS BIGINT) AS distance_cm
  FROM (SELECT *, pow(sin((radians(b_lat / 1e6) - radians(a_lat / 1e6)) / 2), 2)
        + cos(radians(a_lat / 1e6)) * cos(radians(b_lat / 1e6)) * pow(sin((radians(b_lon / 1e6) - radians(a_lon / 1e6)) / 2), 2) AS h FROM l0))"""
_CM = f"(637100000.0e0 * {_RAD!r}e0 / 1e6)"


def _steep(p: str, q: str) -> str:
    height = f"round(637100000.0e0 * pi() * 2 / 360.0e0 * (abs({q}_lat - {p}_lat) / 1e6))"
    s = f"CAST(CASE WHEN {height} < distance_cm THEN round(180.0e0 * asin({height} / distance_cm) / pi()) ELSE 90 END AS INTEGER)"
    return f"CASE WHEN distance_cm = 0 THEN 0 WHEN {q}_lat >= {p}_lat AND {q}_lon >= {p}_lon THEN {s} WHEN {q}_lat >= {p}_lat THEN 180 - {s} WHEN {q}_lon >= {p}_lon THEN (360 - {s}) % 360 ELSE 180 + {s} END"


def _segment(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> tuple[str, str]:
    px, py = f"({_CM} * (7000000 - {a_lon}) * cos(radians({a_lat} / 1e6)))", f"({_CM} * (46000000 - {a_lat}))"
    bx, by = f"({_CM} * ({b_lon} - {a_lon}) * cos(radians({a_lat} / 1e6)))", f"({_CM} * ({b_lat} - {a_lat}))"
    t = f"(CASE WHEN {bx} * {bx} + {by} * {by} < 1e-10 THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, ({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by}))) END)"
    return f"sqrt(pow({px} - {t} * {bx}, 2) + pow({py} - {t} * {by}, 2))", t


_D, _T = _segment("a_lat", "a_lon", "b_lat", "b_lon")
_LO, _HI, _WE, _EA = "least(a_lat, b_lat)", "greatest(a_lat, b_lat)", "least(a_lon, b_lon)", "greatest(a_lon, b_lon)"
_SIDES = ", ".join(_segment(*s)[0] for s in ((_LO, _WE, _LO, _EA), (_HI, _WE, _HI, _EA), (_LO, _WE, _HI, _WE), (_LO, _EA, _HI, _EA)))
_COSTS = "[" + ", ".join(map(str, dims.TURN_COSTS)) + "]"
_TURN = "CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} <= -180 THEN {d} + 360 ELSE {d} END"

QUERIES |= {
    "prj20_mercator": prj20,
    "prj21_tile_to_world": prj21,
    "prj23_haversine": prj23,
    "prj24_prj25_angles": prj24,
    "prj26_segment_distance": prj26,
    "prj27_rect_distance": prj27,
    "prj28_bearing": prj28,
    "prj30_country_codes": prj30,
    "prj31_turn_cost_codec": prj31,
    "prj33_time_metric": prj33,
    "prj34_limited_speed": prj34,
    "prj37_zigzag": prj37,
    "prj43_access_predicates": prj43,
    "grf18_curve_cost": grf18,
}

ORACLE_SQL |= {
    "prj20_mercator": f"""WITH {derived.POINTS}, w AS (SELECT id, round((lon_e6 / 1e6 + 180) * (256e0 / 360), 6) AS x,
      round((pi() - ln(tan(pi() / 4 + radians(lat_e6 / 1e6) / 2))) * (256e0 / (2 * pi())), 6) AS y FROM points)
      SELECT id, x, y, CAST(trunc(x * 1024) AS INTEGER) AS px, CAST(trunc(y * 1024) AS INTEGER) AS py FROM w""",
    "prj21_tile_to_world": "SELECT event_id AS id, CAST(256 * (event_id % 512) AS DOUBLE) / pow(2.0e0, event_id % 10) AS x FROM events",
    "prj23_haversine": f"{LOCATED} SELECT a, b, distance_cm FROM located",
    "prj24_prj25_angles": f"{LOCATED}, g AS (SELECT a, b, {_steep('a', 'b')} AS angle, {_steep('b', 'a')} AS home FROM located) SELECT a, b, CAST(angle AS INTEGER) AS angle, CAST({_TURN.format(d='(home - angle)')} AS INTEGER) AS back FROM g",
    "prj26_segment_distance": f"{LOCATED} SELECT a, b, round({_D} / 1000, 1) AS d, round({_T}, 6) AS part FROM located",
    "prj27_rect_distance": f"{LOCATED} SELECT a, b, CASE WHEN 46000000 BETWEEN {_LO} AND {_HI} AND 7000000 BETWEEN {_WE} AND {_EA} THEN 0.0e0 ELSE round(least({_SIDES}) / 1000, 1) END AS d FROM located",
    "prj28_bearing": f"""{LOCATED}, g AS (SELECT a, b, degrees(atan2(sin(radians((b_lon - a_lon) / 1e6)) * cos(radians(b_lat / 1e6)),
      cos(radians(a_lat / 1e6)) * sin(radians(b_lat / 1e6)) - sin(radians(a_lat / 1e6)) * cos(radians(b_lat / 1e6)) * cos(radians((b_lon - a_lon) / 1e6)))) + 360 AS d FROM located)
      SELECT a, b, round(CASE WHEN d >= 360 THEN d - 360 ELSE d END, 6) AS bearing FROM g""",
    "prj30_country_codes": "SELECT n_nationkey, upper(substr(n_name, 1, 2)) AS code, CAST((ascii(substr(upper(n_name), 1, 1)) - 64) * 32 + ascii(substr(upper(n_name), 2, 1)) - 64 AS INTEGER) AS number, upper(substr(n_name, 1, 2)) AS again FROM nation",
    "prj31_turn_cost_codec": f"""WITH e AS (SELECT event_id AS id, (event_id * event_id * 37) % 60000000 AS ms FROM events),
      v AS (SELECT unnest({_COSTS}) AS c, unnest(range(0, 63)) AS i),
      r AS (SELECT id, ms, c, i, row_number() OVER (PARTITION BY id ORDER BY abs(c - ms), i) AS p FROM e, v)
      SELECT id, ms, CAST(CASE WHEN ms > 45103400 THEN 63 ELSE i END AS INTEGER) AS code, CAST(CASE WHEN ms > 45103400 THEN 1000000000 ELSE c END AS BIGINT) AS again FROM r WHERE p = 1""",
    "prj33_time_metric": f"{LOCATED} SELECT a, b, distance_cm * 36 // maxspeed + 500 AS ms FROM located",
    "prj34_limited_speed": f"WITH {derived.LINKS}, o AS (SELECT a, b, way_id, CASE WHEN way_id % 3 = 0 THEN 50 ELSE maxspeed END AS s FROM links) SELECT a, b, CAST(CASE WHEN way_id % 5 = 0 AND s > 80 THEN 80 ELSE s END AS BIGINT) AS speed FROM o",
    "prj37_zigzag": "SELECT event_id AS id, CASE WHEN event_id >= 500 THEN 2 * (event_id - 500) ELSE -2 * (event_id - 500) - 1 END AS z FROM events",
    "prj43_access_predicates": "SELECT o_orderkey, o_orderkey % 9 >= 2 AS routable, o_orderkey % 9 >= 5 AS free, o_orderkey % 9 BETWEEN 2 AND 4 AS restricted FROM orders",
    "grf18_curve_cost": "SELECT event_id AS id, CAST(event_id % 360 - 179 AS INTEGER) AS angle, CAST(CASE WHEN abs(event_id % 360 - 179) <= 20 THEN 0 WHEN abs(event_id % 360 - 179) <= 60 THEN 500 WHEN abs(event_id % 360 - 179) <= 120 THEN 2000 WHEN abs(event_id % 360 - 179) <= 179 THEN 4000 ELSE 20000 END AS INTEGER) AS ms FROM events",
}
