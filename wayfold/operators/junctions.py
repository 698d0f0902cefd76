"""Junctions: what node tags say, who may pass, and what every turn costs.

All that a turn's cost needs is known for its first edge (its nodes' tags, the
node's roads, the restrictions that the edge triggers), so it is joined there;
the pairs of edges then take column arithmetic only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import dims, scalars
from wayfold.operators import tags
from wayfold.operators.routing import checkpointed

#: Places in ``dims.HIGHWAYS``.
TRUNK_LINK, UNCLASSIFIED = 4, 13
U_TURN, REVERSIBLE = 20_000, 1_800_000
RAIL_CROSSINGS = ("crossing", "tram_crossing", "level_crossing", "tram_level_crossing")
RAIL_BARRIERS = ("yes", "full", "half", "double_half", "gate", "chain", "gates")


def node_tags(ptags: Column) -> Column:
    """What parsed tags of a node say: crossings, signs and signals, railways, calming, direction."""

    def value(*parts: str) -> Column:
        return tags.find_value(ptags, parts)

    highway, crossing = value("highway"), value("crossing")
    is_crossing = highway == "crossing"
    signals = value("crossing", "signals")
    markings = value("crossing", "markings")
    rail = value("railway").isin(*RAIL_CROSSINGS)
    said = [F.when(v != "", v) for v in (value("traffic_signals", "direction"), value("traffic_sign", "direction"), value("direction"))]
    return F.struct(
        is_crossing.alias("crossing"),
        (is_crossing & F.when(signals == "yes", True).when(signals == "no", False).otherwise(crossing == "traffic_signals")).alias("crossing_signals"),
        (is_crossing & F.when(markings != "", markings != "no").otherwise(crossing.isin("uncontrolled", "marked", "zebra"))).alias("crossing_markings"),
        F.coalesce(*said).alias("direction"),
        (highway == "turning_circle").alias("turning_circle"),
        (highway == "stop").alias("stop"),
        ((highway == "stop") & (value("stop") == "all")).alias("stop_all"),
        (highway == "give_way").alias("give_way"),
        (highway == "traffic_signals").alias("traffic_signals"),
        rail.alias("railway_crossing"),
        (rail & value("crossing", "barrier").isin(*RAIL_BARRIERS)).alias("railway_barrier"),
        value("public_transport").isin("stop_position", "platform", "station").alias("public_transport"),
        (~value("traffic_calming").isin("", "no")).alias("traffic_calming"),
    )


def barrier(ptags: Column, vehicle: str = "motorcar") -> Column:
    """barrier (its name, ``unknown`` for others, null for none) and access ordinals forward and backward.

    The kind of barrier sets the default, access tags overwrite it; without a
    barrier everything is open, whatever the tags say.
    """
    name = tags.find_value(ptags, ("barrier",))
    there = name != ""
    passes = [b for b, vehicles in dims.BARRIERS.items() if vehicle in vehicles]
    own = tags.access(ptags, F.when(name.isin(*passes), dims.ACCESS.index("yes")).otherwise(0), tags.BICYCLE if vehicle == "bicycle" else tags.CAR)
    full = F.lit(dims.ACCESS.index("yes"))
    return scalars.let(
        own,
        lambda a: F.struct(
            F.when(there, F.when(name.isin(*dims.BARRIERS), name).otherwise("unknown")).alias("barrier"),
            F.when(there, a["forward"]).otherwise(full).alias("forward"),
            F.when(there, a["backward"]).otherwise(full).alias("backward"),
        ),
    )


def node_records(nodes: DataFrame, vehicle: str = "motorcar") -> DataFrame:
    """id and the fields of ``node_tags`` and ``barrier``, of the nodes (id, tags) for which they say anything.

    A direction alone says nothing, and neither does a stop for all ways.
    """
    flags = ("crossing", "turning_circle", "stop", "give_way", "traffic_signals", "railway_crossing", "public_transport", "traffic_calming")
    read = scalars.let(tags.parse_tags(F.col("tags")), lambda p: F.struct(node_tags(p).alias("t"), barrier(p, vehicle).alias("b")))
    said = lambda r: reduce(Column.__or__, [r["t"][flag] for flag in flags], r["b"]["barrier"].isNotNull())
    # explode keeps the condition behind the parsing: a filter would move before it and parse again for each field
    kept = nodes.select("id", F.explode(F.filter(F.array(read), said)).alias("r"))
    return kept.select("id", "r.t.*", "r.b.barrier", F.col("r.b.forward").alias("access_forward"), F.col("r.b.backward").alias("access_backward"))


def _arriving(driven: DataFrame, pieces: int) -> DataFrame:
    """Driven edges at their last node ``n``, with what its other edges say: all edges of a node meet in one of ``pieces`` partitions.

    uniq: its neighbours; best, incoming: its best road and how often that
    arrives; ways_out, free_out: edges on from it; ways_back, free_back: those
    that go back to the edge's first node.
    """
    loop = F.col("from_id") == F.col("to_id")
    rows = lambda end, other, comes: driven.select(*driven.columns, F.col(end).alias("n"), F.col(other).alias("other"), F.lit(comes).alias("comes"), loop.alias("loop"))
    leaving = rows("from_id", "to_id", False)
    # of leaving edges only what is counted goes along
    counted = leaving.select(*[(F.col(c) if c in ("n", "other", "comes", "loop", "highway", "restricted") else F.lit(None).cast(t)).alias(c) for c, t in leaving.dtypes])
    both = rows("to_id", "from_id", True).unionAll(counted).repartition(pieces, "n")
    pair, node = Window.partitionBy("n", "other"), Window.partitionBy("n")
    on = ~F.col("comes") & ~F.col("loop")
    free = on & ~F.col("restricted")
    paired = both.select("*", F.count_if(on).over(pair).alias("ways_back"), F.count_if(free).over(pair).alias("free_back"), F.row_number().over(pair.orderBy("comes")).alias("_nth"))
    near = F.sum(((F.col("_nth") == 1) & ~F.col("loop")).cast("int")).over(node)
    known = paired.select("*", near.alias("uniq"), F.min("highway").over(node).alias("best"), F.count_if(on).over(node).alias("ways_out"), F.count_if(free).over(node).alias("free_out"))
    return known.withColumn("incoming", F.count_if(F.col("comes") & (F.col("highway") == F.col("best"))).over(node)).where("comes").drop("other", "comes", "loop", "_nth")


def turn_costs(edges: DataFrame, records: DataFrame, rules: DataFrame, nodes: DataFrame, pieces: int = 1) -> DataFrame:
    """n0, n1, n2, way_0, way_1, angle, cost_ms (null: no passage), code of every pair of consecutive driven edges.

    ``edges``: from_id, to_id, way_id, highway, distance_cm, restricted, access,
    priority (``high``, ``signals``, ``low`` or null), stop, signal, reversible,
    area; driven edges only.  Their angle ``east`` is found from the nodes if it
    isn't there.  ``records``: of ``node_records``.  ``rules``:
    relation_id, from_id, way_id, via, to_way, to_id, forbidden.  ``nodes``: id,
    lat_e6, lon_e6.

    A forbidden turn has no passage.  A u-turn that no rule allows is open at
    turning circles, on areas, where the node is closed and where the vehicle
    can't go on; never on trunk roads and better.  Else the dearest counts: what
    the node's tags cost, the curve, the crossing, or a reversible way.
    """
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.col("lat_e6").alias(f"{name}_lat"), F.col("lon_e6").alias(f"{name}_lon"))
    driven = edges
    if "east" not in edges.columns:
        placed = edges.join(at("from_id", "p"), "from_id").join(at("to_id", "q"), "to_id")
        east = scalars.angle_to_east(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"), F.col("distance_cm"))
        # they are read several times and made once
        driven = checkpointed(placed.withColumn("east", east).drop("p_lat", "p_lon", "q_lat", "q_lon"))
    tagged = records.select(F.col("id").alias("n"), F.lit(True).alias("tagged"), "turning_circle", "crossing", "railway_crossing", "railway_barrier", "traffic_calming", "barrier", "access_forward", "access_backward")
    before = records.where("railway_barrier").select(F.col("id").alias("from_id"), F.lit(True).alias("rail_before"))
    rule = F.struct("from_id", "way_id", "relation_id", "to_way", "to_id", "forbidden")
    ruled = rules.groupBy(F.col("via").alias("n")).agg(F.collect_set(rule).alias("ruled"))
    # all that is known of a node is put together at the nodes, so that edges are joined with it once
    of_node = checkpointed(tagged.join(ruled, "n", "full"))
    own = F.filter("ruled", lambda r: (r["from_id"] == F.col("from_id")) & (r["way_id"] == F.col("way_id")))
    triggered = F.array_sort(F.transform(own, lambda r: F.struct(*[r[c].alias(c) for c in ("relation_id", "to_way", "to_id", "forbidden")])))
    first = _arriving(driven, pieces).join(of_node, "n", "left").withColumn("rules", F.when(F.col("ruled").isNotNull(), triggered)).drop("ruled").join(before, "from_id", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    least = F.least("access_forward", "access_backward")
    rail = F.when(flag("railway_crossing"), 500 + F.when(flag("railway_barrier") & (~flag("rail_before") | (F.col("distance_cm") > 5_000)), 40_000).otherwise(0)).otherwise(0)
    slow = F.when(flag("traffic_calming") | F.col("barrier").isNotNull(), 1_000).otherwise(0)
    signs = F.when(flag("stop"), 3_000).otherwise(0) + F.when(flag("signal"), 20_000).otherwise(0) + F.when(flag("crossing"), 3_000).otherwise(0)
    alike = (F.col("highway") < UNCLASSIFIED) & (F.col("highway") == F.col("best"))
    crossing = (
        F.when(zero("uniq") < 3, 0)
        .when(F.col("priority").isin("high", "signals"), (F.col("uniq") - 2) * 500)
        .when(F.col("priority") == "low", F.col("uniq") * 2_000)
        .when(alike & (F.col("incoming") <= 1), (F.col("uniq") - 2) * 1_000)
        .when(alike, F.col("incoming") * 1_500)
        .otherwise(F.col("uniq") * 1_500)
    )
    goes_on, goes_free = zero("ways_out") > zero("ways_back"), zero("free_out") > zero("free_back")
    node_ms = F.greatest(signs + rail + slow, crossing).cast("long")
    first = first.withColumn("node_ms", node_ms).withColumn("n_rules", F.coalesce(F.size(F.filter("rules", lambda r: ~r["forbidden"])), F.lit(0)))
    closed = flag("tagged") & (~scalars.routable(F.col("access_forward")) | ~scalars.routable(F.col("access_backward")))
    partly = flag("tagged") & (~scalars.free_access(F.col("access_forward")) | ~scalars.free_access(F.col("access_backward")))
    small, stuck = F.col("highway") > TRUNK_LINK, ~goes_on | (~F.col("restricted") & ~goes_free)
    # pairs are many: what the first edge alone decides is decided here, so that their code stays short enough to be compiled
    e0 = first.select(
        F.col("from_id").alias("n0"),
        F.col("to_id").alias("n1"),
        F.col("way_id").alias("way_0"),
        F.col("east").alias("east_0"),
        F.when(F.size("rules") > 0, F.col("rules")).alias("rules"),
        (F.col("n_rules") > 0).alias("orders"),
        "node_ms",
        scalars.compress_turn_cost(F.col("node_ms")).alias("node_code"),
        # the access that the second way needs: none (null), a certain one, or one that no way has where the node is closed for all
        F.when(closed, -1).when(partly & (F.col("access") != least), least).alias("need"),
        F.col("area").alias("area_0"),
        (flag("turning_circle") | (small & stuck)).alias("turns"),
        small.alias("small"),
        (~F.col("reversible")).alias("steady"),
    )
    e1 = driven.select(F.col("from_id").alias("n1"), F.col("to_id").alias("n2"), F.col("way_id").alias("way_1"), F.col("east").alias("east_1"), F.col("access").alias("access_1"), F.col("reversible").alias("reversible_1"))
    match = lambda r: (r["to_way"] == F.col("way_1")) & (r["to_id"] == F.col("n2"))
    of = lambda *values: F.array(*[F.lit(v) for v in values])
    bends = (0, 500, 2_000, 4_000, 20_000)
    angle = scalars.turn_angle(F.col("east_0"), F.col("east_1"))
    turn = F.abs("angle")
    pairs = (
        e0.join(e1.repartition(pieces, "n1"), "n1")
        .withColumns(
            {
                "u_turn": F.col("n0") == F.col("n2"),
                "same_way": F.col("way_0") == F.col("way_1"),
                "angle": angle,
                "blocked": F.coalesce(F.col("need") != F.col("access_1"), F.lit(False)),
                "exact": F.when(F.col("rules").isNotNull(), F.get(F.filter("rules", match), 0)["forbidden"]),
            }
        )
        .withColumn("bend", F.when(turn <= 20, 0).when(turn <= 60, 1).when(turn <= 120, 2).when(turn <= 179, 3).otherwise(4))
    )
    u_turn, same_way, blocked = F.col("u_turn"), F.col("same_way"), F.col("blocked")
    # without a rule for this very turn, one that orders another turn forbids it; u-turns obey rules for them alone
    forbidden = F.coalesce("exact", ~u_turn & F.col("orders"))
    turns_back = ~F.coalesce("exact", F.lit(True)) | F.col("turns") | (F.col("small") & same_way & (F.col("area_0") | blocked))
    passes = ~forbidden & F.when(u_turn, turns_back).otherwise(~blocked | (F.col("area_0") & same_way))
    changes = ~same_way & F.col("reversible_1") & F.col("steady")
    dearest = F.greatest(F.col("node_ms"), F.get(of(*bends), F.col("bend")).cast("long"), F.when(changes, F.lit(REVERSIBLE).cast("long")))
    # codes rise with costs: that of the dearest is the largest one, and no cost is looked up for a pair
    code = F.greatest(F.col("node_code"), F.get(F.array(*[scalars.turn_code(ms) for ms in bends]), F.col("bend")), F.when(changes, scalars.turn_code(REVERSIBLE)))
    priced = pairs.withColumn("passes", passes).withColumns(
        {
            "cost_ms": F.when(F.col("passes"), F.when(u_turn, F.lit(U_TURN).cast("long")).otherwise(dearest)),
            "code": F.when(~F.col("passes"), F.lit(63)).when(u_turn, scalars.turn_code(U_TURN)).otherwise(code),
        }
    )
    return priced.select("n0", "n1", "n2", "way_0", "way_1", "angle", "cost_ms", "code")
