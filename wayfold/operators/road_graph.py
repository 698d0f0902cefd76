"""Road-graph construction: nodes, directed edges and their order.

Links are rows (a, b, way_id, ...).  Edges are keyed by (from_id, off); nodes
are numbered by the rank of their id.  Ranks over all rows come from a range
sort and counts of earlier partitions, never from one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import dims, scalars
from wayfold.operators.routing import checkpointed


def dense_index(frame: DataFrame, key: str, name: str = "idx", ties: tuple[str, ...] = (), within: tuple[str, ...] = (), width: int = 1024) -> DataFrame:
    """``frame`` with the 0-based rank of its whole-number ``key``, without a one-task sort.

    Rows with the same key are ordered by ``ties``; ranks count all rows, or
    those with the same ``within``.  Rows are counted in buckets of ``width``
    keys; a row's rank is the sum of the buckets before its own and its place
    within its own.
    """
    bucket = F.floor(F.col(key) / F.lit(width)).cast("long")
    placed = frame.withColumn("_bucket", bucket)
    sizes = placed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    coarse = sizes.withColumn("_block", F.floor(F.col("_bucket") / F.lit(1024)).cast("long"))
    blocks = coarse.groupBy(*within, "_block").agg(F.sum("_n").alias("_bn"))
    # a block stands for 1024 buckets, so this window has one row for a million nodes
    starts = blocks.select(*within, "_block", (F.sum("_bn").over(Window.partitionBy(*within).orderBy("_block")) - F.col("_bn")).alias("_bs"))
    inside = F.sum("_n").over(Window.partitionBy(*within, "_block").orderBy("_bucket")) - F.col("_n")
    offsets = coarse.withColumn("_in", inside).join(starts, [*within, "_block"]).select(*within, "_bucket", (F.col("_bs") + F.col("_in")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(key, *ties)) - 1
    return placed.withColumn("_place", place).join(offsets, [*within, "_bucket"]).select(*frame.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def located(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the coordinates of both ends and their length in cm."""
    left = nodes.select(F.col("id").alias("a"), F.col("lat_e6").alias("a_lat"), F.col("lon_e6").alias("a_lon"))
    right = nodes.select(F.col("id").alias("b"), F.col("lat_e6").alias("b_lat"), F.col("lon_e6").alias("b_lon"))
    joined = links.join(left, "a").join(right, "b")
    return joined.withColumn("distance_cm", scalars.haversine_cm(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))


def edges(links: DataFrame) -> DataFrame:
    """from_id, to_id, way_id, inverted, both_directions, contra_way, and all columns of the link.

    A two-way link gives an edge at each end; a one-way link an edge and its
    inverted twin at the other end, which isn't driven but known.
    """
    other = [c for c in links.columns if c not in ("a", "b")]
    forward = F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit(False).alias("inverted"), F.lit(False).alias("contra_way"))
    back = F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id"), F.col("oneway").alias("inverted"), (~F.col("oneway")).alias("contra_way"))
    return links.select(*other, F.explode(F.array(forward, back)).alias("e")).select("e.*", (~F.col("oneway")).alias("both_directions"), *other)


def ordered_edges(edge_rows: DataFrame) -> DataFrame:
    """Edges with their offset at their node and the unique-target flag."""
    order = Window.partitionBy("from_id").orderBy("inverted", "to_id", "way_id")
    first = Window.partitionBy("from_id", "to_id").orderBy("inverted", "way_id")
    return edge_rows.withColumn("off", F.row_number().over(order) - 1).withColumn("unique_target", (F.row_number().over(first) == 1) & (F.col("from_id") != F.col("to_id")))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """node, forward, inverted, uniq: edges at each node and its distinct neighbours."""
    return edge_rows.groupBy(F.col("from_id").alias("node")).agg(
        F.count_if(~F.col("inverted")).alias("forward"), F.count_if("inverted").alias("inverted"), F.count_distinct("to_id").alias("uniq")
    )


def edge_pairs(edge_rows: DataFrame) -> DataFrame:
    """Consecutive driven edges: the second begins where the first ends."""
    driven = edge_rows.where(~F.col("inverted"))
    first = driven.select(F.col("from_id").alias("n0"), F.col("to_id").alias("n1"), F.col("way_id").alias("way_1"), F.col("maxspeed").alias("speed_1"))
    second = driven.select(F.col("from_id").alias("n1"), F.col("to_id").alias("n2"), F.col("way_id").alias("way_2"))
    return first.join(second, "n1")


def way_positions(ways: DataFrame) -> DataFrame:
    """Ways (way_id, pos, ref) with the next ref, the length to it and the sum from the start."""
    lat, lon = "lat_e6", "lon_e6"
    order = Window.partitionBy("way_id").orderBy("pos")
    ahead = ways.withColumns({"next_ref": F.lead("ref").over(order), "next_lat": F.lead(lat).over(order), "next_lon": F.lead(lon).over(order)})
    step = F.coalesce(scalars.haversine_cm(F.col(lat), F.col(lon), F.col("next_lat"), F.col("next_lon")), F.lit(0).cast("long"))
    return ahead.withColumn("step_cm", step).withColumn("before_cm", F.sum("step_cm").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step_cm"))


def needed_nodes(ways: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """id of graph nodes: ends of ways, nodes of two ways or seen twice, all nodes of loops, tagged ones."""
    order = Window.partitionBy("way_id")
    spans = ways.withColumns({"_first": F.min("pos").over(order), "_last": F.max("pos").over(order)})
    ends = spans.where((F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))).select(F.col("ref").alias("id"))
    shared = ways.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("ref").alias("id"))
    twice = ways.groupBy("way_id", "ref").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).where("lo < hi").select("way_id", "lo", "hi")
    loops = ways.join(twice, "way_id").where(F.col("pos").between(F.col("lo"), F.col("hi"))).select(F.col("ref").alias("id"))
    found = ends.unionAll(shared).unionAll(loops)
    return (found if tagged is None else found.unionAll(tagged.select("id"))).distinct()


def way_edges(positions: DataFrame, needed: DataFrame) -> DataFrame:
    """way_id, from_id, to_id, distance_cm between consecutive needed nodes of ways."""
    kept = positions.join(needed.select(F.col("id").alias("ref")), "ref", "left_semi")
    order = Window.partitionBy("way_id").orderBy("pos")
    ahead = kept.select("way_id", "pos", F.col("ref").alias("from_id"), F.lead("ref").over(order).alias("to_id"), (F.lead("before_cm").over(order) - F.col("before_cm")).alias("distance_cm"))
    return ahead.where(F.col("to_id").isNotNull())


def country_changes(ways: DataFrame) -> DataFrame:
    """way_id, pos, ncc, after: nodes of ways (way_id, pos, ncc) whose next node lies in another country."""
    ahead = ways.select("way_id", "pos", "ncc", F.lead("ncc").over(Window.partitionBy("way_id").orderBy("pos")).alias("after"))
    return ahead.where("after <> ncc")


def rejected_ways(ways: DataFrame, roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, n (nodes), uniq (nodes that differ from the one before), reason: why a way is left out; null if it is kept.

    ``ways``: way_id, pos, ref; ``roads``: way_id, highway; ``nodes``: the ids that are there.
    """
    order = Window.partitionBy("way_id").orderBy("pos")
    there = nodes.select(F.col("id").alias("ref"), F.lit(True).alias("there"))
    seen = ways.withColumn("before", F.lag("ref").over(order)).join(there, "ref", "left")
    by = seen.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before").isNull() | (F.col("ref") != F.col("before"))).alias("uniq"), F.max(F.col("there").isNull()).alias("lacking"))
    road = roads.select("way_id", F.col("highway").isin(*dims.ROADS).alias("road"))
    reason = (
        F.when(F.col("n") <= 1, "one node").when(~F.coalesce("road", F.lit(False)), "no road").when(F.col("lacking"), "missing node").when(F.col("uniq") <= 1, "no length")
    )
    return by.join(road, "way_id", "left").select("way_id", "n", "uniq", reason.alias("reason"))


def _counters(frame: DataFrame, **columns) -> DataFrame:
    """counter, value: one row for each aggregate."""
    names = list(columns)
    one = frame.agg(*[c.cast("long").alias(f"c{n}") for n, c in enumerate(columns.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name.replace("_", " ")).alias("counter"), F.col(f"c{n}").alias("value")) for n, name in enumerate(names)])).alias("r")).select("r.*")


def build_statistics(ways: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """counter, value: what a graph build counts, each part in one pass with partial sums."""
    count, cm, speed = F.count(F.lit(1)), F.col("distance_cm"), F.col("maxspeed")
    of_edges = _counters(
        edge_rows, edges=count, edges_inverted=F.count_if("inverted"), edges_both_directions=F.count_if("both_directions"), edges_contra_way=F.count_if("contra_way"), edges_restricted=F.count_if("restricted"),
        edges_self=F.count_if(F.col("from_id") == F.col("to_id")), edges_important=F.count_if(F.col("highway") <= 4), cm_sum=F.sum(cm), cm_max=F.max(cm), cm_min=F.min(cm), speed_max=F.max(speed), speed_min=F.min(speed),
    )
    pairs = edge_rows.where("from_id <> to_id").select("from_id", "to_id").distinct()
    at = edge_rows.groupBy("from_id").agg(count.alias("n"), F.count_if(~F.col("inverted")).alias("f"))
    of_nodes = _counters(at, nodes=count, node_edges_max=F.max("n"), node_edges_min=F.min("n"), nodes_one_edge=F.count_if(F.col("n") == 1), nodes_no_way_out=F.count_if(F.col("f") == 0))
    by = ways.groupBy("way_id").agg(count.alias("n"))
    of_ways = _counters(by, ways=count, way_nodes=F.sum("n"), way_nodes_max=F.max("n"), way_nodes_min=F.min("n"), ways_one_node=F.count_if(F.col("n") == 1))
    return of_edges.unionAll(_counters(pairs, edges_unique_target=count)).unionAll(of_nodes).unionAll(of_ways)


def _both_ways(edge_rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Edges keyed by (lo, hi, way_id), the same for both directions, and whether one leaves from lo or from hi; a loop does both."""
    keyed = edge_rows.withColumns({"lo": F.least("from_id", "to_id"), "hi": F.greatest("from_id", "to_id")})
    return keyed, F.col("from_id") == F.col("lo"), F.col("from_id") == F.col("hi")


def one_sided(edge_rows: DataFrame) -> DataFrame:
    """different: edges (from_id, to_id, way_id) that the turned graph has fewer times, and turned ones that the graph has fewer times."""
    keyed, there, back = _both_ways(edge_rows.select("from_id", "to_id", "way_id"))
    # the two edges of a link are made side by side: they are added up before they are exchanged
    by = keyed.groupBy("lo", "hi", "way_id").agg((F.count_if(there) - F.count_if(back)).alias("more")).where("more <> 0")
    return by.agg(F.coalesce(F.sum(F.abs("more") * 2), F.lit(0)).cast("long").alias("different"))


def validation(edge_rows: DataFrame, nodes: DataFrame, pieces: int = 1) -> DataFrame:
    """invariant, broken: rows that break each invariant of edges, once they are ordered in ``pieces`` partitions.

    What edges must find in their other direction is counted for both at once.
    """
    ordered = ordered_edges(edge_rows.select("from_id", "to_id", "way_id", "inverted").repartition(pieces, "from_id"))
    at = Window.partitionBy("from_id").orderBy("off")
    key = F.struct("inverted", "to_id", "way_id")
    unordered = ordered.select((key < F.lag(key).over(at)).alias("bad")).where("bad")
    keyed, there, back = _both_ways(edge_rows)
    counts = {}
    for side, leaves in (("there", there), ("back", back)):
        for kind, holds in (("inverted", F.col("inverted")), ("driven", ~F.col("inverted")), ("two_way", F.col("both_directions"))):
            counts[f"{side}_{kind}"] = F.count_if(leaves & holds)
    by = keyed.groupBy("lo", "hi", "way_id").agg(*[count.alias(name) for name, count in counts.items()])
    c, zero = F.col, F.lit(0)
    # a loop leaves from both ends: it is its own twin, and is counted once
    both = lambda of: of("there", "back") + F.when(F.col("lo") == F.col("hi"), zero).otherwise(of("back", "there"))
    twice = both(lambda own, other: (c(f"{own}_inverted") > 1).cast("int") + (c(f"{own}_driven") > 1).cast("int"))
    lone = both(lambda own, other: F.when(c(f"{other}_driven") == 0, c(f"{own}_inverted")).otherwise(zero))
    one_way = both(lambda own, other: F.when(c(f"{other}_driven") + c(f"{other}_inverted") == 0, c(f"{own}_two_way")).otherwise(zero))
    total = lambda column: F.coalesce(F.sum(column), zero).cast("long")
    of_pairs = {"no edge twice": twice, "inverted edges have a driven twin": lone, "two-way edges come back": one_way}
    sums = by.agg(*[total(column).alias(f"c{n}") for n, column in enumerate(of_pairs.values())])
    pairs = sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("invariant"), F.col(f"c{n}").alias("broken")) for n, name in enumerate(of_pairs)])).alias("r")).select("r.*")
    lost = edge_rows.groupBy("to_id").agg(F.count(F.lit(1)).alias("n")).join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    indexed = dense_index(nodes.select("id"), "id")
    bucket = Window.partitionBy(F.floor(F.col("idx") / 1024)).orderBy("idx")
    disordered = indexed.select((F.col("id") <= F.lag("id").over(bucket)).alias("bad")).where("bad")
    one = lambda name, frame, count: frame.agg(count.alias("broken")).select(F.lit(name).alias("invariant"), "broken")
    rows = F.count(F.lit(1))
    return reduce(DataFrame.unionAll, [one("edges in order", unordered, rows), pairs, one("targets are nodes", lost, total("n")), one("nodes in order", disordered, rows)])


def disk_usage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """col, n, least, most, mean, bits, bytes: what bit-packed columns of whole numbers take."""
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("long").alias("v")) for c in columns])).alias("x")).select("x.*")
    by = long.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"))
    bits = F.length(F.bin("most"))
    return by.select("col", "n", "least", "most", scalars.whole_div(F.col("total"), F.col("n")).alias("mean"), bits.cast("int").alias("bits"), F.floor((F.col("n") * bits + 7) / 8).alias("bytes"))


def route_answers(found: DataFrame, requests: DataFrame, steps: DataFrame, weighted: DataFrame, nodes: DataFrame) -> DataFrame:
    """req_id, json: ``Ok`` with route, leg, steps, manoeuvres and way points, or ``NoRoute``.

    ``found``: req_id, metric (milliseconds), path; ``steps``: from_id, to_id, distance_cm, name.
    """
    found = checkpointed(found)
    legs = found.where(F.size("path") > 1).select("req_id", F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda n, i: F.struct(n.alias("from_id"), F.get("path", i + 1).alias("to_id"), (i == F.size("path") - 2).alias("last")))).alias("pos", "s")).select("req_id", "pos", "s.*")
    # paths are few next to the edges, and only theirs are looked at
    legs = checkpointed(legs)
    driven = legs.select("from_id", "to_id").distinct()
    steps, weighted = steps.join(driven, ["from_id", "to_id"], "left_semi"), weighted.join(driven, ["from_id", "to_id"], "left_semi")
    once = steps.groupBy("from_id", "to_id").agg(F.min(F.struct("distance_cm", "name")).alias("w"))
    quick = weighted.groupBy("from_id", "to_id").agg(F.min("weight").alias("ms"))
    priced = legs.join(once, ["from_id", "to_id"]).join(quick, ["from_id", "to_id"])
    at = nodes.select(F.col("id"), F.array(F.col("lon_e6") / 1e6, F.col("lat_e6") / 1e6).alias("location"))
    placed = priced.join(at.withColumnRenamed("id", "from_id"), "from_id")
    kind = F.when(F.col("pos") == 0, "depart").when(F.col("last"), "arrive").otherwise("turn")
    step = F.struct(F.round(F.col("w.distance_cm") / 100, 1).alias("distance"), F.round(F.col("ms") / 1000, 1).alias("duration"), F.col("w.name").alias("name"), F.struct(kind.alias("type"), "location").alias("maneuver"))
    leg = placed.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", step.alias("step")))).alias("steps"), F.sum("w.distance_cm").alias("cm"))
    ends = requests.join(at.select(F.col("id").alias("source"), F.col("location").alias("first")), "source", "left").join(at.select(F.col("id").alias("target"), F.col("location").alias("second")), "target", "left")
    whole = found.join(leg, "req_id", "left").join(ends, "req_id")
    route = F.struct(
        F.round(F.coalesce("cm", F.lit(0)) / 100, 1).alias("distance"),
        F.round(F.col("metric") / 1000, 1).alias("duration"),
        F.array(F.struct(F.coalesce(F.transform("steps", lambda s: s["step"]), F.array()).alias("steps"))).alias("legs"),
    )
    points = F.array(F.struct(F.col("first").alias("location")), F.struct(F.col("second").alias("location")))
    good = F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(route).alias("routes"), points.alias("waypoints")))
    bad = F.to_json(F.struct(F.lit("NoRoute").alias("code"), F.lit("no route between the points").alias("message")))
    return whole.select("req_id", F.when(F.col("metric").isNotNull(), good).otherwise(bad).alias("json"))


def deduped(values: DataFrame, col: str) -> DataFrame:
    """value, n, place: a dictionary by popularity, ties by the least first place (``pos``)."""
    counted = values.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.select("value", "n", (F.row_number().over(Window.orderBy(F.col("n").desc(), "first")) - 1).alias("place"))


def best_highway(edge_rows: DataFrame, pieces: int = 1) -> DataFrame:
    """node, best: the most important road class, with its edges in and out; ends meet in ``pieces`` partitions."""
    at = edge_rows.where(~F.col("inverted"))
    both = at.select(F.col("from_id").alias("node"), "highway", F.lit(1).alias("out")).unionAll(at.select(F.col("to_id").alias("node"), "highway", F.lit(0).alias("out")))
    by = both.repartition(pieces, "node").groupBy("node", "highway").agg(F.sum("out").alias("n_out"), F.count_if(F.col("out") == 0).alias("n_in"))
    return by.groupBy("node").agg(F.min(F.struct("highway", "n_out", "n_in")).alias("m")).select("node", F.col("m.highway").alias("best"), F.col("m.n_out").alias("n_out"), F.col("m.n_in").alias("n_in"))
