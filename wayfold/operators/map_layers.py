"""Map layers and look-ups on graphs: lines as text, tiles, neighbours of clusters, edges by their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.road_graph import dense_index

# Colors of clusters, by color number.
CLUSTER_COLORS = (
    "blue", "dgreen", "orange", "yel", "brown", "violet", "lblue", "dred", "green", "red", "grey", "gblue", "lgreen", "greenbl",
    "lbrown", "pink", "olive",
)
BETWEEN = "dpink"


def line_text(color: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """A line of a layer file, with degrees of six places."""
    return F.format_string("line,%s,%.6f,%.6f,%.6f,%.6f", color, *[c / F.lit(1e6) for c in (a_lat, a_lon, b_lat, b_lon)])


def labelled_lines(edges: DataFrame, label: str | None, strange: bool, color: str) -> DataFrame:
    """Lines of the driven edges with a label (None: any) that are strange or not.

    ``edges``: label, strange, a_lat, a_lon, b_lat, b_lon.
    """
    kept = edges.where(F.col("strange") == strange)
    kept = kept if label is None else kept.where(F.col("label") == label)
    return kept.select(line_text(F.lit(color), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("line"))


def cluster_lines(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of links (a, b), each pair of different nodes once: in the cluster's color within one, else between clusters.

    ``nodes``: id, lat_e6, lon_e6, cluster (null: of none), color.  Links of nodes without a cluster are left out.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = nodes.where("cluster IS NOT NULL")
    end = lambda n: own.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("lat_e6", "lon_e6", "cluster", "color")])
    met = pairs.join(end("a"), "a").join(end("b"), "b")
    names = F.array(*[F.lit(c) for c in CLUSTER_COLORS])
    color = F.when(F.col("a_cluster") == F.col("b_cluster"), F.get(names, (F.col("a_color") % len(CLUSTER_COLORS)).cast("int"))).otherwise(BETWEEN)
    return met.select(line_text(color, F.col("a_lat_e6"), F.col("a_lon_e6"), F.col("b_lat_e6"), F.col("b_lon_e6")).alias("line"))


# Colors of traffic, from the least to the most.
TRAFFIC_COLORS = ("red25", "red50", "red75", "red")
#: The unit of the colors is the largest traffic over this.
TRAFFIC_PARTS = 10_000


def traffic_lines(traffic: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, line (its color by powers of ten of the unit), record (way, ends, visits, dead end) of driven edges.

    ``traffic``: from_id, to_id, way_id, visits; ``nodes``: id, lat_e6, lon_e6, dead_end.
    """
    most = traffic.agg(F.max("visits").alias("most"))
    end = lambda n: nodes.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("lat_e6", "lon_e6", "dead_end")])
    met = traffic.where("visits > 0").join(end("from_id"), "from_id").join(end("to_id"), "to_id").join(F.broadcast(most))
    unit = F.greatest(F.lit(1), F.ceil(F.col("most") / TRAFFIC_PARTS))
    share = F.floor(F.col("visits") / unit)
    color = F.when(share < 1, TRAFFIC_COLORS[0]).when(share < 10, TRAFFIC_COLORS[1]).when(share < 100, TRAFFIC_COLORS[2]).otherwise(TRAFFIC_COLORS[3])
    ends = [F.col(f"{n}_{c}") for n in ("from_id", "to_id") for c in ("lat_e6", "lon_e6")]
    dead = (F.col("from_id_dead_end") | F.col("to_id_dead_end")).cast("int")
    record = F.format_string("%d,%.6f,%.6f,%.6f,%.6f,%d,%d", "way_id", *[c / F.lit(1e6) for c in ends], "visits", dead)
    return met.select("from_id", "to_id", line_text(color, *ends).alias("line"), record.alias("record"))


def seen_in_tiles(rects: DataFrame, tiles: DataFrame, step: int) -> DataFrame:
    """cluster, tile of the rectangles that touch a tile's view.

    ``rects``: cluster, low_lat, high_lat, low_lon, high_lon; ``tiles``: tile and the same.  Both meet
    on a grid of ``step`` microdegrees, so that a rectangle looks only at tiles near it.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    spread = lambda f: f.select("*", F.explode(cells("low_lat", "high_lat")).alias("y")).select("*", F.explode(cells("low_lon", "high_lon")).alias("x"))
    other = spread(tiles).select("tile", "y", "x", *[F.col(c).alias(f"t_{c}") for c in ("low_lat", "high_lat", "low_lon", "high_lon")])
    apart = (F.col("low_lat") > F.col("t_high_lat")) | (F.col("high_lat") < F.col("t_low_lat")) | (F.col("low_lon") > F.col("t_high_lon")) | (F.col("high_lon") < F.col("t_low_lon"))
    return spread(rects).join(other, ["y", "x"]).where(~apart).select("cluster", "tile").distinct()


def border_twins(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """from_id, to_id, way_id, out_cluster, in_cluster, out_pos, in_pos of driven edges between clusters.

    Such an edge leaves one cluster and enters the other; positions count each
    cluster's leaving and entering edges in the order of (from, to, way).
    """
    own = clusters.select(F.col("node").alias("from_id"), F.col("cluster").alias("out_cluster"))
    other = clusters.select(F.col("node").alias("to_id"), F.col("cluster").alias("in_cluster"))
    crossing = edges.select("from_id", "to_id", "way_id").join(own, "from_id").join(other, "to_id").where("out_cluster <> in_cluster")
    for cluster, name in (("out_cluster", "out_pos"), ("in_cluster", "in_pos")):
        crossing = dense_index(crossing, "from_id", name, ties=("to_id", "way_id"), within=(cluster,))
    return crossing.select("from_id", "to_id", "way_id", "out_cluster", "in_cluster", *[F.col(c).cast("int").alias(c) for c in ("out_pos", "in_pos")])


def found_edges(edges: DataFrame, wanted: DataFrame, pieces: int = 1) -> DataFrame:
    """from_id, to_id, way_id, n (edges between them, either way), off (of the first driven one; null without).

    ``edges``: from_id, to_id, way_id, inverted; ``wanted``: from_id, to_id, way_id.
    Both meet at their first node, in ``pieces`` partitions: edges get their
    offsets there and are looked up there, with one exchange.
    """
    keys = ["from_id", "to_id", "way_id"]
    both = edges.select(*keys, "inverted", F.lit(False).alias("asked")).unionAll(wanted.select(*keys, F.lit(None).cast("boolean"), F.lit(True)))
    # what is asked for comes behind all edges of its node and leaves their offsets alone
    order = Window.partitionBy("from_id").orderBy("asked", "inverted", "to_id", "way_id")
    placed = both.repartition(pieces, "from_id").withColumn("off", F.row_number().over(order) - 1)
    by = placed.groupBy(*keys).agg(F.count_if(~F.col("asked")).alias("n"), F.min(F.when(~F.col("asked") & ~F.col("inverted"), F.col("off"))).alias("off"), F.max("asked").alias("asked"))
    return by.where("asked").select(*keys, "n", "off")


def countries_of_relations(relations: DataFrame) -> DataFrame:
    """id, name, iso, driving_side of the relations (id, tags as a map) that are a country's boundary."""
    t = lambda *keys: F.coalesce(*[F.when(F.try_element_at("tags", F.lit(k)) != "", F.try_element_at("tags", F.lit(k))) for k in keys], F.lit(""))
    level = F.try_element_at("tags", F.lit("admin_level")).try_cast("int")
    named = relations.select("id", level.alias("level"), t("type").alias("type"), t("boundary").alias("boundary"), t("name:de", "name:en").alias("name"), t("ISO3166-1:alpha2", "ISO3166-1", "country_code").alias("iso"), t("driving_side").alias("driving_side"))
    kept = named.where((F.col("level") == 2) & (F.col("type") == "boundary") & (F.col("boundary") == "administrative") & (F.col("iso") != ""))
    return kept.select("id", "name", "iso", "driving_side")
