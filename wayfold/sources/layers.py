"""Text sources: routing rules, country lists, polygon files and line layers, from DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def country_list(lines: DataFrame) -> DataFrame:
    """code of each line (``value``) of two capitals; ``#`` starts a comment."""
    code = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(F.regexp_extract(code, "^([A-Z]{2})\\b", 1).alias("code")).where("code <> ''").distinct()


def routing_rules(lines: DataFrame) -> DataFrame:
    """pos, countries, selectors, access, speed_max, speed_limit of rule lines (pos, value).

    A line is ``CC[,CC]:selector[,selector] name=value ...``; later lines win.
    """
    kept = lines.select("pos", F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")

    def setting(name: str):
        found = F.regexp_extract("line", rf"\b{name}=([^\s]+)", 1)
        return F.when(found != "", found)

    return kept.select("pos", F.split(F.substring_index("line", ":", 1), ",").alias("countries"), F.split(F.regexp_extract("line", r"^[^:]*:([^\s]*)", 1), ",").alias("selectors"), setting("access").alias("access"), setting("speed_max").cast("int").alias("speed_max"), setting("speed_limit").cast("int").alias("speed_limit"))


def last_rule(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (country, key) wanted: speed_max and access of the last rule that names it or all."""
    flat = rules.select("pos", F.explode("countries").alias("c"), "selectors", "access", "speed_max").select("pos", "c", F.explode("selectors").alias("s"), "access", "speed_max")
    met = wanted.join(F.broadcast(flat), (F.col("c").isin("ALL") | (F.col("c") == F.col("country"))) & F.col("key").startswith(F.regexp_replace("s", r"\*$", "")), "left")
    by = met.groupBy("country", "key").agg(F.max_by("speed_max", F.when(F.col("speed_max").isNotNull(), F.col("pos"))).alias("speed_max"), F.max_by("access", F.when(F.col("access").isNotNull(), F.col("pos"))).alias("access"))
    return by


def polygon_segments(lines: DataFrame) -> DataFrame:
    """poly, x0, y0, x1, y1 of lines (file, pos, value): ``poly-start`` opens a polygon, ``pt,lat,lon`` adds a point."""
    order = Window.partitionBy("file").orderBy("pos")
    parts = F.split("value", ",")
    marked = lines.withColumn("poly", F.sum(F.when(F.col("value").startswith("poly-start"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    points = marked.where(F.col("value").startswith("pt,")).select("file", "poly", "pos", F.get(parts, 1).cast("double").alias("lat"), F.get(parts, 2).cast("double").alias("lon"))
    e6 = points.select("file", "poly", "pos", F.round(F.col("lat") * 1e6).cast("int").alias("y0"), F.round(F.col("lon") * 1e6).cast("int").alias("x0"))
    own = Window.partitionBy("file", "poly").orderBy("pos")
    return e6.withColumns({"x1": F.lead("x0").over(own), "y1": F.lead("y0").over(own)}).where("x1 IS NOT NULL").select("file", "poly", "x0", "y0", "x1", "y1")
