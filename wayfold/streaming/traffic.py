"""Extension: event streams over the road graph (the batch engine has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """start, key, n and the sum of ``value``: late rows beyond the watermark are left out."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def route_requests(requests: DataFrame, answer, sink):
    """A query that answers each micro-batch of requests once, repeated ones together."""

    def batch(rows: DataFrame, number: int) -> None:
        asked = rows.dropDuplicates(["source", "target"])
        sink(rows.join(answer(asked), ["source", "target"], "left"), number)

    return requests.writeStream.foreachBatch(batch)
