"""Hourly route health on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ops import health_measures


def stream_route_health(usage: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Tumbling hours per route with the aggregates of the batch form. In append mode an hour is
    emitted once the watermark has passed its end; rows later than that are dropped."""
    hour = F.window("event_time", "1 hour")
    return (usage.withWatermark("event_time", delay).groupBy("route_selected", hour)
            .agg(*health_measures())
            .withColumn("hour_bucket", F.col("window.start")).drop("window"))
