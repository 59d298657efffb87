"""Event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-hour sums per event type of events with a positive value."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600
    return ev.groupBy(F.col("event_type").alias("key"), start.cast("bigint").alias("window_start")).agg(
        F.count("*").alias("n"), F.sum(F.floor("value").cast("bigint")).alias("total")
    )


QUERIES = {"windowed_sum": windowed_sum}
ORACLES = {
    "windowed_sum": """
        SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start,
               count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total
        FROM events WHERE value > 0 GROUP BY 1, 2"""
}
