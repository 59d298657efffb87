"""Streaming operators run over the events table as a file stream; a batch SQL statement gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import machines
from loomery.sources.staging import new_path
from loomery.streaming import pipelines as p
from loomery.suites.machines import DUCK_EVENTS


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    there = spark.read.parquet(path)
    source = spark.readStream.schema(there.schema)
    if any(f.endswith("/events.parquet") for f in there.inputFiles()):  # one file: a file source takes its folder
        rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        rows = source.parquet(path)
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("v"))


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out = new_path(spark, "stream-out")
    p.drain(stream, out, new_path(spark, "stream-check"), mode)
    done = spark.read.parquet(out)
    if mode == "complete":
        done = done.filter(F.col("batch") == done.agg(F.max("batch")).first()[0])
    return done.drop("batch")


def stream_windowed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, p.windowed_totals(_stream(spark, sf_dir), "6 hours", "1 hour"), "complete")
    return out.select("k", F.unix_seconds("window_start").alias("window_start"), "n", "total")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir)
    return _run(spark, p.deduplicated(rows.unionByName(rows), ["seq"], "1 hour")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def stream_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.pattern_matches(_stream(spark, sf_dir), ("view", "click", "purchase"), 172800)
    return _run(spark, found).groupBy("k").agg(F.count("*").alias("matches"))


QUERIES = {f.__name__: f for f in (stream_windowed_totals, stream_dedupe, stream_patterns)}
_EV = f"WITH ev AS ({DUCK_EVENTS}) "
ORACLES = {
    "stream_windowed_totals": _EV + "SELECT k, CAST(t // 21600 * 21600 AS BIGINT) AS window_start, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ev GROUP BY 1, 2",
    "stream_dedupe": _EV + "SELECT kind, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ev GROUP BY 1",
    "stream_patterns": "SELECT k, matches FROM (" + machines.sequence_pattern(("view", "click", "purchase"), 172800).duck_sql(DUCK_EVENTS, ["k"], ["seq"], ["t", "kind"]) + ") WHERE matches > 0",
}
