"""Structured Streaming forms of the event-time operators.

Each takes a streaming frame and returns one; :func:`drain` runs it over what
a file source holds now.  State is Spark's own: watermarks bound it, the
checkpoint makes it exactly-once, and ``foreachBatch`` sinks are keyed by batch
so that a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "seq long, k long, ts timestamp, kind string, v long"


def read_events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A file stream of Parquet events, ``per_batch`` files at a time, oldest first."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed_totals(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Tumbling counts and totals per key; a window is emitted once the watermark passes its end."""
    w = F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy("k", w).agg(F.count("*").alias("n"), F.sum("v").alias("total")).select("k", F.col("window.start").alias("window_start"), "n", "total")


def sliding_totals(events: DataFrame, window: str, slide: str, delay: str) -> DataFrame:
    """Sliding totals; no window starts before the epoch."""
    w = F.window("ts", window, slide)
    out = events.withWatermark("ts", delay).groupBy("kind", w).agg(F.count("*").alias("n")).select("kind", F.col("window.start").alias("window_start"), "n")
    return out.filter(F.col("window_start") >= F.timestamp_seconds(F.lit(0)))


def session_totals(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions per key; a late event may merge two of them until the watermark closes both."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy("k", s).agg(F.count("*").alias("n")).select("k", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each identity; identities are forgotten some time after the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def matched(left: DataFrame, right: DataFrame, tolerance: str, delay: str) -> DataFrame:
    """Full outer interval join on ``k``: pairs within the tolerance, and what stays unmatched."""
    a = left.withWatermark("ts", delay).select(F.col("k").alias("lk"), F.col("seq").alias("l_seq"), F.col("ts").alias("l_ts"))
    b = right.withWatermark("ts", delay).select(F.col("k").alias("rk"), F.col("seq").alias("r_seq"), F.col("ts").alias("r_ts"))
    near = F.expr(f"lk = rk AND r_ts BETWEEN l_ts - INTERVAL {tolerance} AND l_ts + INTERVAL {tolerance}")
    return a.join(b, near, "full_outer")


def pattern_matches(events: DataFrame, stages: tuple[str, ...], within_s: int, delay: str = "0 seconds") -> DataFrame:
    """Ordered stages per key within a time span; one partial match is kept for each key.

    A key's state is the rows the watermark has not passed and the match under way.  Rows are taken in
    event-time order once the watermark is past them, whichever batch brought them; rows later than the watermark
    are dropped.  A match that can no longer be completed is forgotten with its key when its time is up.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, start, held = state.get if state.exists else (-1, 0.0, [])
        mark = state.getCurrentWatermarkMs() / 1000
        rows = [tuple(r) for r in held]
        if not state.hasTimedOut:
            for part in batches:
                rows += [(ts.timestamp(), int(seq), kind) for ts, seq, kind in zip(part["ts"], part["seq"], part["kind"], strict=True) if ts.timestamp() >= mark]
        rows.sort()
        found, waiting = [], []
        for now, seq, kind in rows:
            if now >= mark + 0.001:  # the watermark's own millisecond has passed
                waiting.append((now, seq, kind))
                continue
            if at >= 0 and now - start > within_s:
                at = -1
            if kind == stages[0]:
                at, start = 0, now
            elif at >= 0 and kind == stages[at + 1]:
                at += 1
            if at == len(stages) - 1:
                found.append((key[0], seq, int(now - start)))
                at = -1
        if at >= 0 and start + within_s < mark:
            at = -1
        if at < 0 and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((at, start, waiting))
            due = waiting[0][0] if waiting else start + within_s
            state.setTimeoutTimestamp(max(int(due * 1000) - 1, int(mark * 1000) + 1))
        yield pd.DataFrame(found, columns=["k", "seq", "took"])

    held = "at int, start double, held array<struct<ts: double, seq: long, kind: string>>"
    return events.withWatermark("ts", delay).groupBy("k").applyInPandasWithState(step, "k long, seq long, took long", held, "append", GroupStateTimeout.EventTimeTimeout)


def write_once(path: str):
    """A ``foreachBatch`` function that writes each batch to a folder of its own: a replay overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    return write


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run over everything available and stop; a second call goes on where the first ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write_once(out)).start()
    query.awaitTermination()
