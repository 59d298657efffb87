"""Joins over time: interval, as-of, window and enrichment joins.

Range conditions are turned into hash joins: time is cut into buckets as wide
as the interval, one side is repeated for the few buckets it can reach, and the
exact condition follows the equi-join on (key, bucket).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import BadRequest
from loomery.sources.staging import staged


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, lower: int, upper: int, how: str = "inner") -> DataFrame:
    """Pairs of one key with ``left + lower <= right <= left + upper``.

    Columns of the two sides must not clash, but for ``key``.  ``how`` may be
    ``inner``, ``left`` (unmatched left rows stay) or ``full``.  A row whose key or
    time is null matches nothing; repeated rows match, or stay, each by itself.
    """
    if lower > upper:
        raise BadRequest("the lower bound is above the upper")
    if how not in ("inner", "left", "full"):
        raise BadRequest(f"{how} is not inner, left or full")
    if how != "inner":  # rows are told apart by numbers, as columns may be null and rows repeated
        left = staged(left.withColumn("_left", F.monotonically_increasing_id()), "interval-left")
    if how == "full":
        right = staged(right.withColumn("_right", F.monotonically_increasing_id()), "interval-right")
    width = max(upper - lower, 1)
    first, last = (F.floor((F.col(left_time) + x) / width).cast("bigint") for x in (lower, upper))
    near = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    far = right.withColumnRenamed(key, "_key").withColumn("_at", F.floor(F.col(right_time) / width).cast("bigint"))
    inside = F.col(right_time).between(F.col(left_time) + lower, F.col(left_time) + upper)
    pairs = near.join(far, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")) & inside).drop("_key", "_bucket", "_at")
    if how == "inner":
        return pairs
    pairs = staged(pairs, "interval-pairs")
    out = pairs.unionByName(left.join(pairs.select("_left").distinct(), "_left", "left_anti"), allowMissingColumns=True)
    if how == "full":
        out = out.unionByName(right.join(pairs.select("_right").distinct(), "_right", "left_anti"), allowMissingColumns=True)
    return out.drop("_left", "_right")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before it.

    Of right rows of one key and time that with the greatest ``values``, compared in
    their order without those that hold maps or variants, counts.  A row whose key or
    time is null matches nothing; left rows stay.
    """
    known = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    reference = known.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    probe = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = reference.unionByName(probe, allowMissingColumns=True)
    ties = [f"_value.{v}" for v in values if not re.search(r"\b(map<|variant\b)", right.select(v).schema[0].dataType.simpleString())]
    order = Window.partitionBy(key).orderBy("_t", "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1")
    return filled.select("_row.*", *[F.col(f"_value.{v}").alias(v) for v in values])


def window_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, size: int) -> DataFrame:
    """All pairs that share a tumbling window."""
    start: Column = (F.floor(F.col(left_time) / size) * size).cast("bigint")
    other: Column = (F.floor(F.col(right_time) / size) * size).cast("bigint")
    return left.withColumn("window_start", start).join(right.withColumn("_start", other), F.col("window_start") == F.col("_start")).drop("_start")


def lookup(left: DataFrame, dimension: DataFrame, key: str, small_rows: int = 1_000_000) -> DataFrame:
    """Enrich by a dimension that is unique on ``key``; broadcast only if it has at most ``small_rows`` rows."""
    small = dimension.limit(small_rows + 1).count() <= small_rows
    return left.join(F.broadcast(dimension) if small else dimension, key, "left")
