"""Positions in a total order without gathering the order in one task.

A window without a partition (or over a few large groups) sorts everything in
one task.  Here rows are range-partitioned by the order, numbered inside their
partition, and shifted by the counts of the partitions before: one row a
partition and group is all that is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.staging import staged


def number_rows(rows: DataFrame, order: list[str | Column], out: str = "place", group: str | None = None) -> DataFrame:
    """``rows`` with gapless positions from 0 by ``order`` (within ``group``, if given).

    The input is staged first, so that ties and retried tasks keep their
    numbers; rows that tie take them in the order they were staged.
    """
    key = [F.col(group)] if group else [F.lit(0)]
    base = staged(rows.withColumn("_group", key[0]).withColumn("_row", F.monotonically_increasing_id()), "number-rows")
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [F.col("_group"), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_row")]
    placed = staged(base.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "number-placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a group and partition: bounded by the number of partitions, not of rows.
    starts = runs.select("_group", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = placed["_group"].eqNullSafe(starts["_group"]) & (placed["_part"] == starts["_part"])
    joined = placed.join(F.broadcast(starts), same)
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias(out))
