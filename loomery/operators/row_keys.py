"""A name for every row, also where ids are missing or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.ranking import number_rows
from loomery.sources.staging import staged


def free_name(rows: DataFrame, wish: str = "row_key") -> str:
    """A column name that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    while wish in taken:
        wish += "_"
    return wish


def keyed(rows: DataFrame, id_col: str, name: str, nulls_first: bool = False) -> DataFrame:
    """``rows`` with a unique long ``name`` that orders rows as ``id_col`` does.

    Where ids are present and distinct, which a count by id tells, the key is
    the id and nothing is moved.  Else rows are numbered in the order of their
    ids (rows that tie keep the order they were written in) and written once, so
    that the numbers are the same each time the frame is read.
    """
    column = F.col(id_col)
    if not rows.groupBy(column.alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).collect():
        return rows.withColumn(name, column.cast("long"))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), column.alias("id"))
    order = F.col("id").asc_nulls_first() if nulls_first else F.col("id").asc_nulls_last()
    return staged(number_rows(packed, [order], name).select("row.*", name), "row-keys")
