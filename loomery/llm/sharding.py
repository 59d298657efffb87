"""Jump consistent sharding, in DataFrame expressions only.

A row's shard depends on its key and the number of shards alone; with one shard more, only
the rows that the new shard receives move.  Slots number each shard's rows
from 0 without gaps, in key order.  A window over a shard would gather it in
one task, so rows are range-partitioned by (shard, key, row) instead, numbered
inside their partition, and shifted by the counts of the partitions before.

Defined results: a null key goes to shard 0 (also when grown); a null text has
no bytes; repeated keys share a shard and take slots of their own; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.hashing import jump_hash
from loomery.operators.ranking import number_rows


def assign_shards(rows: DataFrame, key_col: str, shards: int, out: str = "shard") -> DataFrame:
    """``rows`` with the shard of each key."""
    return rows.withColumn(out, F.coalesce(jump_hash(F.col(key_col), shards), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign_shards(assign_shards(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return number_rows(rows, ["doc_id"], "slot", "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
