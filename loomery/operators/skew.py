"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one row in HOT_SHARE of the table, so at
#: most HOT_SHARE keys are hot at any table size: that bounds the broadcast.
HOT_SHARE = 1024


def join_back(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join per-key aggregates ``groups`` (unique on ``key``) back to ``rows``.

    ``size`` names the column of ``groups`` with the number of rows a key has
    and ``total`` is their sum.  The at most ``HOT_SHARE`` keys with more than
    ``total / HOT_SHARE`` rows are broadcast, so their rows never meet in one
    task; all others take an ordinary shuffle join.  Rows whose key is null
    match nothing.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = groups.filter(F.col(size) > limit)
    hot_keys = [r[0] for r in hot.select(key).collect()]  # at most HOT_SHARE values
    if not hot_keys:
        return rows.join(groups, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot_keys), F.lit(False))
    warm = rows.filter(is_hot).join(F.broadcast(groups.filter(F.col(size) > limit)), key, how)
    rest = rows.filter(~is_hot).join(groups.filter(F.col(size) <= limit), key, how)
    return warm.unionByName(rest)


#: Ids are sent to the rows up to this many (some 80 MB as a hashed relation); beyond, both sides are shuffled.
BROADCAST_IDS = 1 << 20


def join_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide ``rows`` with a one-column frame of distinct ``ids``.

    The ids are counted first: few enough, and they are broadcast, so that
    wide rows stay where they are; else the join shuffles.
    """
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), key, how)
