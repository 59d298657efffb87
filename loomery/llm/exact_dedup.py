"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests of a history are cut into buckets by their leading bytes;
each bucket becomes one :class:`~loomery.llm.perfect_hash.Shard` row whose
slots hold the full digest, the winner's locator (doc_id and row) and the
group's size.  Rows are then looked up bucket by bucket in a sorted stream, so
a task holds one shard (about 32,768 digests) and one batch of rows whatever
the sizes of the groups.  Digests of more than one row in 1,024 are at most
1,024 in number; they form a small shard of their own that is sent to every
task, so that a hot text is looked up where it is read.

Defined results: a null text counts as empty; texts are equal when identical
after lower-casing A-Z; of equal texts the largest doc_id stays (null is
below all), and of repeated rows with that id exactly one; an empty table
gives no rows; further columns are ignored by the query and kept by
:func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.perfect_hash import Shard, as_words
from loomery.llm.shingles import buffers, trim
from loomery.operators.row_keys import free_name, keyed
from loomery.operators.skew import HOT_SHARE, join_ids
from loomery.sources.staging import staged

BUCKET_ENTRIES = 32768
_INDEX = "bucket long, n long, sizes binary, bits binary, digests binary, `values` binary"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        view, at = memoryview(data), offsets.tolist()
        found = [hashlib.sha256(bytes(view[at[i] : at[i + 1]]).lower()).digest() for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(range(row, row + len(found)), pa.int64()), pa.array(found, pa.binary())],
            names=["doc_id", "row", "digest"],
        )
        row += len(found)
        trim()


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, digest)`` of each row; bytes.lower() changes A-Z alone."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_digest_rows, "doc_id long, row long, digest binary")


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: winner id, winner row and size, combined map-side."""
    best = F.max(F.struct(F.col("doc_id"), F.col("row")))
    grouped = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("size"))
    return grouped.select("digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("winner_row"), "size")


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(buckets))


def build_index(groups: DataFrame, distinct: int) -> DataFrame:
    """Shard rows of the digests in ``groups`` (from :func:`group_digests`)."""
    buckets = max(1, -(-distinct // BUCKET_ENTRIES))
    spread = groups.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            made = Shard(as_words(table["digest"].to_pylist()), _slots(table["winner"].to_pylist(), table["winner_row"].to_numpy(), table["size"].to_numpy()))
            row = {"bucket": table["bucket"][0].as_py(), "n": table.num_rows, **made.dump()}
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            own = batch.column("bucket").to_numpy()
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1):
                if not len(part):
                    continue
                if held and held[0].column("bucket")[0].as_py() != own[part[0]]:
                    yield shard()
                    held = []
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield shard()

    return spread.mapInArrow(build, _INDEX)


def _slots(winners: list[int | None], rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Columns of the slots; a winner without an id has its size negated."""
    ids = np.array([w or 0 for w in winners], np.int64)
    return [ids, rows, np.where([w is None for w in winners], -sizes, sizes)]


def _answer(ids: pa.Array, rows: pa.Array, digests: pa.Array, member: np.ndarray, slot: np.ndarray, shard: Shard | None) -> pa.RecordBatch:
    at = np.where(member, slot, 0)
    columns = [np.where(member, c[at], 0) if shard is not None and len(shard.words) else np.zeros(len(at), np.int64) for c in (shard.columns if shard is not None and len(shard.words) else [None] * 3)]
    winner = pa.array(columns[0], pa.int64(), mask=~member | (columns[2] < 0))
    return pa.RecordBatch.from_arrays(
        [ids, rows, digests, pa.array(member), winner, pa.array(columns[1], pa.int64(), mask=~member), pa.array(np.abs(columns[2]), pa.int64(), mask=~member)],
        names=["doc_id", "row", "digest", "member", "winner", "winner_row", "size"],
    )


_FOUND = "doc_id long, row long, digest binary, member boolean, winner long, winner_row long, size long"


def look_up(rows: DataFrame, groups: DataFrame, index: DataFrame, distinct: int, total: int) -> DataFrame:
    """Each row of ``rows`` with what the index holds of its digest, if anything."""
    spark = rows.sparkSession
    buckets = max(1, -(-distinct // BUCKET_ENTRIES))
    limit = max(total // HOT_SHARE, 1000)
    hot = groups.filter(F.col("size") > limit).collect()  # at most HOT_SHARE rows
    hot_words = as_words([bytes(r["digest"]) for r in hot]) if hot else np.zeros((0, 4), np.uint64)
    few = spark.sparkContext.broadcast((hot_words, *_slots([r["winner"] for r in hot], *(np.array([r[c] for r in hot], np.int64) for c in ("winner_row", "size")))))

    def find_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *columns = few.value
        shard = Shard(words, columns)
        for batch in batches:
            member, slot = shard.find(as_words(batch.column(2).to_pylist()))
            yield _answer(*batch.columns[:3], member, slot, shard)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, shard = None, None
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            kind = batch.column("kind").to_numpy()
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own * 2 + kind)) + 1):
                if not len(part):
                    continue
                piece = batch.slice(int(part[0]), len(part))
                if kind[part[0]] == 0:
                    bucket, shard = own[part[0]], Shard.load(*(piece.column(c)[0].as_py() for c in ("sizes", "bits", "digests", "values")))
                    continue
                words = as_words(piece.column("digest").to_pylist())
                if shard is not None and bucket == own[part[0]]:
                    member, slot = shard.find(words)
                else:
                    member, slot = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
                yield _answer(piece.column("doc_id"), piece.column("row"), piece.column("digest"), member, slot, shard)

    if hot:
        first = staged(rows.mapInArrow(find_hot, _FOUND), "dedup-hot")
        done, rest = first.filter("member"), first.filter("not member").select("doc_id", "row", "digest")
    else:
        done, rest = None, rows
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("row", "long"), ("digest", "binary"))]
    shards = index.select("bucket", F.lit(0).alias("kind"), *empty, "sizes", "bits", "digests", "values")
    none = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "bits", "digests", "values")]
    probes = rest.select(_bucket(buckets).alias("bucket"), F.lit(1).alias("kind"), "doc_id", "row", "digest", *none)
    cold = shards.unionByName(probes).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(find, _FOUND)
    return cold if done is None else cold.unionByName(done)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts: ``(doc_id, row, digest, keep_id, group_size, kept, known)``.

    ``history`` is an earlier corpus with the same columns; without it the
    table is its own history, so that every row is a member.  A row whose text
    is in the history is ``known`` and stays only if it is the winner held
    there; texts that are not members are grouped among themselves.
    """
    rows = staged(digest_rows(docs, id_col, text_col), "dedup-rows")
    past = rows if history is None else staged(digest_rows(history, id_col, text_col), "dedup-past")
    groups = staged(group_digests(past), "dedup-groups")
    distinct, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    index = staged(build_index(groups, distinct), "dedup-index")
    found = look_up(rows, groups, index, distinct, total)
    known = F.lit(True).alias("known")
    if history is None:
        return found.select("doc_id", "row", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("winner_row")).alias("kept"), known)
    found = staged(found, "dedup-found")
    members = found.filter("member").select("doc_id", "row", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.lit(False).alias("kept"), known)
    new = found.filter("not member").select("doc_id", "row", "digest")
    own = staged(group_digests(new), "dedup-new")
    n_new, rows_new = own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fresh = look_up(new, own, staged(build_index(own, n_new), "dedup-new-index"), n_new, rows_new)
    return members.unionByName(
        fresh.select("doc_id", "row", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("winner_row")).alias("kept"), F.lit(False).alias("known"))
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeats: the kept row of each group, all columns as they were.

    Rows go by a key of their own, which is the id where ids are present and
    distinct; a null id counts as least, and of rows that tie one stays.
    """
    key = free_name(docs)
    rows = keyed(docs, id_col, key, nulls_first=True)
    out = exact_dedup(rows, None, key, text_col)
    dropped = staged(out.filter("not kept").select(F.col("doc_id").alias(key)), "dedup-dropped")
    return join_ids(rows, dropped, key, "left_anti").select(docs.columns)
