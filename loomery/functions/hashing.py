"""Stable hashes and placements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.errors import BadRequest

# Multiplier of the published jump consistent hash generator, split into 32-bit halves.
JUMP_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def stable_digest(value: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 32)


def stable_bucket(value: Column, buckets: int) -> Column:
    """First 32 bits of SHA-256, modulo ``buckets``."""
    if buckets < 1:
        raise BadRequest("buckets must be positive")
    return F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _times32(x: Column, y: int) -> Column:
    """The low 32 bits of a product of 32-bit halves, never beyond 2**49."""
    upper = F.shiftright(x, 16) * F.lit(y)
    return _low(_low(x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y)) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16))


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """One generator step ``x * JUMP_MULTIPLIER + 1 mod 2**64`` on 32-bit halves.

    Signed 64-bit columns would overflow (an error in ANSI mode), so products
    are taken of 16-bit by 32-bit parts.
    """
    part = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW)
    upper = F.shiftright(low, 16) * F.lit(_LOW)
    total = part + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    return _low(carry + _times32(high, _LOW) + _times32(low, _HIGH)), _low(total)


def jump_hash(key: Column, buckets: int, quick: int = 24) -> Column:
    """Jump consistent hash of a 64-bit key: its bucket out of ``buckets``.

    Growing from n to n+1 buckets moves a key only into the new bucket.  Each
    jump goes to a strictly higher bucket, so ``buckets`` jumps always finish;
    about ln(buckets) do on average, so ``quick`` are tried first and the long
    loop runs only for the keys those leave unfinished.  Null keys give null.
    """
    if buckets < 1:
        raise BadRequest("buckets must be positive")
    end = F.lit(float(buckets))

    def step(state: Column, _: Column) -> Column:
        high, low = _advance(state["high"], state["low"])
        jump = (state["next"] + F.lit(1.0)) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1).cast("double") + F.lit(1.0)))
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("at"), F.floor(jump).cast("double").alias("next"))
        return F.when(state["next"] < end, moved).otherwise(state)

    key = key.cast("bigint")
    start = F.struct(
        _low(F.shiftrightunsigned(key, 32)).alias("high"), _low(key).alias("low"), F.lit(0.0).alias("at"), F.lit(0.0).alias("next")
    )
    tries = min(quick, buckets)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, step)
    if tries < buckets:

        def finish(s: Column) -> Column:
            rest = F.aggregate(F.sequence(F.lit(1), F.lit(buckets)), s, step, lambda t: t["at"])
            return F.when(s["next"] >= end, s["at"]).otherwise(rest)

        # The one-element array evaluates the state once.
        return F.when(key.isNotNull(), F.get(F.transform(F.array(state), finish), F.lit(0))).cast("int")
    return F.when(key.isNotNull(), state["at"]).cast("int")
