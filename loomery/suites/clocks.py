"""Clocks, partitioning, flow control, coordination and models; and the string-keyed jump hash."""

from pyspark.sql import functions as F

from loomery.functions.hashing import jump_hash
from loomery.operators.clocks import OPERATORS
from loomery.suites.frames import frame, register

QUERIES, ORACLES = register(OPERATORS)


def jumphash(spark, sf_dir):
    """Users in ten buckets and in eleven."""
    users = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return users.select("k", jump_hash(F.col("k"), 10).alias("bucket"), jump_hash(F.col("k"), 11).alias("grown"))


def _jump(n: int) -> str:
    step = "CASE WHEN s.nx < {n} THEN {{'st': (s.st * 2862933555777941757 + 1) % 18446744073709551616, 'at': s.nx, 'nx': CAST(floor((s.nx + 1) * (2147483648e0 / (CAST(((s.st * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS DOUBLE)}} ELSE s END"
    return "CAST((list_reduce(generate_series(1, {n}), lambda s, x: ".format(n=n) + step.format(n=n) + ", {'st': CAST(c_custkey AS HUGEINT), 'at': CAST(0 AS DOUBLE), 'nx': CAST(0 AS DOUBLE)})).at AS INTEGER)"


QUERIES["jumphash"] = jumphash
ORACLES["jumphash"] = f"SELECT c_custkey AS k, {_jump(10)} AS bucket, {_jump(11)} AS grown FROM customer"
