"""Frames the registered SQL operators run over, for both engines."""

from __future__ import annotations

import re

from loomery.suites.machines import DUCK_EVENTS, user_events

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Views of the tables, by name, in the dialect of the second engine.
VIEWS = {"ev": DUCK_EVENTS}


def frame(spark, sf_dir: str, name: str):
    if name == "ev":
        return user_events(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(operators: dict):
    """QUERIES and ORACLES of a dict of SQL operators."""

    def query(op):
        return lambda spark, sf_dir: op.apply(spark, {n: frame(spark, sf_dir, n) for n in op.frames()})

    return {n: query(op) for n, op in operators.items()}, {n: re.sub(r"\s+", " ", op.duck_sql(VIEWS)) for n, op in operators.items()}
