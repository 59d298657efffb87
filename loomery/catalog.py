"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.definitions import PLAIN

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    import loomery.suites as suites

    for found in sorted(pkgutil.iter_modules(suites.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"loomery.suites.{found.name}")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _modules():
        out |= getattr(module, "QUERIES", {})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= getattr(module, "ORACLES", {})
    return out | PLAIN
