"""Aggregations and sketches."""

from loomery.operators.aggregates import OPERATORS
from loomery.suites.frames import register

QUERIES, ORACLES = register(OPERATORS)
