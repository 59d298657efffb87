"""Strings, numbers, indexes and optimisation."""

from loomery.operators.texts import OPERATORS
from loomery.suites.frames import register

QUERIES, ORACLES = register(OPERATORS)
