"""Logs, delivery, filters and routing."""

from loomery.operators.logs import OPERATORS
from loomery.suites.frames import register

QUERIES, ORACLES = register(OPERATORS)
