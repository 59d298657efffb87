"""Ordered folds: a state machine over each key's rows in order.

A machine is declared once: its state fields with initial value and step, and
its results.  Expressions are SQL over ``s`` (the state) and ``x`` (the row);
``$name`` stands for a named sub-expression.  Rows of a key are sorted inside
one array and folded by the ``aggregate`` higher-order function on the JVM, so
keys run in parallel and a key's history is one value; very long histories
should be cut by a finer key (a day, a session), as the registered queries do
by user.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.errors import BadRequest

_DUCK = {"STRING": "VARCHAR", "ARRAY<BIGINT>": "BIGINT[]", "ARRAY<STRING>": "VARCHAR[]", "ARRAY<DOUBLE>": "DOUBLE[]"}


@dataclass(frozen=True)
class Fold:
    """``state``: name -> (type, initial, step); ``out``: name -> (type, expression of the last state)."""

    state: dict[str, tuple[str, str, str]]
    out: dict[str, tuple[str, str]]
    let: dict[str, str] = field(default_factory=dict)
    #: Spark spelling -> the other dialect's, where they differ.
    spell: dict[str, str] = field(default_factory=dict)

    def _text(self, text: str) -> str:
        for _ in range(len(self.let) + 1):
            if "$" not in text:
                return text
            text = Template(text).substitute({k: f"({v})" for k, v in self.let.items()})
        raise BadRequest("sub-expressions refer to each other in a circle")

    def spark_sql(self, rows: str = "xs") -> str:
        """The fold of array ``rows`` as one Spark expression giving a struct."""
        start = ", ".join(f"'{n}', CAST({i} AS {t})" for n, (t, i, _) in self.state.items())
        step = ", ".join(f"'{n}', CAST({self._text(e)} AS {t})" for n, (t, _, e) in self.state.items())
        last = ", ".join(f"'{n}', CAST({self._text(e)} AS {t})" for n, (t, e) in self.out.items())
        return f"aggregate({rows}, named_struct({start}), (s, x) -> named_struct({step}), s -> named_struct({last}))"

    def apply(self, rows: DataFrame, keys: list[str], order: list[str], inputs: list[str]) -> DataFrame:
        """One row per key with the results; null order values come first."""
        packed = F.sort_array(F.collect_list(F.struct(*order, *[c for c in inputs if c not in order]))).alias("xs")
        folded = rows.groupBy(*keys).agg(packed).select(*keys, F.expr(self.spark_sql()).alias("r"))
        return folded.select(*keys, "r.*")

    def duck_sql(self, source: str, keys: list[str], order: list[str], inputs: list[str]) -> str:
        """The same fold for an independent SQL engine."""

        def said(text: str) -> str:
            text = self._text(text)
            for a, b in self.spell.items():
                text = text.replace(a, b)
            return text

        def kind(t: str) -> str:
            return _DUCK.get(t, t)

        start = ", ".join(f"'{n}': CAST({said(i)} AS {kind(t)})" for n, (t, i, _) in self.state.items())
        step = ", ".join(f"'{n}': CAST({said(e)} AS {kind(t)})" for n, (t, _, e) in self.state.items())
        cols = ", ".join(f"'{c}': {c}" for c in dict.fromkeys([*order, *inputs]))
        by = ", ".join(f"{c} NULLS FIRST" for c in order)
        last = ", ".join(f"CAST({said(e)} AS {kind(t)}) AS {n}" for n, (t, e) in self.out.items())
        names = ", ".join(keys)
        return (
            f"WITH src AS ({source}), packed AS (SELECT {names}, list({{{cols}}} ORDER BY {by}) AS xs FROM src GROUP BY {names}), "
            f"done AS (SELECT {names}, list_reduce(xs, lambda s, x: {{{step}}}, {{{start}}}) AS s FROM packed) SELECT {names}, {last} FROM done"
        )
