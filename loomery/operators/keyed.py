"""Ordered state machines and mergeable summaries that Spark's expressions cannot hold.

:func:`run_by_key` streams each key's rows, in order, past a machine: a task holds
one machine and one Arrow batch, never a key's history.  :func:`summarise`
builds a summary for each key in every input partition and merges these, so a
hot key is pre-aggregated where its rows are and only summaries are shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_ROWS = 8192


def _arrow(schema: str) -> tuple[list[str], pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return parsed.names, to_arrow_schema(parsed)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def run_by_key(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], make: Callable, schema: str) -> DataFrame:
    """``make()`` gives a machine with ``step(*inputs)`` and ``finish()``, both of which return output tuples.

    Output rows are the key followed by the columns of ``schema``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    whole = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    _, arrow = _arrow(whole)
    wanted = list(dict.fromkeys([*keys, *order, *inputs]))
    width, places = len(keys), [wanted.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, out = None, None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = row[:width]
                if machine is None or key != now:
                    if machine is not None:
                        out += [(*now, *r) for r in machine.finish()]
                    now, machine = key, make()
                out += [(*key, *r) for r in machine.step(*[row[p] for p in places])]
                if len(out) >= _ROWS:
                    yield _batch(out, arrow)
                    out = []
        if machine is not None:
            out += [(*now, *r) for r in machine.finish()]
        if out:
            yield _batch(out, arrow)

    ordered = rows.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, whole)


def summarise(rows: DataFrame, key: str, item: str, make: Callable, results: Callable, schema: str) -> DataFrame:
    """``results(summary)`` tuples of a summary with ``observe(item)`` and ``merge(other)`` for each key."""
    kind = dict(rows.dtypes)[key]
    _, arrow = _arrow(f"{key} {kind}, {schema}")
    _, between = _arrow(f"{key} {kind}, state binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k not in held:
                    held[k] = make()
                held[k].observe(x)
            if len(held) > _ROWS:  # many keys: what is built so far is sent on
                yield _batch([(k, pickle.dumps(s)) for k, s in held.items()], between)
                held = {}
        if held:
            yield _batch([(k, pickle.dumps(s)) for k, s in held.items()], between)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, out = None, None, []
        for batch in batches:
            for k, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = pickle.loads(raw)  # written by the tasks of this job
                if whole is None or k != now:
                    if whole is not None:
                        out += [(now, *r) for r in results(whole)]
                    now, whole = k, part
                else:
                    whole.merge(part)
                if len(out) >= _ROWS:
                    yield _batch(out, arrow)
                    out = []
        if whole is not None:
            out += [(now, *r) for r in results(whole)]
        yield _batch(out, arrow)

    parts = rows.select(F.col(key), F.col(item)).mapInArrow(build, f"{key} {kind}, state binary")
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(join, f"{key} {kind}, {schema}")
