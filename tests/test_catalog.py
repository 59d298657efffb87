"""Registered queries against the SQL of a second engine on the smallest tables, and the driver's entry points."""

import math
import os
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from loomery import catalog
from loomery.errors import BadRequest
from loomery.operators.sqlop import SqlOperator

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return str(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_every_query_equals_its_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_works_without_the_corpus_package(tmp_path):
    for name in ("__spark_entry__.py", "loomery"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for name in os.listdir(os.path.join(ROOT, "loomery")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "loomery", name), tmp_path / "loomery" / name)
    script = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e); print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 300 and out[-1] == "False"


def test_sql_operators_refuse_unknown_parameters(spark):
    with pytest.raises(BadRequest):
        SqlOperator("SELECT {n} AS n", {"n": 1}).apply(spark, {}, m=2)
    assert SqlOperator("SELECT {n} AS n", {"n": 1}).apply(spark, {}, n=5).first()["n"] == 5
