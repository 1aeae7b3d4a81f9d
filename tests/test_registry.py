"""Registered queries against their SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.ml.regression import GBTRegressor

from fleetlake.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)[:10] if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows, names = df.collect(), sorted(df.columns)
    assert rows
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        at = [want.columns.index(c) for c in names]
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_training_takes_the_operators_rounds_and_depth(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(registry.rul, "GBTRegressor", lambda **told: asked.update(told) or GBTRegressor(**told | {"maxIter": 1, "maxDepth": 1}))
    registry.QUERIES["gbt_train_predict"](spark, SF)
    assert (asked["maxIter"], asked["maxDepth"]) == (50, 5)


def test_scans_read_what_they_need(spark):
    plan = registry.QUERIES["json_parse"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan
