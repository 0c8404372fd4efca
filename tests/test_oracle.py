"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os
from pathlib import Path

import pytest

import duckdb
from lodestar.plans import collection_queries, evaluation_queries, registry, report_queries, store_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA / f}'")
    return c


def plain(rows):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float | int) and not isinstance(v, bool) else v

    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, str(DATA))
    want = con.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert plain(got.select(order).collect()) == plain(want.project(",".join(f'"{c}"' for c in order)).fetchall())
