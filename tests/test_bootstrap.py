"""a22 against a bootstrap written out: lower medians of runs' 95th percentiles, 10,000 draws, nearest rank."""

import math
import random

import duckdb

from lodestar.plans import evaluation_queries  # noqa: F401
from lodestar.plans.registry import QUERIES, SAMPLES

from .test_oracle import DATA


def test_bootstrap(spark):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DATA}/events.parquet'")
    rows = c.sql(f"{SAMPLES} SELECT id % 5, engine, run, quantile_disc(ns, 0.95) FROM s WHERE engine IN ('click', 'view') GROUP BY ALL ORDER BY 1, 2, 3").fetchall()
    got = {r.cell: (r.ratio, r.low, r.high) for r in QUERIES["a22_bootstrap"](spark, str(DATA)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for cell in got:
        base, other = ([r[3] for r in rows if r[:2] == (cell, e)] for e in ("click", "view"))

        def middle(x):
            return sorted(x)[(len(x) - 1) // 2]

        rng = random.Random(20260828)
        r = sorted(middle(rng.choices(base, k=len(base))) / middle(rng.choices(other, k=len(other))) for _ in range(10_000))
        assert got[cell] == (middle(base) / middle(other), *(r[math.ceil(10_000 * q) - 1] for q in (0.025, 0.975)))
