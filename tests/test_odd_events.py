"""Queries of events with odd values against their SQL, exactly: zeros, nulls and NaN are told apart."""

import duckdb

from lodestar.plans import report_queries  # noqa: F401
from lodestar.plans.registry import ORACLE, QUERIES

ROWS = [
    # event_id, user_id, event_type, value: a median of zero, both of zero, below zero, nulls alone, NaN, one kind only, negative and null ids
    *[(i, 10, "click", 0.0 if i % 2 else 5.0) for i in range(8)],
    *[(i, 11, "click", 0.0) for i in range(500, 504)],
    *[(i, 12, "click", 0.0 if i % 2 else -5.0) for i in range(1000, 1004)],
    *[(i, 13, "view", None if i % 2 else 3.0) for i in range(1500, 1504)],
    *[(i, 14, "view", 2.0 if i % 2 else float("nan")) for i in range(2000, 2004)],
    *[(i, 15, "view", 2.0) for i in range(2500, 2508, 2)],
    *[(i, 16, "view", 2.0 + i % 4) for i in range(-4, 4)],
    *[(i, 17, None, 2.0 + i % 3) for i in range(3000, 3005)],
    (None, 18, "view", 1.0),
    (3500, None, "view", 4.0),
    (3501, None, "view", 3.0),
]


def test_j9(spark, tmp_path):
    spark.createDataFrame(ROWS, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in QUERIES["j9_on_off_pairs"](spark, str(tmp_path)).collect())
    want = sorted(map(repr, c.execute(ORACLE["j9_on_off_pairs"]).fetchall()))
    assert got == want and {"inf", "-inf", "nan", "None"} <= {r.rsplit(", ")[-1].rstrip(")") for r in got}
