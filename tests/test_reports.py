"""Bootstraps, generators and metadata against versions written out with Python's own numbers; recall of inverted lists."""

import math
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import generators
from lodestar.plans import report_queries as R
from lodestar.plans import suite
from lodestar.plans.registry import QUERIES, SAMPLES, records, units

from .test_oracle import DATA

MASK = 2**64 - 1


def mix(i, seed):
    z = (seed + (i + 1) * 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


def rank(values, q):
    return sorted(values)[max(1, math.ceil(len(values) * q)) - 1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return c


def test_paired_bootstrap(spark, con):
    rows = con.sql(f"{R.ARMS} SELECT cell, run, cpu - gpu FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL ORDER BY 1, 2").fetchall()
    got = {r.cell: (r.difference, r.low, r.high) for r in QUERIES["a23_paired_bootstrap"](spark, str(DATA)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for cell, found in got.items():
        x = [r[2] for r in rows if r[0] == cell]
        n = len(x)
        middles = [statistics.median_low([x[mix(t * n + j, 20260905) % n] for j in range(n)]) for t in range(R.PAIRED_DRAWS)]
        assert found == (statistics.median_low(x), rank(middles, 0.025), rank(middles, 0.975))


def test_hierarchical_bootstrap(spark, con):
    rows = con.sql(f"{SAMPLES} SELECT engine, run, id // 64 AS batch, quantile_disc(ns, 0.5) FROM s GROUP BY ALL ORDER BY 1, 2, 3").fetchall()
    for r in QUERIES["a24_hierarchical_bootstrap"](spark, str(DATA)).collect():
        runs = {}
        for _, run, _, p in (x for x in rows if x[0] == r.engine):
            runs.setdefault(run, []).append(p)
        runs, n = list(runs.values()), len({x[1] for x in rows if x[0] == r.engine})
        middles = []
        for t in range(R.HIERARCHY_DRAWS):
            own = []
            for place in range(n):
                i = mix(t * n + place, 7) % n
                x = runs[i]
                own.append(statistics.median_low([x[mix((t * n + place) * len(x) + j, 8 + i) % len(x)] for j in range(len(x))]))
            middles.append(statistics.median_low(own))
        assert (r.low, r.high, r.runs) == (rank(middles, 0.025), rank(middles, 0.975), n)


def test_block_bootstrap(spark, con):
    rows = con.sql(f"{R.ARMS} SELECT cell % 2, run, cell, ln(cpu / gpu) FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL ORDER BY 1, 2, 3").fetchall()
    for r in QUERIES["a29_block_bootstrap"](spark, str(DATA)).collect():
        strata = {}
        for _, run, _, x in (x for x in rows if x[0] == r.half):
            strata.setdefault(run, []).append(x)
        n = sum(map(len, strata.values()))
        means = [math.exp(sum(sum(x[mix(t * len(x) + j, 100 + run) % len(x)] for j in range(len(x))) for run, x in strata.items()) / n) for t in range(R.PAIRED_DRAWS)]
        assert [r.low95, r.high95, r.low98, r.high98] == pytest.approx([rank(means, q) for q in (0.05, 0.95, 0.0125, 0.9875)], rel=1e-12)


def test_shuffle_and_metadata(spark):
    def written(n, seed):
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            seed = (seed * 6364136223846793005 + 1442695040888963407) & MASK
            out[i], out[seed % (i + 1)] = out[seed % (i + 1)], out[i]
        return out

    assert generators.shuffled(5, 1) == written(5, 1) and generators.shuffled(200, 2**64 - 1) == written(200, 2**64 - 1)
    for r in QUERIES["w2_synthetic_metadata"](spark, str(DATA)).where("id < 50").collect():
        u, v = ((mix(2 * r.id + k, 17) >> 11) / 2**53 for k in (0, 1))
        assert (r.independent_owner, r.positive_owner, r.skewed_owner) == (int(u * 100), int((0.8 * u + 0.2 * v) * 100), 0 if u < 0.9 else 1 + int(v * 99))
    got = QUERIES["s16_generators"](spark, str(DATA)).where("id in (0, 999)").collect()
    for r in got:
        want = [(mix(r.id * 16 + j, 42) >> 11) / 2**53 * 2 - 1 + (8 if j == r.id % 8 % 16 else 0) for j in range(16)]
        assert list(r.vector) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["c5_ivf_flat_probe", "c7_ivf_codes", "c8_ivf_batch_union"])
def test_recall_of_lists(spark, name):
    want = {(r.query_id, r.id) for r in QUERIES["k7_batch_topk"](spark, str(DATA)).collect()}
    got = {(r.query_id, r.id) for r in QUERIES[name](spark, str(DATA)).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_recall_by_effort(spark):
    from lodestar.operators import ivf
    from lodestar.plans.store_queries import LISTS, STATED, _unit_queries

    r = records(spark, str(DATA))
    q, index = _unit_queries(spark, str(DATA), STATED), ivf.build(records(spark, str(DATA)), LISTS)
    want = {(x.query_id, x.id) for x in QUERIES["k7_batch_topk"](spark, str(DATA)).collect()}
    found = {x.nprobe: x.recall for x in QUERIES["c13_recall_by_effort"](spark, str(DATA)).collect()}
    for n in (1, 5, LISTS):
        got = {(x.query_id, x.id) for x in ivf.search(index, r, q, 10, n).collect()}
        assert found[n] == pytest.approx(len(want & got) / len(want))


def test_stored_lists_give_the_same(spark, tmp_path):
    from lodestar.operators import ivf
    from lodestar.operators.predicate import Filter

    r = records(spark, str(DATA))
    q = units(spark, str(DATA)).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    stored, passing = ivf.build(r, 8, f"{tmp_path}/lists"), ivf.build(r, 8)
    for options in ({}, {"codes": True}, {"union": True}, {"where": Filter(3)}):
        a, b = (sorted(map(tuple, ivf.search(i, r, q, 5, 2, **options).collect())) for i in (stored, passing))
        assert a == b
    plan = ivf.search(stored, r, q.limit(1), 5, 1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan)


def test_lifecycle_and_suite(spark, tmp_path):
    rows = spark.range(60).select("id", (F.col("id") % 3).alias("user_id"), F.col("id").alias("timestamp"), F.array(*[F.cos(F.col("id") * (j + 1)).cast("float") for j in range(4)]).alias("vector"))
    extra = [(100 + i, 1, i, [1.0, float(i + 1), 2.0, -1.0]) for i in range(7)]
    got = suite.lifecycle(spark, f"{tmp_path}/life", rows, extra).collect()
    assert [r.phase for r in got] == ["add_one", "delete_one", "add_batch", "delete_batch", "reopen"]
    assert all(r.deleted_id_absent and r.result_count == 10 for r in got) and got[-1].generation == 60 + 1 + 1 + 6 + 3
    cells = suite.suite(spark, 2000, 32, queries=8, lists=8).collect()
    assert len(cells) == 3 and all(r.passed for r in cells)
