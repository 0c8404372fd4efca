"""Components: against a walk over the links, and a hub's links are split by Spark."""

import random

import pytest

from lodestar.llm.components import _star, components


def brute(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return {x: r for x, r in root.items() if x != r}


def test_components(spark):
    rng = random.Random(3)
    links = [(7, i) for i in range(100, 2000)]  # a hub
    links += [(i, i + 1) for i in range(3000, 3060)]  # a chain
    links += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    links += [(9, 9), (150, 7), (150, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute([x for x in links if x[0] != x[1]])
    assert len(got) == len(want)
    assert {r.id: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("large", [True, False])
def test_hub_is_split(spark, tmp_path, large):
    """A join whose one side has a hub's rows must be one that the adaptive planner may split."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    hub = "1 as a, id as b" if large else "id as a, 1000000 as b"
    rows = spark.range(2, 20_000, 1, 8).selectExpr(*[f"cast({c.split(' as ')[0]} as long) as {c.split(' as ')[1]}" for c in hub.split(", ")])
    rows.write.parquet(str(tmp_path / "links"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = _star(spark.read.parquet(str(tmp_path / "links")), large)
        n = len(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 19_998
    assert "skew=true" in plan
