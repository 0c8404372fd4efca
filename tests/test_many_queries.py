"""k14's search takes any number of queries, and tells ties at the cut."""

import numpy as np

from lodestar.functions import vectors as V
from lodestar.operators import search
from pyspark.sql import functions as F


def test_more_queries_than_a_tensor_takes(spark):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(100, 12)), [1 + i % 3 for i in range(100)], axis=0).astype(np.float32)  # copies tie
    rows = spark.createDataFrame([(i, 0, 0, True, i, x.tolist()) for i, x in enumerate(v)], "id long, user_id long, timestamp long, live boolean, slot long, raw array<float>").withColumn("vector", V.normalized(F.col("raw")))
    queries = rows.select(F.col("id").alias("query_id"), F.col("raw").alias("query"))
    got = search.tensor_top_k(rows, queries, 4).collect()
    want = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.batch_top_k(rows, queries, 5, strategy=search.REFERENCE).collect()}
    tied = {q: want[q, 4][1] == want[q, 5][1] for q in range(len(v))}
    assert len(v) > 128 and set(tied.values()) == {True, False}
    assert {(r.query_id, r["rank"]): (r.id, r.distance, r.tied) for r in got} == {(q, k): (*x, tied[q]) for (q, k), x in want.items() if k <= 4}
    assert len(search.tensor_top_k(rows.where("id < 64"), queries.limit(1), V.MAX_K).collect()) == 64
