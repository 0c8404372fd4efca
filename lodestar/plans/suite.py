"""Runs of a collection that judge it: a lifecycle of mutations, and a suite over seeded vectors."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.generators import vectors
from lodestar.operators import ivf, mutations, search
from lodestar.sources.collection import Collection

EXACT_LEAST, LISTS_LEAST = 0.999, 0.95
"""Recalls that a suite's cells must reach."""


def lifecycle(spark: SparkSession, path: str, rows: DataFrame, extra: list[tuple]) -> DataFrame:
    """phase, generation, mutation_ms, first_search_ms, result_count, deleted_id_absent after each change of a stored collection.

    rows: (id, user_id, timestamp, vector) that it starts with. extra: as many more as one plus a batch.
    """
    dimension = len(extra[0][3])
    first = rows.withColumn("seq", F.col("id")).withColumn("op", F.lit(mutations.ADD))
    out, gone = [], set()
    c = Collection.create(spark, path, dimension)
    c.commit_table(first)

    def phase(name: str, change, deleted=()) -> None:
        nonlocal c
        began = time.perf_counter()
        change()
        changed = time.perf_counter()
        gone.update(deleted)
        hits = [r.id for r in c.search(extra[0][3], k=10)[0].collect()]
        out.append((name, c.generation, (changed - began) * 1e3, (time.perf_counter() - changed) * 1e3, len(hits), not gone.intersection(hits)))

    def reopen() -> None:
        nonlocal c
        c.close()
        c = Collection.open(spark, path)

    batch = extra[1:]
    phase("add_one", lambda: c.add(*extra[0]))
    phase("delete_one", lambda: c.delete(extra[0][0]), [extra[0][0]])
    phase("add_batch", lambda: c.add_batch(batch))
    phase("delete_batch", lambda: c.delete_batch([r[0] for r in batch[::2]]), [r[0] for r in batch[::2]])
    phase("reopen", reopen)
    c.close()
    return spark.createDataFrame(out, "phase string, generation long, mutation_ms double, first_search_ms double, result_count int, deleted_id_absent boolean")


def cell(records: DataFrame, queries: DataFrame, tuning: DataFrame, where, k: int, target: float, lists: int, runs: int = 3) -> dict:
    """One cell of a benchmark: truth by the oracle, effort tuned on other queries, a warm-up, timed runs, a summary."""
    from lodestar.operators.predicate import eligible

    rows = eligible(records, where)
    given = [(r[0], list(r[1])) for r in queries.collect()]
    truth = search.oracle_top_k(rows, given, k).select("query_id", "id")
    began = time.perf_counter()
    index = ivf.build(records, lists)
    built = time.perf_counter() - began
    effort = ivf.tune(ivf.recalls(index, records, tuning, k, range(1, lists + 1), where), target)
    spent, hits = [], None
    for i in range(runs + 1):
        began = time.perf_counter()
        hits = ivf.search(index, records, queries, k, effort, where)
        found = hits.collect()
        if i:  # the first only warms up
            spent.append(time.perf_counter() - began)
    total = truth.count()
    recall = records.sparkSession.createDataFrame([(r.query_id, r.id) for r in found], "query_id long, id long").join(truth, ["query_id", "id"]).count() / max(1, total)
    spent.sort()
    return {"corpus_rows": records.count(), "eligible_rows": rows.count(), "queries": len(given), "k": k, "effort": effort, "build_s": built, "p50_batch_s": spent[(len(spent) - 1) // 2], "runs": runs, "result_count": len(found), "recall_at_k": recall, "recall_target_passed": recall + 1e-12 >= target}


SIZES = {"quick": 10_000, "full": 100_000}


def suite(spark: SparkSession, rows: int, dimension: int = 384, queries: int = 16, k: int = 10, clusters: int = 32, lists: int = 32) -> DataFrame:
    """cell, rows, recall_at_k, passed: exact search by every strategy and inverted lists at the tuned effort, against the oracle."""
    from lodestar.functions import vectors as V

    raw = vectors(spark, rows, dimension, 42, clusters)
    r = raw.select("id", (F.col("id") % 100).alias("user_id"), (F.col("id") - rows // 2).alias("timestamp"), V.normalized(F.col("vector")).alias("vector"), F.lit(True).alias("live"), F.col("id").alias("slot"))
    step = max(1, rows // (2 * queries))
    chosen = r.where((F.col("id") % step == 0) & (F.col("id") < 2 * queries * step)).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    given = chosen.where(F.col("query_id") / step % 2 == 0)
    truth = search.oracle_top_k(r, [(q, list(v)) for q, v in given.collect()], k).select("query_id", "id")
    total = truth.count()
    out = []
    for name in (search.BLOCK, search.INT8):
        recall = search.batch_top_k(r, given, k, strategy=name).join(truth, ["query_id", "id"]).count() / total
        out.append((f"exact_{name}", rows, recall, recall >= EXACT_LEAST))
    index = ivf.build(r, lists)
    effort = ivf.tune(ivf.recalls(index, r, chosen.where(F.col("query_id") / step % 2 == 1), k, range(1, lists + 1)), LISTS_LEAST)
    recall = ivf.search(index, r, given, k, effort).join(truth, ["query_id", "id"]).count() / total
    out.append((f"lists_{effort}_of_{lists}", rows, recall, recall >= LISTS_LEAST))
    return spark.createDataFrame(out, "cell string, rows long, recall_at_k double, passed boolean")
