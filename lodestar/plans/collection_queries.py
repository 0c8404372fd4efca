"""Queries that run through a stored collection, its files and its sources: what comes back must be what SQL computes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import evaluation as E
from lodestar.operators import mutations, search
from lodestar.operators.predicate import Filter
from lodestar.plans import suite
from lodestar.plans.registry import RECORDS, SAMPLES, meta, query, records, samples, table, units
from lodestar.plans.store_queries import LOW, STATED, WINDOW, _batch, _queries, rounded
from lodestar.sources import scratch, tables
from lodestar.sources.collection import Collection, Snapshot, View

BUDGET = 1 << 50
WIDTH = 64
"""Components of a vector in the table embeddings."""
STATE = "SELECT id, user_id, timestamp, live, slot, round(CAST(vector[1] AS DOUBLE), 6) AS first FROM rec"


def _mutations(spark, d):
    """Additions of all records in order of id, then deletions of every seventh."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = e.join(meta(spark, d), "id")
    adds = rows.select(F.col("id").alias("seq"), F.lit(mutations.ADD).alias("op"), "id", "user_id", "timestamp", "vector")
    gone = rows.where("not live").select(F.col("id").alias("seq"), F.lit(mutations.DELETE).alias("op"), "id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("timestamp"), F.lit(None).cast("array<float>").alias("vector"))
    return adds, gone


def _filled(spark, d, path=None) -> Collection:
    c = Collection.new(spark, WIDTH, BUDGET) if path is None else Collection.create(spark, path, WIDTH, BUDGET)
    adds, gone = _mutations(spark, d)
    c.commit_table(adds)
    c.commit_table(gone)
    return c


def _state(c: Collection):
    return c.records().select("id", "user_id", "timestamp", "live", "slot", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("m1_collection_state", f"{RECORDS} {STATE}")
def m1(spark, d):
    return _state(_filled(spark, d))


@query("io1_flush_and_open", f"{RECORDS} {STATE}")
def io1(spark, d):
    """A snapshot and a log behind it, read by another opening."""
    path = scratch.folder(spark, "store")
    c = Collection.create(spark, path, WIDTH, BUDGET)
    adds, gone = _mutations(spark, d)
    c.commit_table(adds)
    c.flush()
    c.commit_table(gone)
    c.close()
    return _state(Collection.open(spark, path, WIDTH, BUDGET))


@query("io5_recovered_logs", f"{RECORDS} {STATE}")
def io5(spark, d):
    """Logs alone, without a snapshot; a file that no marker names is ignored."""
    path = scratch.folder(spark, "store")
    c = _filled(spark, d, path)
    meta(spark, d).write.parquet(f"{path}/data/log-unpublished")
    c.close()
    return _state(Collection.open(spark, path, WIDTH, BUDGET))


@query("k8_collection_search", _batch("true", 10, STATED))
def k8(spark, d):
    rows = table(spark, d, "embeddings").where(STATED).orderBy("vec_id").select("vec_id", "embedding").collect()
    hits, _ = _filled(spark, d).search_batch([list(r[1]) for r in rows], k=10)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "query_id long, name long")
    return rounded(hits.join(F.broadcast(names), "query_id").select(F.col("name").alias("query_id"), "rank", "id", "distance"))


@query("u1_report", f"{RECORDS}, w AS (SELECT *, slot - lag(slot) OVER (ORDER BY slot) AS gap FROM rec WHERE live AND user_id = 3) SELECT (SELECT count(*) FROM rec) + (SELECT count(*) FROM rec WHERE NOT live) AS generation, (SELECT count(*) FROM rec) AS corpus_rows, (SELECT count(*) FROM w) AS eligible_rows, (SELECT count(*) FILTER (gap IS NULL OR gap <> 1) FROM w) AS runs, 'User' AS predicate, 'block' AS strategy, 'Initial' AS reason")
def u1(spark, d):
    c = _filled(spark, d)
    c.set_diagnostics(True)
    v = list(table(spark, d, "embeddings").where("vec_id = 3").first()["embedding"])
    r = c.search(v, Filter(3), 10)[1]
    c.set_ivf(4, 4)
    reason = c.search(v)[1].preparation_reason
    return spark.createDataFrame([(r.generation, r.corpus_rows, r.eligible_rows, r.eligible_contiguous_runs, r.predicate, r.strategy, reason)], "generation long, corpus_rows long, eligible_rows long, runs long, predicate string, strategy string, reason string")


@query("c11_rebuilt_lists", _batch("true", 10, "vec_id = 3").replace("query_id, CAST(rank AS INT) AS rank, id", "CAST(rank AS INT) AS rank, id"))
def c11(spark, d):
    """All lists of a stored index: deleted rows never come back."""
    c = _filled(spark, d)
    c.set_ivf(8, 8)
    v = list(table(spark, d, "embeddings").where("vec_id = 3").first()["embedding"])
    return rounded(c.search(v, k=10)[0])


@query("f6_collection_filter", f"{RECORDS} SELECT id FROM rec WHERE live AND timestamp >= {WINDOW.lower} AND timestamp < {WINDOW.upper}")
def f6(spark, d):
    return _filled(spark, d).filter(WINDOW)


@query("r7_snapshot", f"{RECORDS} SELECT id, timestamp FROM rec WHERE live AND timestamp >= {LOW}")
def r7(spark, d):
    return Snapshot(_filled(spark, d), Filter(None, LOW)).rows().select("id", "timestamp")


@query("r6_clamped_search", f"{_batch('true', 64, 'vec_id = 3').replace('query_id, CAST(rank AS INT) AS rank, id', 'CAST(rank AS INT) AS rank, id')} UNION ALL SELECT 0, id, round(CAST(d AS DOUBLE), 6) + 0.0 FROM rk WHERE rank = 1")
def r6(spark, d):
    """k of 1,000 becomes 64, k of 0 becomes 1 (here with rank 0)."""
    view = View(_filled(spark, d))
    v = list(table(spark, d, "embeddings").where("vec_id = 3").first()["embedding"])
    one = view.search(v, k=0).withColumn("rank", F.col("rank") - 1)
    return rounded(view.search(v, k=1000).unionByName(one))


@query("r9_stats", f"{RECORDS} SELECT count(*) AS rows, count(*) FILTER (live) AS live_rows, count(*) FILTER (NOT live) AS tombstones, 64 AS dimension FROM rec")
def r9(spark, d):
    s = _filled(spark, d).stats()
    return spark.createDataFrame([tuple(s[k] for k in ("rows", "live_rows", "tombstones", "dimension"))], "rows long, live_rows long, tombstones long, dimension int")


@query("io21_bulk_columns", f"{RECORDS} SELECT id, user_id, slot, round(CAST(vector[1] AS DOUBLE), 6) AS first FROM rec WHERE id % 50 = 0 ORDER BY id")
def io21(spark, d):
    """Columns as a program has them in memory, in one commit: the rows whose ids are divisible by 50."""
    import numpy as np

    got = table(spark, d, "embeddings").where(STATED).join(meta(spark, d), F.col("vec_id") == F.col("id")).orderBy("id").select("id", "user_id", "timestamp", "embedding").collect()
    c = Collection.new(spark, WIDTH, BUDGET)
    c.add_buffer(np.array([r[3] for r in got], np.float32), [r[0] for r in got], user_ids=[r[1] for r in got], timestamps=[r[2] for r in got])
    return c.records().select("id", "user_id", (F.col("slot") * 50).alias("slot"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("io16_csv_round_trip", f"{SAMPLES} SELECT id, run, engine, ns FROM s")
def io16(spark, d):
    at = tables.write_result(samples(spark, d).select("id", "run", "engine", "ns"), scratch.folder(spark, "csv"), "samples")
    return tables.read_csv(spark, at, "id long, run long, engine string, ns long")


@query("io16_properties", f"{SAMPLES} SELECT engine, CAST(count(*) AS VARCHAR) AS n FROM s GROUP BY engine")
def io16b(spark, d):
    at = tables.write_summary(spark, {r[0]: r[1] for r in samples(spark, d).groupBy("engine").count().collect()}, scratch.folder(spark, "summary"))
    return tables.read_properties(spark, at).select(F.explode("properties").alias("engine", "n"))


@query("io19_truth_sink", "SELECT event_type AS split, user_id AS query_index, array_to_string(list_sort(list(event_id)), ';') AS ids FROM events GROUP BY ALL")
def io19(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("split"), F.col("user_id").alias("query_index")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return tables.read_csv(spark, tables.write_result(t, scratch.folder(spark, "csv"), "truth"), tables.TRUTH_COLUMNS)


@query("io20_run_store", "SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(props, (ts, props)) AS payload FROM events GROUP BY user_id ORDER BY max(ts) DESC, run_id DESC LIMIT 500")
def io20(spark, d):
    store = tables.RunStore(spark, scratch.folder(spark, "runs"))
    store.insert(table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("received_at"), F.col("props").alias("payload")))
    return store.latest(500).select("run_id", "payload")


@query("e7_lifecycle", "SELECT unnest(['add_one', 'delete_one', 'add_batch', 'delete_batch', 'reopen']) AS phase, (SELECT count(*) FROM embeddings JOIN events ON vec_id = event_id) + unnest([1, 2, 66, 98, 98]) AS generation, 10 AS result_count, true AS deleted_id_absent")
def e7(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(meta(spark, d), "id")
    extra = [(-1 - r[0], 0, r[0], list(r[1])) for r in units(spark, d).orderBy("vec_id").limit(65).select("vec_id", "v").collect()]
    return suite.lifecycle(spark, scratch.folder(spark, "life"), e.select("id", "user_id", "timestamp", "vector"), extra).select("phase", "generation", "result_count", "deleted_id_absent")


@query("e8_quick_suite", "SELECT unnest(['exact_block', 'exact_int8', 'lists']) AS cell, 10000 AS rows, true AS passed")
def e8(spark, d):
    got = suite.suite(spark, suite.SIZES["quick"])
    return got.select(F.regexp_replace("cell", "_[0-9]+_of_[0-9]+$", "").alias("cell"), "rows", "passed")


@query("e6_benchmark_cell", f"{RECORDS}, q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 50 = 0) SELECT (SELECT count(*) FROM rec) AS corpus_rows, (SELECT count(*) FROM rec WHERE live AND timestamp >= {LOW}) AS eligible_rows, n AS queries, least(n * 10, n * (SELECT count(*) FROM rec WHERE live AND timestamp >= {LOW})) AS result_count, true AS passed FROM q")
def e6(spark, d):
    r = records(spark, d)
    q, tuning = (units(spark, d).where(f"vec_id % 50 = {x}").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")) for x in (0, 25))
    got = suite.cell(r, q, tuning, Filter(None, LOW), 10, 0.9, 8, runs=1)
    return spark.createDataFrame([(got["corpus_rows"], got["eligible_rows"], got["queries"], got["result_count"], got["recall_at_k"] >= 0.8)], "corpus_rows long, eligible_rows long, queries long, result_count long, passed boolean")


@query("io18_nested_recalls", _batch("true", 10, STATED))
def io18(spark, d):
    hits = search.batch_top_k(records(spark, d), _queries(spark, d, STATED), 10)
    nested = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("h"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    at = scratch.folder(spark, "recalls")
    e.join(nested, "query_id").select("query_id", "embedding", F.transform("h", lambda x: F.struct(x["id"].alias("id"), x["distance"].alias("distance"))).alias("recall")).write.parquet(at)
    return rounded(tables.read_recalls(spark, at))


@query("k14_ties_at_the_cut", f"{_batch('true', 11, STATED).replace('SELECT query_id, CAST(rank AS INT) AS rank, id, round(CAST(d AS DOUBLE), 6) + 0.0 AS distance', 'SELECT query_id, coalesce(max(d) FILTER (rank = 10) = max(d) FILTER (rank = 11), false) AS tied, count(*) FILTER (rank <= 10) AS hits')} GROUP BY query_id")
def k14(spark, d):
    got = search.tensor_top_k(records(spark, d), _queries(spark, d, STATED), 10)
    return got.groupBy("query_id", "tied").agg(F.count("*").alias("hits"))


@query("w24_replayed_engine", "SELECT vec_id AS query_id, 10 AS results, true AS valid FROM embeddings WHERE vec_id % 50 = 0")
def w24(spark, d):
    """Another engine's results, here those of 8-bit search, held against the oracle: as many, near enough, in order, and tied at most."""
    r = records(spark, d)
    other = search.batch_top_k(r, _queries(spark, d, STATED), 10, strategy=search.INT8)
    e = table(spark, d, "embeddings")
    given = [(x[0], list(x[1])) for x in e.where(STATED).select("vec_id", "embedding").collect()]
    truth = search.oracle_top_k(r.where("live"), given, 10)
    bound = truth.groupBy("query_id").agg(F.max("distance").alias("boundary"), F.count("*").alias("expected"))
    per = other.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("distance").cast("double").alias("distance")))).alias("h"))
    found = F.transform("h", lambda x: x["distance"])
    valid = E.tie_compatible(found, F.col("boundary"), F.col("expected"), 1e-5) & (F.sort_array(found) == found)
    return per.join(bound, "query_id").select("query_id", F.size("h").alias("results"), valid.alias("valid"))


@query("r3_slot_order", f"{RECORDS} SELECT slot, id, live FROM rec")
def r3(spark, d):
    return _filled(spark, d).in_slot_order().select("slot", "id", "live")
