"""Queries of filters, search, quantisation, inverted lists, reads and mutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import ivf, mutations, search
from lodestar.operators.predicate import Filter, eligible, page, unmatched
from lodestar.plans.registry import META, RECORDS, UNITS, meta, query, records, table, units, vector_of

LOW, HIGH = 1_704_067_200_000_000 + 3_600_000_000, 1_704_067_200_000_000 + 86_400_000_000
WINDOW = Filter(None, LOW, HIGH)
DIST = "round(CAST((1.0 - list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]))::FLOAT AS DOUBLE), 6) + 0.0"


def rounded(hits):
    return hits.withColumn("distance", F.round(F.col("distance").cast("double"), 6) + 0.0)


def _batch(where_sql: str, k: int, queries: str) -> str:
    return f"""{RECORDS}, q AS (SELECT vec_id AS query_id, v AS q FROM units WHERE {queries}),
  sc AS (SELECT query_id, id, (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT AS d FROM rec, q WHERE live AND {where_sql}),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM sc)
  SELECT query_id, CAST(rank AS INT) AS rank, id, round(CAST(d AS DOUBLE), 6) + 0.0 AS distance FROM rk WHERE rank <= {k}"""


def _queries(spark, d, condition):
    return table(spark, d, "embeddings").where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("k1_exact_topk", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 3) SELECT id, {DIST.format(a='q', b='vector')} AS distance FROM rec, q WHERE live AND timestamp >= {LOW} AND timestamp < {HIGH} ORDER BY (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT, id LIMIT 10")
def k1(spark, d):
    return rounded(search.top_k(records(spark, d), vector_of(spark, d, 3), 10, WINDOW))


@query("k2_reference_topk", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 11) SELECT id, {DIST.format(a='q', b='vector')} AS distance FROM rec, q WHERE live ORDER BY (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT, id LIMIT 64")
def k2(spark, d):
    return rounded(search.top_k(records(spark, d), vector_of(spark, d, 11), 64, strategy=search.REFERENCE))


@query("c1_block_certified_topk", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 11) SELECT id, {DIST.format(a='q', b='vector')} AS distance FROM rec, q WHERE live ORDER BY (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT, id LIMIT 20")
def c1(spark, d):
    return rounded(search.top_k(records(spark, d), vector_of(spark, d, 11), 20, strategy=search.BLOCK))


@query("c2_int8_certified_topk", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 11) SELECT id, {DIST.format(a='q', b='vector')} AS distance FROM rec, q WHERE live ORDER BY (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT, id LIMIT 20")
def c2(spark, d):
    return rounded(search.top_k(records(spark, d), vector_of(spark, d, 11), 20, strategy=search.INT8))


@query("k4_search_rows", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 5) SELECT id, {DIST.format(a='q', b='vector')} AS distance FROM rec, q WHERE live AND user_id = 3 ORDER BY (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT, id LIMIT 10")
def k4(spark, d):
    r = records(spark, d)
    return rounded(search.search_rows(r, eligible(r, Filter(3)).select("slot"), vector_of(spark, d, 5), 10, Filter(3)))


STATED = "vec_id % 50 = 0"
"""The stated set of queries: every row whose id is divisible by 50, against all rows."""


@query("k7_batch_topk", _batch("true", 10, STATED))
def k7(spark, d):
    return rounded(search.batch_top_k(records(spark, d), _queries(spark, d, STATED), 10))


@query("k9_few_eligible", _batch("user_id = 7", 64, STATED))
def k9(spark, d):
    return rounded(search.batch_top_k(records(spark, d), _queries(spark, d, STATED), 64, Filter(7)))


@query("k10_int8_batch_topk", _batch("true", 10, STATED))
def k10(spark, d):
    return rounded(search.batch_top_k(records(spark, d), _queries(spark, d, STATED), 10, strategy=search.INT8))


@query("k15_oracle_topk", f"""{RECORDS}, q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT id, embedding AS e FROM rec JOIN embeddings ON vec_id = id WHERE live),
  sc AS (SELECT query_id, id, 1 - greatest(-1, least(1, list_inner_product(q::DOUBLE[], e::DOUBLE[]) / (sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[]))))) AS d FROM r, q),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM sc) SELECT query_id, id, CAST(rank AS INT) AS rank, round(d, 6) + 0.0 AS distance FROM rk WHERE rank <= 10""")
def k15(spark, d):
    e = table(spark, d, "embeddings")
    given = [(r[0], list(r[1])) for r in e.where(STATED).select("vec_id", "embedding").collect()]
    rows = e.join(meta(spark, d).where("live"), F.col("vec_id") == F.col("id")).select("id", F.col("embedding").alias("vector"))
    return search.oracle_top_k(rows, given, 10).withColumn("distance", F.round("distance", 6) + 0.0)


@query("k17_enriched_hits", f"{RECORDS}, q AS (SELECT v AS q FROM units WHERE vec_id = 3), h AS (SELECT id, (1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT AS d FROM rec, q WHERE live ORDER BY d, id LIMIT 10) SELECT rec.id, user_id, timestamp, round(greatest(-1.0, least(1.0, CAST(1 - d AS DOUBLE))), 5) AS similarity FROM h JOIN rec USING (id)")
def k17(spark, d):
    r = records(spark, d)
    hits = search.top_k(r, vector_of(spark, d, 3), 10)
    return search.enrich(hits, r).select("id", "user_id", "timestamp", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


@query("k18_filtered_batch", _batch(f"timestamp >= {LOW} AND timestamp < {HIGH}", 5, "vec_id % 50 = 0"))
def k18(spark, d):
    return rounded(search.batch_top_k(records(spark, d), _queries(spark, d, "vec_id % 50 = 0"), 5, WINDOW))


@query("s1_normalize", f"WITH {UNITS} SELECT vec_id, round(CAST(v[1] AS DOUBLE), 6) AS first, round(list_inner_product(v::DOUBLE[], v::DOUBLE[]), 6) AS square, len(v) AS dimension FROM units")
def s1(spark, d):
    u = units(spark, d)
    return u.select("vec_id", F.round(F.element_at("v", 1).cast("double"), 6).alias("first"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("square"), F.size("v").cast("long").alias("dimension"))


@query("s2_stored_unit", f"WITH {UNITS} SELECT label, count(*) AS n, count(*) FILTER (abs(list_inner_product(v::DOUBLE[], v::DOUBLE[]) - 1) <= 1e-5) AS good FROM units GROUP BY label")
def s2(spark, d):
    return units(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.is_unit(F.col("v"))).alias("good"))


CODES = f"""WITH {UNITS}, c AS (SELECT vec_id, v, (list_max(list_transform(v, lambda x: abs(x))) / 127::FLOAT)::FLOAT AS scale FROM units),
  k AS (SELECT vec_id, v, scale, list_transform(v, lambda x: CAST(round((x / scale)::FLOAT) AS INT)) AS codes FROM c)"""


@query("s9_codes", f"{CODES} SELECT vec_id, round(CAST(scale AS DOUBLE), 8) AS scale, CAST(list_sum(codes) AS BIGINT) AS total, CAST(list_sum(list_transform(codes, lambda x: abs(x))) AS BIGINT) AS magnitude FROM k")
def s9(spark, d):
    c = V.with_codes(units(spark, d), "vec_id", "v")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y.cast("long"))
    return c.select("vec_id", F.round(F.col("scale").cast("double"), 8).alias("scale"), total(F.col("codes")).alias("total"), total(F.transform("codes", lambda x: F.abs(x.cast("int")))).alias("magnitude"))


@query("s10_approximate_dot", f"{CODES}, q AS (SELECT codes AS cq, scale AS sq FROM k WHERE vec_id = 0) SELECT vec_id, CAST(list_inner_product(cq::DOUBLE[], codes::DOUBLE[]) AS BIGINT) AS code_dot, round(CAST(sq AS DOUBLE) * CAST(scale AS DOUBLE) * list_inner_product(cq::DOUBLE[], codes::DOUBLE[]), 5) AS approximate FROM k, q")
def s10(spark, d):
    c = V.with_codes(units(spark, d), "vec_id", "v").withColumn("scale", F.col("scale").cast("double"))
    q = F.broadcast(c.where("vec_id = 0").select(F.col("scale").alias("sq"), F.col("codes").alias("cq")))
    return c.join(q).select("vec_id", V.code_dot(F.col("cq"), F.col("codes")).cast("long").alias("code_dot"), F.round(F.col("sq") * F.col("scale") * V.code_dot(F.col("cq"), F.col("codes")), 5).alias("approximate"))


@query("f1_user", f"{META} SELECT id, slot FROM rec WHERE live AND user_id = 3")
def f1(spark, d):
    return eligible(meta(spark, d), Filter(3)).select("id", "slot")


@query("f2_time_range", f"{META} SELECT id, timestamp FROM rec WHERE live AND timestamp >= {LOW} AND timestamp < {HIGH}")
def f2(spark, d):
    return eligible(meta(spark, d), WINDOW).select("id", "timestamp")


@query("f3_conjunction", f"{META} SELECT id FROM rec WHERE live AND user_id = 5 AND timestamp >= {LOW} AND timestamp < {HIGH}")
def f3(spark, d):
    return eligible(meta(spark, d), Filter(5, LOW, HIGH)).select("id")


@query("f5_empty_range", f"{META} SELECT id FROM rec WHERE false")
def f5(spark, d):
    return eligible(meta(spark, d), Filter(None, HIGH, LOW)).select("id")


@query("f7_slots_in_order", f"{META} SELECT slot, id, row_number() OVER (ORDER BY slot) AS position FROM rec WHERE live AND user_id = 9")
def f7(spark, d):
    rows = eligible(meta(spark, d), Filter(9)).select("slot", "id", F.col("slot").alias("seq"))
    return mutations.with_slots(rows.withColumnRenamed("slot", "own"), 1).select(F.col("own").alias("slot"), "id", F.col("slot").alias("position"))


@query("f9_counts", f"{META} SELECT user_id, count(*) FILTER (live) AS eligible, count(*) AS n FROM rec GROUP BY user_id")
def f9(spark, d):
    return meta(spark, d).groupBy("user_id").agg(F.count_if("live").alias("eligible"), F.count("*").alias("n"))


@query("f11_stale_plan", f"{META} SELECT slot FROM rec WHERE user_id = 4 AND NOT live")
def f11(spark, d):
    m = meta(spark, d)
    return unmatched(m.where("user_id = 4").select("slot"), m, Filter(4))


@query("f13_candidate_semi_join", f"{META} SELECT c.event_id AS id FROM events c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM rec WHERE rec.id = c.event_id AND live AND timestamp >= {LOW} AND timestamp < {HIGH})")
def f13(spark, d):
    c = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"))
    return c.join(eligible(meta(spark, d), WINDOW).select("id"), "id", "left_semi")


@query("f17_workload_bound", f"{META}, b AS (SELECT timestamp AS upper FROM rec ORDER BY timestamp, id OFFSET 100 LIMIT 1) SELECT upper, (SELECT count(*) FROM rec WHERE timestamp < upper) AS eligible FROM b")
def f17(spark, d):
    m = meta(spark, d)
    bound = m.select("timestamp", "id").orderBy("timestamp", "id").offset(100).limit(1).select(F.col("timestamp").alias("upper"))
    return m.join(F.broadcast(bound), F.col("timestamp") < F.col("upper"), "right").groupBy("upper").agg(F.count("id").alias("eligible"))


@query("r1_point_read", f"{META} SELECT * FROM rec WHERE id = 14")
def r1(spark, d):
    return meta(spark, d).where("id = 14")


@query("r4_page_filtered", f"{META} SELECT id, user_id, slot FROM rec WHERE live AND timestamp >= {LOW} ORDER BY slot LIMIT 50 OFFSET 25")
def r4(spark, d):
    return page(meta(spark, d), 25, 50, Filter(None, LOW))[0].select("id", "user_id", "slot")


@query("r4_page_all", f"{META} SELECT id, live, slot FROM rec ORDER BY slot LIMIT 50 OFFSET 100")
def r4b(spark, d):
    return page(meta(spark, d), 100, 50, None)[0].select("id", "live", "slot")


@query("r8_stats", f"{META} SELECT count(*) AS rows, count(*) FILTER (live) AS live_rows, count(*) FILTER (NOT live) AS tombstones, max(slot) AS last_slot FROM rec")
def r8(spark, d):
    return meta(spark, d).agg(F.count("*").alias("rows"), F.count_if("live").alias("live_rows"), F.count_if(~F.col("live")).alias("tombstones"), F.max("slot").alias("last_slot"))


@query("j1_hits_to_records", f"{META} SELECT id, user_id, timestamp FROM rec WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def j1(spark, d):
    hits = table(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("id"))
    return meta(spark, d).join(hits, "id").select("id", "user_id", "timestamp")


LOG = """WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 2 THEN 'delete' ELSE 'add' END AS op, (event_id // 3) * 2 + CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 3 END AS id,
  user_id, epoch_us(ts) AS timestamp FROM events)"""


def _log(spark, d):
    m = meta(spark, d)
    third = F.col("id") % 3
    return m.select(F.col("id").alias("seq"), F.when(third == 2, mutations.DELETE).otherwise(mutations.ADD).alias("op"), (F.floor(F.col("id") / 3) * 2 + F.when(third == 2, 0).otherwise(third)).alias("id"), "user_id", "timestamp")


@query("m6_state_machine", f"""{LOG}, bad AS (SELECT seq, op, CASE WHEN seq % 11 = 0 THEN id + 2 ELSE id END AS id FROM log),
  c AS (SELECT *, coalesce(sum(CASE WHEN op = 'add' THEN 1 ELSE 0 END) OVER w, 0) AS adds, coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER w, 0) AS dels FROM bad WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT seq, id, op, CASE WHEN op = 'add' AND adds > 0 THEN 'DuplicateId' WHEN op = 'delete' AND adds = 0 THEN 'UnknownId' WHEN op = 'delete' AND dels > 0 THEN 'AlreadyDeleted' END AS error FROM c""")
def m6(spark, d):
    batch = _log(spark, d).select("seq", "op", F.when(F.col("seq") % 11 == 0, F.col("id") + 2).otherwise(F.col("id")).alias("id"))
    return mutations.judged(batch, spark.createDataFrame([], "id long, live boolean")).select("seq", "id", "op", "error")


@query("m8_current_state", f"{LOG} SELECT id, bool_and(op = 'add') AS live, max(CASE WHEN op = 'add' THEN user_id END) AS user_id, max(CASE WHEN op = 'add' THEN timestamp END) AS timestamp FROM log GROUP BY id")
def m8(spark, d):
    return mutations.current(_log(spark, d)).select("id", "live", "user_id", "timestamp")


@query("m7_dense_slots", f"{LOG} SELECT id, row_number() OVER (ORDER BY seq) + 99 AS slot FROM log WHERE op = 'add'")
def m7(spark, d):
    return mutations.with_slots(_log(spark, d).where("op = 'add'").select("seq", "id"), 100).select("id", "slot")


@query("c4_nearest_list", f"WITH {UNITS}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list, v AS cv FROM units WHERE vec_id < 8) SELECT vec_id, CAST(arg_min(list, (-list_inner_product(v::DOUBLE[], cv::DOUBLE[]), list)) AS INT) AS list FROM units, c GROUP BY vec_id")
def c4(spark, d):
    import numpy as np

    u = units(spark, d)
    c = np.array([r[0] for r in u.where("vec_id < 8").orderBy("vec_id").select("v").collect()], np.float32)
    return ivf.with_lists(u.select("vec_id", "v"), c, "v").select("vec_id", "list")


LISTS, TARGET = 8, 0.95


def _unit_queries(spark, d, condition):
    return units(spark, d).where(condition).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))


def _ivf(spark, d, nprobe=None, **options):
    """Without nprobe: the least that reaches TARGET for other queries than the stated ones."""
    r = records(spark, d)
    index = ivf.build(r, LISTS)
    nprobe = nprobe or ivf.tune(ivf.recalls(index, r, _unit_queries(spark, d, "vec_id % 50 = 25"), 10, range(1, LISTS + 1)), TARGET)
    return rounded(ivf.search(index, r, _unit_queries(spark, d, STATED), 10, nprobe, **options))


@query("c6_ivf_flat_all_lists", _batch("true", 10, STATED))
def c6(spark, d):
    return _ivf(spark, d, nprobe=8)


@query("c5_ivf_flat_probe")
def c5(spark, d):
    return _ivf(spark, d)


@query("c7_ivf_codes")
def c7(spark, d):
    return _ivf(spark, d, codes=True)


@query("c8_ivf_batch_union")
def c8(spark, d):
    return _ivf(spark, d, union=True)


@query("c7_ivf_codes_all_lists", _batch("true", 10, STATED))
def c7b(spark, d):
    return _ivf(spark, d, nprobe=8, codes=True)


@query("c13_recall_by_effort")
def c13(spark, d):
    """Recall of the stated queries by the number of probed lists; all lists must give 1."""
    r = records(spark, d)
    return spark.createDataFrame(sorted(ivf.recalls(ivf.build(r, LISTS), r, _unit_queries(spark, d, STATED), 10, range(1, LISTS + 1)).items()), "nprobe int, recall double")
