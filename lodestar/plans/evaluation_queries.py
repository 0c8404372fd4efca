"""Queries of the evaluation layer: aggregates, joins, set operations, windows, gates. Events stand in for samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import evaluation as E
from lodestar.plans.registry import META, SAMPLES, UNITS, meta, query, samples, table, units


@query("a1_counts", f"{META} SELECT count(*) AS total, count(*) FILTER (live) AS live, count(*) FILTER (live AND user_id < 10) AS eligible FROM rec")
def a1(spark, d):
    return meta(spark, d).agg(F.count("*").alias("total"), F.count_if("live").alias("live"), F.count_if(F.col("live") & (F.col("user_id") < 10)).alias("eligible"))


TRUTH = """WITH t AS (SELECT user_id AS q, list(DISTINCT event_id % 16) AS truth FROM events WHERE event_type = 'click' GROUP BY user_id),
  a AS (SELECT user_id AS q, list(DISTINCT event_id % 16) AS actual FROM events WHERE event_type <> 'click' GROUP BY user_id)"""


def _truth(spark, d):
    """truth and actual of each user."""
    e = table(spark, d, "events")
    ids = F.collect_set(F.col("event_id") % 16)
    t = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("q")).agg(ids.alias("truth"))
    a = e.where("event_type <> 'click'").groupBy(F.col("user_id").alias("q")).agg(ids.alias("actual"))
    return t.join(a, "q")


@query("a2_recall", f"{TRUTH} SELECT q, CASE WHEN len(truth) = 0 THEN 1.0 ELSE round(len(list_intersect(truth, actual)) / len(truth), 9) END AS recall FROM t JOIN a USING (q)")
def a2(spark, d):
    return _truth(spark, d).select("q", F.round(E.recall(F.col("truth"), F.col("actual")), 9).alias("recall"))


@query("a3_a4_mean_and_pooled_recall", f"{TRUTH} SELECT round(avg(len(list_intersect(truth, actual)) / len(truth)), 9) AS mean, round(min(len(list_intersect(truth, actual)) / len(truth)), 9) AS least, round(sum(len(list_intersect(truth, actual))) / sum(len(truth)), 9) AS pooled FROM t JOIN a USING (q)")
def a3(spark, d):
    r = _truth(spark, d).select(E.recall(F.col("truth"), F.col("actual")).alias("r"), F.size(F.array_intersect("truth", "actual")).alias("c"), F.size("truth").alias("n"))
    return r.agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.min("r"), 9).alias("least"), F.round(F.sum("c") / F.sum("n"), 9).alias("pooled"))


@query("a5_a6_nearest_rank", f"{SAMPLES} SELECT run, engine, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99, count(*) AS n FROM s GROUP BY run, engine")
def a5(spark, d):
    return samples(spark, d).groupBy("run", "engine").agg(E.lower_median("ns").alias("p50"), E.disc("ns", 0.95).alias("p95"), E.disc("ns", 0.99).alias("p99"), F.count("*").alias("n"))


@query("a6_median_of_run_p95", f"{SAMPLES}, r AS (SELECT engine, run, quantile_disc(ns, 0.95) AS p95 FROM s GROUP BY engine, run) SELECT engine, quantile_disc(p95, 0.5) AS p95 FROM r GROUP BY engine")
def a6(spark, d):
    runs = samples(spark, d).groupBy("engine", "run").agg(E.disc("ns", 0.95).alias("p95"))
    return runs.groupBy("engine").agg(E.lower_median("p95").alias("p95"))


@query("a7_a8_interpolated", f"{SAMPLES} SELECT engine, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM s GROUP BY engine")
def a7(spark, d):
    return samples(spark, d).groupBy("engine").agg(F.round(F.median("value"), 6).alias("median"), F.round(E.cont("value", 0.9), 6).alias("p90"))


@query("a9_lab_percentile", f"{SAMPLES} SELECT engine, run, list_sort(list(ns))[CAST(ceil((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM s GROUP BY engine, run")
def a9(spark, d):
    return samples(spark, d).groupBy("engine", "run").agg(E.lab_percentile("ns", 0.95).alias("p95"))


@query("a11_qps", f"{SAMPLES} SELECT run, round(count(*) / (sum(ns) / 1e9), 6) AS qps, round(1e9 / avg(ns), 6) AS qps_of_mean FROM s GROUP BY run")
def a11(spark, d):
    return samples(spark, d).groupBy("run").agg(F.round(F.count("*") / (F.sum("ns") / 1e9), 6).alias("qps"), F.round(1e9 / F.avg("ns"), 6).alias("qps_of_mean"))


@query("a12_group_stats", f"{SAMPLES} SELECT run, engine, min(ns) AS least, max(ns) AS most, round(max(ns) / greatest(min(ns), 1), 6) AS spread, count(*) AS n FROM s GROUP BY run, engine")
def a12(spark, d):
    return samples(spark, d).groupBy("run", "engine").agg(F.min("ns").alias("least"), F.max("ns").alias("most"), F.round(F.max("ns") / F.greatest(F.min("ns"), F.lit(1)), 6).alias("spread"), F.count("*").alias("n"))


@query("a13_a14_conditional", f"{SAMPLES} SELECT run, count(*) FILTER (value > 50) AS slow, bool_and(ns >= 0) AS valid, bool_or(value > 99) AS outlier FROM s GROUP BY run")
def a13(spark, d):
    return samples(spark, d).groupBy("run").agg(F.count_if(F.col("value") > 50).alias("slow"), F.bool_and(F.col("ns") >= 0).alias("valid"), F.bool_or(F.col("value") > 99).alias("outlier"))


@query("a15_one_value_or_mixed", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END AS kind FROM events GROUP BY user_id")
def a15(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.count_distinct("event_type") == 1, F.min("event_type")).otherwise("mixed").alias("kind"))


@query("a16_value_counts", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def a16(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))


@query("a17_joined_set", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS kinds FROM events GROUP BY user_id")
def a17(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("kinds"))


@query("a18_a19_agreement", "SELECT event_id // 4 AS batch, CASE WHEN min(user_id % 2) = max(user_id % 2) THEN min(user_id % 2) END AS agreed, CASE WHEN count(nullif(user_id % 5, 0)) = count(*) THEN max(nullif(user_id % 5, 0)) END AS most FROM events GROUP BY 1")
def a18(spark, d):
    e = table(spark, d, "events")
    missing = F.nullif(F.col("user_id") % 5, F.lit(0))
    return e.groupBy(F.floor(F.col("event_id") / 4).alias("batch")).agg(E.agreed(F.col("user_id") % 2).alias("agreed"), E.all_or_missing(missing, F.max).alias("most"))


@query("a20_log_ratios", f"{SAMPLES} SELECT engine, round(stddev_samp(ln(value + 1)), 6) AS deviation, round(max(ln(value + 1)) - min(ln(value + 1)), 6) AS spread, round(exp(avg(ln(value + 1))), 6) AS geometric FROM s GROUP BY engine")
def a20(spark, d):
    x = F.log(F.col("value") + 1)
    return samples(spark, d).groupBy("engine").agg(F.round(F.stddev_samp(x), 6).alias("deviation"), F.round(F.max(x) - F.min(x), 6).alias("spread"), F.round(F.exp(F.avg(x)), 6).alias("geometric"))


@query("a21_spearman", f"{SAMPLES}, x AS (SELECT engine, ns // 5000 AS a, id % 37 AS b FROM s), r AS (SELECT engine, rank() OVER (PARTITION BY engine ORDER BY a) + (count(*) OVER (PARTITION BY engine, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY engine ORDER BY b) + (count(*) OVER (PARTITION BY engine, b) - 1) / 2 AS rb FROM x) SELECT engine, round(corr(ra, rb), 6) AS rho FROM r GROUP BY engine")
def a21(spark, d):
    x = samples(spark, d).select("engine", F.floor(F.col("ns") / 5000).alias("a"), (F.col("id") % 37).alias("b"))
    r = E.average_rank(E.average_rank(x, "a", "ra", ["engine"]), "b", "rb", ["engine"])
    return r.groupBy("engine").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query("a26_contiguous_runs", f"{META}, r AS (SELECT slot, slot - lag(slot) OVER (ORDER BY slot) AS gap FROM rec WHERE live) SELECT count(*) FILTER (gap IS NULL OR gap <> 1) AS runs FROM r")
def a26(spark, d):
    return E.contiguous_runs(meta(spark, d).where("live"))


@query("a27_selectivity", f"{META} SELECT user_id % 10 AS part, round(count(*) FILTER (live) / count(*), 9) AS share FROM rec GROUP BY 1")
def a27(spark, d):
    return meta(spark, d).groupBy((F.col("user_id") % 10).alias("part")).agg(F.round(F.count_if("live") / F.count("*"), 9).alias("share"))


@query("a28_corpus_audit", "SELECT label AS split, count(*) AS n, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x)))) AS bad, count(*) - count(DISTINCT embedding) AS copies, round(quantile_cont(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0.5), 5) AS norm FROM embeddings GROUP BY label")
def a28(spark, d):
    from lodestar.functions import vectors as V

    e = table(spark, d, "embeddings").select("label", "embedding", V.norm(F.col("embedding")).alias("length"))
    digest = F.sha2(F.to_json("embedding"), 256)
    return e.groupBy(F.col("label").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.exists("embedding", F.isnan)).alias("bad"), (F.count("*") - F.count_distinct(digest)).alias("copies"), F.round(E.cont("length", 0.5), 5).alias("norm"))


@query("a30_concordance", f"{SAMPLES}, c AS (SELECT engine, run, sum(value) AS x, count(*) AS y FROM s GROUP BY engine, run) SELECT a.engine, count(*) FILTER ((a.x - b.x) * (a.y - b.y) > 0) AS concordant, count(*) AS pairs FROM c a JOIN c b ON a.engine = b.engine AND a.run < b.run GROUP BY a.engine")
def a30(spark, d):
    c = samples(spark, d).groupBy("engine", "run").agg(F.sum("value").alias("x"), F.count("*").alias("y"))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.engine") == F.col("b.engine")) & (F.col("a.run") < F.col("b.run")))
    return j.groupBy(F.col("a.engine").alias("engine")).agg(F.count_if((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y")) > 0).alias("concordant"), F.count("*").alias("pairs"))


@query("a31_shape", f"{SAMPLES}, m AS (SELECT engine, value, avg(value) OVER (PARTITION BY engine) AS mu FROM s) SELECT engine, round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5), 5) AS skew, round(avg(power(value - mu, 4)) / power(avg(power(value - mu, 2)), 2) - 3, 5) AS kurtosis FROM m GROUP BY engine")
def a31(spark, d):
    return samples(spark, d).groupBy("engine").agg(F.round(F.skewness("value"), 5).alias("skew"), F.round(F.kurtosis("value"), 5).alias("kurtosis"))


@query("j2_truth_to_responses", f"{TRUTH} SELECT q, CAST(len(truth) AS BIGINT) AS wanted, CAST(len(actual) AS BIGINT) AS got FROM t JOIN a USING (q)")
def j2(spark, d):
    return _truth(spark, d).select("q", F.size("truth").cast("long").alias("wanted"), F.size("actual").cast("long").alias("got"))


@query("j3_row_equality", "SELECT event_id FROM events WHERE event_id % 50 = 7")
def j3(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    other = e.withColumn("user_id", F.when(F.col("event_id") % 50 == 7, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return e.exceptAll(other).select("event_id")


@query("j4_invalid_results", f"{META}, h AS (SELECT vec_id AS id FROM embeddings) SELECT id FROM h WHERE id NOT IN (SELECT id FROM rec WHERE live AND user_id < 100)")
def j4(spark, d):
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return h.join(meta(spark, d).where("live and user_id < 100").select("id"), "id", "left_anti")


ARMS = f"{SAMPLES}, p AS (SELECT run, id % 7 AS cell, quantile_disc(ns, 0.95) FILTER (engine = 'click') AS cpu, quantile_disc(ns, 0.95) FILTER (engine = 'view') AS gpu FROM s GROUP BY run, id % 7)"


def _arms(spark, d):
    s = samples(spark, d).where("engine in ('click', 'view')").groupBy("run", (F.col("id") % 7).alias("cell"), "engine").agg(E.disc("ns", 0.95).alias("p"))
    return s.groupBy("run", "cell").pivot("engine", ["click", "view"]).agg(F.first("p")).withColumnsRenamed({"click": "cpu", "view": "gpu"})


@query("j5_paired_arms", f"{ARMS} SELECT run, cell, cpu, gpu, round(cpu / gpu, 6) AS ratio FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL")
def j5(spark, d):
    return _arms(spark, d).dropna().withColumn("ratio", F.round(F.col("cpu") / F.col("gpu"), 6))


@query("w12_regret", f"{ARMS} SELECT run, cell, round((CASE WHEN cell < 3 THEN cpu ELSE gpu END) / least(cpu, gpu) - 1, 6) AS regret FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL")
def w12(spark, d):
    a = _arms(spark, d).dropna()
    return a.select("run", "cell", F.round(E.regret(F.when(F.col("cell") < 3, F.col("cpu")).otherwise(F.col("gpu")), F.col("cpu"), F.col("gpu")), 6).alias("regret"))


@query("w13_gate", f"{ARMS}, r AS (SELECT run, (CASE WHEN cell < 3 THEN cpu ELSE gpu END) / least(cpu, gpu) - 1 AS regret FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL) SELECT run, median(regret) <= 0.10 AND max(regret) <= 0.25 AS passed, count(*) FILTER (regret > 0) AS wrong FROM r GROUP BY run")
def w13(spark, d):
    a = _arms(spark, d).dropna().withColumn("r", E.regret(F.when(F.col("cell") < 3, F.col("cpu")).otherwise(F.col("gpu")), F.col("cpu"), F.col("gpu")))
    return a.groupBy("run").agg(((F.median("r") <= 0.10) & (F.max("r") <= 0.25)).alias("passed"), F.count_if(F.col("r") > 0).alias("wrong"))


@query("j10_theta_join", f"{ARMS}, w AS (SELECT run, cell, cpu < gpu AS cpu_wins FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL) SELECT g.run, g.cell AS low, c.cell AS high FROM w g JOIN w c ON g.run = c.run AND g.cell <= c.cell WHERE NOT g.cpu_wins AND c.cpu_wins")
def j10(spark, d):
    w = _arms(spark, d).dropna().select("run", "cell", (F.col("cpu") < F.col("gpu")).alias("cpu_wins"))
    low, high = w.where("not cpu_wins").select("run", F.col("cell").alias("low")), w.where("cpu_wins").select("run", F.col("cell").alias("high"))
    return low.join(high, "run").where("low <= high").select("run", "low", "high")


@query("j11_deficit_to_best", f"{SAMPLES}, g AS (SELECT run, engine, sum(ns) AS t FROM s GROUP BY run, engine) SELECT run, engine, round(t / min(t) OVER (PARTITION BY run), 6) AS deficit FROM g")
def j11(spark, d):
    g = samples(spark, d).groupBy("run", "engine").agg(F.sum("ns").alias("t"))
    return g.select("run", "engine", F.round(F.col("t") / F.min("t").over(Window.partitionBy("run")), 6).alias("deficit"))


@query("j13_missing_statuses", "SELECT c_custkey AS key, 'missing' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'present' FROM orders")
def j13(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return c.join(o, "key", "left_anti").withColumn("status", F.lit("missing")).unionByName(o.withColumn("status", F.lit("present")))


@query("x1_union_all", "SELECT event_id AS id FROM events WHERE user_id = 1 UNION ALL SELECT vec_id FROM embeddings WHERE label = 1")
def x1(spark, d):
    return table(spark, d, "events").where("user_id = 1").select(F.col("event_id").alias("id")).unionByName(table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id")))


@query("x2_intersection", "SELECT event_id AS id FROM events INTERSECT SELECT vec_id FROM embeddings")
def x2(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id")).intersect(table(spark, d, "embeddings").select("vec_id"))


@query("x3_difference", "SELECT vec_id AS id FROM embeddings EXCEPT SELECT event_id FROM events WHERE event_type <> 'click'")
def x3(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).subtract(table(spark, d, "events").where("event_type <> 'click'").select("event_id"))


@query("x5_content_copies", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS canonical FROM events")
def x5(spark, d):
    e = table(spark, d, "events").withColumn("digest", F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256))
    first = e.groupBy("digest").agg(F.min("event_id").alias("canonical"))
    return e.join(first, "digest").select("event_id", "canonical")


@query("w1_metadata_by_component", f"WITH {UNITS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY v[1], vec_id) - 1 AS rank, count(*) OVER () AS n FROM units) SELECT vec_id, rank, CAST(floor(rank * 100 / n) AS BIGINT) AS owner, rank - n // 2 AS time FROM r")
def w1(spark, d):
    u = units(spark, d).select("vec_id", F.element_at("v", 1).alias("x"))
    return _assigned(u, "x", lambda rank, n: F.floor(rank * 100 / n), lambda rank, n: rank - F.floor(n / 2))


def _assigned(u, score, owner, time, falling=False):
    """vec_id, rank, owner, time: rows ranked by a score, then id, by ranges of the score, so no task holds all."""
    n = F.lit(u.count())
    ranked = E.global_rank(u, score, "vec_id", "rank", falling)
    return ranked.select("vec_id", "rank", owner(F.col("rank"), n).cast("long").alias("owner"), time(F.col("rank"), n).cast("long").alias("time"))


@query("w1_metadata_negative", f"WITH {UNITS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY v[1] DESC, vec_id) - 1 AS rank, count(*) OVER () AS n FROM units) SELECT vec_id, rank, CAST(floor(rank * 100 / n) AS BIGINT) AS owner, rank - n // 2 AS time FROM r")
def w1_negative(spark, d):
    u = units(spark, d).select("vec_id", F.element_at("v", 1).alias("x"))
    return _assigned(u, "x", lambda rank, n: F.floor(rank * 100 / n), lambda rank, n: rank - F.floor(n / 2), falling=True)


@query("w1_metadata_skewed", f"WITH {UNITS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY 0.2 * v[1]::DOUBLE + v[2]::DOUBLE * v[2]::DOUBLE * v[2]::DOUBLE, vec_id) - 1 AS rank, count(*) OVER () AS n FROM units) SELECT vec_id, rank, CASE WHEN rank * 10 < n * 9 THEN 0 ELSE 1 + rank % 99 END AS owner, CAST(floor((rank / n) * (rank / n) * (rank / n) * 1e12) AS BIGINT) + rank - n // 2 AS time FROM r")
def w1_skewed(spark, d):
    x, y = (F.element_at("v", i).cast("double") for i in (1, 2))
    u = units(spark, d).select("vec_id", (F.lit(0.2) * x + y * y * y).alias("x"))
    time = lambda rank, n: F.floor((rank / n) * (rank / n) * (rank / n) * 1e12) + rank - F.floor(n / 2)
    return _assigned(u, "x", lambda rank, n: F.when(rank * 10 < n * 9, 0).otherwise(1 + rank % 99), time)


@query("w4_batches", "SELECT event_id // 64 AS batch, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def w4(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 64).alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("w5_splits", "SELECT CASE WHEN event_id < 7000 THEN 'corpus' WHEN event_id < 8500 THEN 'tuning' ELSE 'evaluation' END AS split, count(*) AS n FROM events GROUP BY 1")
def w5(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").groupBy(F.when(i < 7000, "corpus").when(i < 8500, "tuning").otherwise("evaluation").alias("split")).agg(F.count("*").alias("n"))


@query("w6_order_check", f"{SAMPLES}, o AS (SELECT run, ns < lag(ns) OVER (PARTITION BY run ORDER BY id) AS falls FROM s) SELECT run, count(*) FILTER (falls) AS falls FROM o GROUP BY run")
def w6(spark, d):
    falls = F.col("ns") < F.lag("ns").over(Window.partitionBy("run").orderBy("id"))
    return samples(spark, d).withColumn("falls", falls).groupBy("run").agg(F.count_if("falls").alias("falls"))


@query("w8_drift", f"{SAMPLES}, r AS (SELECT engine, run, quantile_disc(ns, 0.5) AS p FROM s GROUP BY engine, run) SELECT engine, round(arg_max(p, run) / arg_min(p, run), 6) AS drift, round(max(p) / min(p), 6) AS spread FROM r GROUP BY engine")
def w8(spark, d):
    r = samples(spark, d).groupBy("engine", "run").agg(E.lower_median("ns").alias("p"))
    return r.groupBy("engine").agg(F.round(F.max_by("p", "run") / F.min_by("p", "run"), 6).alias("drift"), F.round(F.max("p") / F.min("p"), 6).alias("spread"))


@query("w9_latest_payloads", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def w9(spark, d):
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("w11_invalid_payloads", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) NOT BETWEEN 5 AND 90")
def w11(spark, d):
    k = F.from_json("props", "k long", {"mode": "FAILFAST"})["k"]
    return table(spark, d, "events").where(~k.between(5, 90) | (F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))) > 0)).select("event_id")


@query("w16_tail_table", f"{SAMPLES} SELECT engine, quantile_disc(ns, 0.5) AS median, list_sort(list(ns))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90, round(avg(CASE WHEN value > 75 THEN 1 ELSE 0 END), 9) AS above FROM s GROUP BY engine")
def w16(spark, d):
    p90 = F.expr("element_at(sort_array(collect_list(ns)), cast(floor((count(ns) - 1) * 0.9) as int) + 1)")
    return samples(spark, d).groupBy("engine").agg(E.lower_median("ns").alias("median"), p90.alias("p90"), F.round(F.avg((F.col("value") > 75).cast("int")), 9).alias("above"))


@query("w20_ordered_case", "SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def w20(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").groupBy(F.when(t.contains("STEEL"), "steel").when(t.contains("BRASS"), "brass").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query("s20_id_lists", "SELECT user_id, array_to_string(list_sort(list(event_id)), ';') AS ids, CAST(list_sum(list_transform(string_split(array_to_string(list(event_id), ';'), ';'), lambda x: x::BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def s20(spark, d):
    ids = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ";").alias("ids"))
    return ids.withColumn("total", F.aggregate(F.transform(F.split("ids", ";"), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))


@query("s23_first_present", "SELECT event_id, coalesce(nullif(event_type, 'click'), nullif(CAST(user_id AS VARCHAR), '0'), 'none') AS first FROM events")
def s23(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.nullif(F.col("user_id").cast("string"), F.lit("0")), F.lit("none")).alias("first"))


@query("e2_tie_compatible", f"{SAMPLES}, b AS (SELECT run, engine, list_sort(list(value))[3] AS boundary, list_slice(list_sort(list(value)), 1, 3) AS got FROM s GROUP BY run, engine) SELECT run, engine, len(got) = 3 AND list_bool_and(list_transform(got, lambda x: x <= boundary + 1e-5)) AS compatible FROM b")
def e2(spark, d):
    b = samples(spark, d).groupBy("run", "engine").agg(F.sort_array(F.collect_list("value")).alias("v")).select("run", "engine", F.get("v", 2).alias("boundary"), F.slice("v", 1, 3).alias("got"))
    return b.select("run", "engine", E.tie_compatible(F.col("got"), F.col("boundary"), F.lit(3), 1e-5).alias("compatible"))


@query("a22_bootstrap")
def a22(spark, d):
    """The ratio of two arms' lower medians of runs' 95th percentiles, and its 95% interval by 10,000 seeded draws of whole runs.

    Each cell has the same stream of random numbers.
    """
    import math
    import random

    import numpy as np
    import pandas as pd

    runs = samples(spark, d).where("engine in ('click', 'view')").groupBy((F.col("id") % 5).alias("cell"), "engine", "run").agg(E.disc("ns", 0.95).alias("p"))

    def lower_median(values: list) -> float:
        return sorted(values)[(len(values) - 1) // 2]

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(20260828)
        own = own.sort_values("run")
        a, b = (own[own.engine == e].p.astype(float).tolist() for e in ("click", "view"))
        drawn = np.array([(lower_median(rng.choices(a, k=len(a))), lower_median(rng.choices(b, k=len(b)))) for _ in range(10_000)])
        r = np.sort(drawn[:, 0] / drawn[:, 1])
        low, high = (r[math.ceil(len(r) * q) - 1] for q in (0.025, 0.975))
        return pd.DataFrame({"cell": [own.cell.iloc[0]], "ratio": [np.float64(lower_median(a)) / lower_median(b)], "low": [low], "high": [high]})

    return runs.groupBy("cell").applyInPandas(draw, "cell long, ratio double, low double, high double")


@query("s16_generators")
def s16(spark, d):
    from lodestar.functions.generators import vectors

    return vectors(spark, 1000, 16, 42, 8)
