"""Queries of reports and gates: comparisons of runs, validation of results, thresholds, bootstraps. Events stand in for samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import evaluation as E
from lodestar.functions import vectors as V
from lodestar.functions.generators import splitmix64, uniform
from lodestar.operators import search
from lodestar.plans.evaluation_queries import ARMS, _arms
from lodestar.plans.registry import META, RECORDS, SAMPLES, meta, query, records, samples, table, units
from lodestar.plans.store_queries import STATED, _batch, _queries

MISSING_THRESHOLD = 4096
"""The threshold where no cell qualifies."""


# comparisons of paired arms
@query("a29_geometric_ratio", f"{ARMS}, r AS (SELECT cell, run, cpu / gpu AS ratio FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL) SELECT cell, round(exp(avg(ln(ratio))), 6) AS geometric, round(max(ratio), 6) AS worst, round(min(ratio), 6) AS best, count(*) AS blocks FROM r GROUP BY cell")
def a29(spark, d):
    r = _arms(spark, d).dropna().withColumn("ratio", F.col("cpu") / F.col("gpu"))
    return r.groupBy("cell").agg(F.round(F.exp(F.avg(F.log("ratio"))), 6).alias("geometric"), F.round(F.max("ratio"), 6).alias("worst"), F.round(F.min("ratio"), 6).alias("best"), F.count("*").alias("blocks"))


def draws(n: int, size: int, seed: int) -> np.ndarray:
    """n draws of size positions below size, with replacement, by SplitMix64 modulo size."""
    return (splitmix64(np.arange(n * size), seed) % np.uint64(size)).astype(np.int64).reshape(n, size)


def nearest_rank(values: np.ndarray, *shares: float) -> list[float]:
    ordered = np.sort(values)
    return [float(ordered[max(1, math.ceil(len(ordered) * q)) - 1]) for q in shares]


def lower_middle(values: np.ndarray) -> np.ndarray:
    """Of each row the value at (n - 1) // 2 of the sorted ones."""
    k = (values.shape[-1] - 1) // 2
    return np.partition(values, k, axis=-1)[..., k]


PAIRED_DRAWS = 20_000


@query("a23_paired_bootstrap")
def a23(spark, d):
    """Per cell the lower middle of the arms' differences by run, and its 95 % interval by PAIRED_DRAWS draws of pairs."""

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values("run").eval("cpu - gpu").to_numpy(float)
        low, high = nearest_rank(lower_middle(x[draws(PAIRED_DRAWS, len(x), 20260905)]), 0.025, 0.975)
        return pd.DataFrame({"cell": [own.cell.iloc[0]], "difference": [float(lower_middle(x))], "low": [low], "high": [high]})

    return _arms(spark, d).dropna().groupBy("cell").applyInPandas(draw, "cell long, difference double, low double, high double")


HIERARCHY_DRAWS = 2_000
CHUNKS = 8
"""Tasks among which the draws of a run are dealt."""
BLOCK = 1 << 17
"""Positions drawn at once, or those of one row if these are more."""


def drawn_middles(values: np.ndarray, rows: np.ndarray, seed: int) -> np.ndarray:
    """lower_middle(values[draws(n, len(values), seed)[rows]]) for any n, without making other rows or more than BLOCK positions.

    Ranks are drawn in place of values, as they are shorter.
    """
    size = np.uint64(len(values))
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    out, some = np.empty(len(rows)), max(1, BLOCK // len(values))
    for c in range(0, len(rows), some):
        z = splitmix64(rows[c : c + some, None] * len(values) + np.arange(len(values)), seed)
        z -= z // size * size  # the remainder; NumPy divides many by one faster
        out[c : c + some] = values[order[lower_middle(rank.take(z.view(np.int64)))]]
    return out


@query("a24_hierarchical_bootstrap")
def a24(spark, d):
    """Per engine the 95 % interval of the lower middle of runs' lower medians; each draw takes runs, then batches within each.

    A run's batches travel as one value to each of CHUNKS tasks, which make a share of the draws that take this run. Samples
    without a run are left out.
    """
    batches = samples(spark, d).where("run is not null").groupBy("engine", "run", F.floor(F.col("id") / 64).alias("batch")).agg(E.lower_median("ns").alias("p"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"engine": [own.engine.iloc[0]], "run": [own.run.iloc[0]], "p": [own.sort_values("batch").p.to_numpy(float).tobytes()]})

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        taken = draws(HIERARCHY_DRAWS, int(r.runs), 7)
        rows = np.flatnonzero((taken.ravel() == r.number) & (np.arange(taken.size) // r.runs % CHUNKS == r.chunk))
        return pd.DataFrame({"engine": r.engine, "runs": r.runs, "row": rows, "middle": drawn_middles(np.frombuffer(r.p), rows, 8 + int(r.number))})

    def interval(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own.runs.iloc[0])
        low, high = nearest_rank(lower_middle(own.sort_values("row").middle.to_numpy().reshape(HIERARCHY_DRAWS, n)), 0.025, 0.975)
        return pd.DataFrame({"engine": [own.engine.iloc[0]], "low": [low], "high": [high], "runs": [n]})

    runs = batches.groupBy("engine", "run").applyInPandas(pack, "engine string, run long, p binary")
    engine = Window.partitionBy("engine")
    runs = runs.withColumns({"number": F.row_number().over(engine.orderBy("run")) - 1, "runs": F.count("*").over(engine)})
    dealt = runs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    middles = dealt.groupBy("engine", "run", "chunk").applyInPandas(draw, "engine string, runs long, row long, middle double")
    return middles.groupBy("engine").applyInPandas(interval, "engine string, low double, high double, runs long")


@query("a29_block_bootstrap")
def a29b(spark, d):
    """Bounds of the geometric ratio at 95 % and 98.75 %, drawn by block (cell) within each seed (run)."""
    ratios = _arms(spark, d).dropna().withColumn("x", F.log(F.col("cpu") / F.col("gpu")))

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        total, n = np.zeros(PAIRED_DRAWS), 0
        for run, g in own.sort_values("cell").groupby("run"):
            x = g.x.to_numpy(float)
            total += x[draws(PAIRED_DRAWS, len(x), 100 + int(run))].sum(1)
            n += len(x)
        got = nearest_rank(np.exp(total / n), 0.05, 0.95, 0.0125, 0.9875)
        return pd.DataFrame([[own.half.iloc[0], *got]], columns=["half", "low95", "high95", "low98", "high98"])

    return ratios.withColumn("half", F.col("cell") % 2).groupBy("half").applyInPandas(draw, "half long, low95 double, high95 double, low98 double, high98 double")


SHAPE = f"{SAMPLES}, m AS (SELECT engine, value, avg(value) OVER (PARTITION BY engine) AS mu, count(*) OVER (PARTITION BY engine) AS n FROM s), k AS (SELECT engine, any_value(n) AS n, avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5) AS g, avg(power(value - mu, 4)) / power(avg(power(value - mu, 2)), 2) - 3 AS e, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM m GROUP BY engine)"


@query("a31_bimodality", f"{SHAPE} SELECT engine, round((g * g + 1) / (e + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 5) AS bimodality, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM k")
def a31(spark, d):
    k = samples(spark, d).groupBy("engine").agg(F.skewness("value").alias("g"), F.kurtosis("value").alias("e"), F.count("*").alias("n"), E.cont("value", 0.1).alias("p10"), E.cont("value", 0.9).alias("p90"))
    n = F.col("n")
    b = (F.col("g") * F.col("g") + 1) / (F.col("e") + F.lit(3.0) * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    return k.select("engine", F.round(b, 5).alias("bimodality"), F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("a32_recall_summary", f"{SAMPLES}, r AS (SELECT engine, id % 7 AS threshold, CASE WHEN id % 5 = 0 THEN 0.9 WHEN id % 7 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS recall FROM s) SELECT engine, threshold, count(*) AS samples, count(*) FILTER (recall >= 1 - 1e-12) AS perfect, min(recall) AS least, round(avg(recall), 9) AS mean FROM r GROUP BY engine, threshold")
def a32(spark, d):
    recall = F.when(F.col("id") % 5 == 0, 0.9).when(F.col("id") % 7 == 0, 0.5).otherwise(1.0)
    r = samples(spark, d).select("engine", (F.col("id") % 7).alias("threshold"), recall.alias("recall"))
    return r.groupBy("engine", "threshold").agg(F.count("*").alias("samples"), F.count_if(F.col("recall") >= 1 - 1e-12).alias("perfect"), F.min("recall").alias("least"), F.round(F.avg("recall"), 9).alias("mean"))


@query("a33_winners", f"{ARMS}, c AS (SELECT cell, count(*) = 5 AS complete FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL GROUP BY cell) SELECT run, p.cell, CASE WHEN cpu <= gpu THEN 'cpu' ELSE 'gpu' END AS winner, round(greatest(cpu, gpu) / least(cpu, gpu), 6) AS ratio, complete FROM p JOIN c ON p.cell = c.cell WHERE cpu IS NOT NULL AND gpu IS NOT NULL")
def a33(spark, d):
    p = _arms(spark, d).dropna()
    complete = p.groupBy("cell").agg((F.count("*") == 5).alias("complete"))
    winner = F.when(F.col("cpu") <= F.col("gpu"), "cpu").otherwise("gpu")
    return p.join(complete, "cell").select("run", "cell", winner.alias("winner"), F.round(F.greatest("cpu", "gpu") / F.least("cpu", "gpu"), 6).alias("ratio"), "complete")


@query("a34_bandwidth", f"{SAMPLES} SELECT run, engine, round(quantile_cont((id + 1) * 64 * 4 / greatest(ns, 1), 0.5), 6) AS bytes_per_ns FROM s GROUP BY run, engine")
def a34(spark, d):
    s = samples(spark, d).withColumn("b", (F.col("id") + 1) * 64 * 4 / F.greatest("ns", F.lit(1)))
    return s.groupBy("run", "engine").agg(F.round(E.cont("b", 0.5), 6).alias("bytes_per_ns"))


@query("a35_log_share", f"{SAMPLES} SELECT run, round(ln(quantile_cont(value, 0.5) FILTER (engine = 'error') / quantile_cont(value, 0.5) FILTER (engine = 'click')) / ln(quantile_cont(value, 0.9) FILTER (engine = 'view') / quantile_cont(value, 0.5) FILTER (engine = 'click')), 6) AS share FROM s GROUP BY run")
def a35(spark, d):
    s = samples(spark, d).select("run", *[F.when(F.col("engine") == e, F.col("value")).alias(e) for e in ("click", "view", "error")])
    m = s.groupBy("run").agg(E.cont("error", 0.5).alias("x"), E.cont("click", 0.5).alias("hh"), E.cont("view", 0.9).alias("ll"))
    return m.select("run", F.round(F.log(F.col("x") / F.col("hh")) / F.log(F.col("ll") / F.col("hh")), 6).alias("share"))


FINGERPRINTED = ("region", "nation", "customer", "supplier", "part", "orders", "events")


@query("a36_fingerprints", " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n, (SELECT sha256(array_to_string(json_keys(to_json(r)), ',')) FROM (SELECT * FROM {t} LIMIT 1) r) AS schema" for t in FINGERPRINTED))
def a36(spark, d):
    out = None
    for t in FINGERPRINTED:
        df = table(spark, d, t)
        row = df.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sha2(F.lit(",".join(df.columns)), 256).alias("schema"))
        out = row if out is None else out.unionByName(row)
    return out


# joins of runs
@query("j3_differences", "SELECT event_id, 'left' AS side FROM events WHERE event_id % 50 = 7 UNION ALL SELECT event_id, 'right' FROM events WHERE event_id % 50 = 7")
def j3(spark, d):
    """Rows that one of two tables has and the other hasn't, from either side."""
    e = table(spark, d, "events").select("event_id", "user_id")
    other = e.withColumn("user_id", F.when(F.col("event_id") % 50 == 7, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return e.exceptAll(other).withColumn("side", F.lit("left")).union(other.exceptAll(e).withColumn("side", F.lit("right"))).select("event_id", "side")


@query("j4_repeated_results", "SELECT user_id AS query, event_id // 3 % 50 AS id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def j4(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query"), (F.floor(F.col("event_id") / 3) % 50).alias("id"))
    return e.groupBy("query", "id").agg(F.count("*").alias("n")).where("n > 1")


CELLS = f"{SAMPLES}, c AS (SELECT run, id % 7 AS cell, engine, quantile_disc(ns, 0.95) AS p FROM s GROUP BY run, id % 7, engine)"


def _cells(spark, d):
    return samples(spark, d).groupBy("run", (F.col("id") % 7).alias("cell"), "engine").agg(E.disc("ns", 0.95).alias("p"))


@query("j6_improved_and_competitors", f"{CELLS} SELECT a.run, a.cell, b.engine AS competitor, round(b.p / a.p, 6) AS ratio FROM c a JOIN c b ON a.run = b.run AND a.cell = b.cell WHERE a.engine = 'click' AND b.engine IN ('view', 'purchase')")
def j6(spark, d):
    c = _cells(spark, d)
    own = c.where("engine = 'click'").select("run", "cell", F.col("p").alias("own"))
    other = c.where("engine in ('view', 'purchase')").withColumnRenamed("engine", "competitor")
    return own.join(other, ["run", "cell"]).select("run", "cell", "competitor", F.round(F.col("p") / F.col("own"), 6).alias("ratio"))


FIELDS = ("n", "least", "most", "kinds", "owners")


@query("j7_compatibility", f"{SAMPLES}, w AS (SELECT run, id % 7 AS cell, count(*) AS n, min(ns) // 1000 AS least, max(ns) // 100000 AS most, count(DISTINCT engine) AS kinds, nullif(count(DISTINCT owner), 3) AS owners FROM (SELECT s.*, events.user_id AS owner FROM s JOIN events ON id = event_id) GROUP BY run, id % 7) SELECT a.cell, list_filter([{', '.join(f'CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN {chr(39)}{f}{chr(39)} END' for f in FIELDS)}], lambda x: x IS NOT NULL)::VARCHAR AS mismatches FROM w a JOIN w b ON a.cell = b.cell WHERE a.run = 0 AND b.run = 1")
def j7(spark, d):
    """The workload fields in which two runs differ, nulls being equal to nulls."""
    s = table(spark, d, "events").select((F.col("user_id") % 5).alias("run"), (F.col("event_id") % 7).alias("cell"), F.col("event_type").alias("engine"), F.floor(F.col("value") * 1000).cast("long").alias("ns"), "user_id")
    w = s.groupBy("run", "cell").agg(F.count("*").alias("n"), F.floor(F.min("ns") / 1000).alias("least"), F.floor(F.max("ns") / 100000).alias("most"), F.count_distinct("engine").alias("kinds"), F.nullif(F.count_distinct("user_id"), F.lit(3)).alias("owners"))
    a, b = w.where("run = 0").alias("a"), w.where("run = 1").alias("b")
    names = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in FIELDS])
    return a.join(b, F.col("a.cell") == F.col("b.cell")).select(F.col("a.cell").alias("cell"), F.concat(F.lit("["), F.array_join(F.filter(names, lambda x: x.isNotNull()), ", "), F.lit("]")).alias("mismatches"))


@query("j8_pairs_by_seed", "WITH p AS (SELECT user_id AS seed, event_type AS arm, quantile_disc(value, 0.5) AS m FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) SELECT a.seed, round(a.m - b.m, 6) AS difference FROM p a JOIN p b ON a.seed = b.seed WHERE a.arm = 'click' AND b.arm = 'view'")
def j8(spark, d):
    p = table(spark, d, "events").where("event_type in ('click', 'view')").groupBy(F.col("user_id").alias("seed"), "event_type").agg(E.lower_median("value").alias("m"))
    a, b = (p.where(F.col("event_type") == e).select("seed", F.col("m").alias(e)) for e in ("click", "view"))
    return a.join(b, "seed").select("seed", F.round(F.col("click") - F.col("view"), 6).alias("difference"))


@query("j9_on_off_pairs", "WITH p AS (SELECT user_id % 10 AS host, event_id // 500 AS block, event_type AS engine, event_id % 2 = 0 AS heated, median(value) AS m FROM events GROUP BY ALL) SELECT host, block, engine, round(max(m) FILTER (heated) / max(m) FILTER (NOT heated), 6) AS ratio FROM p GROUP BY host, block, engine HAVING count(DISTINCT heated) = 2")
def j9(spark, d):
    """Groups with rows of both kinds. A median of zero gives an infinite ratio or NaN, as IEEE has it; one of nulls alone gives null."""
    e = table(spark, d, "events")
    on = F.col("event_id") % 2 == 0
    s = e.select((F.col("user_id") % 10).alias("host"), F.expr("event_id div 500").alias("block"), F.col("event_type").alias("engine"), F.when(on, F.col("value")).alias("on"), F.when(~on, F.col("value")).alias("off"), on.alias("heated"))
    p = s.groupBy("host", "block", "engine").agg(F.median("on").alias("on"), F.median("off").alias("off"), F.bool_or("heated").alias("some"), F.bool_and("heated").alias("all")).where("some and not all")
    ratio = F.when(F.col("off") == 0, F.col("on") * F.pow("off", F.lit(-1))).otherwise(F.col("on") / F.col("off"))
    return p.select("host", "block", "engine", F.round(ratio, 6).alias("ratio"))


SWEEP = f"{ARMS}, q AS (SELECT run, cell, cpu, gpu FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL), t AS (SELECT unnest([0.5, 1.5, 2.5, 3.5, 4.5, 5.5])::DOUBLE AS threshold), r AS (SELECT threshold, (CASE WHEN cell < threshold THEN cpu ELSE gpu END) / least(cpu, gpu) - 1 AS regret FROM q, t), g AS (SELECT threshold, round(max(regret), 9) AS most, count(*) FILTER (regret > 0) AS wrong, round(avg(regret), 9) AS mean FROM r GROUP BY threshold)"


def _sweep(spark, d):
    """Each threshold is a midpoint of neighbouring cells; a row meets the few thresholds in its own task."""
    q = _arms(spark, d).dropna().withColumn("threshold", F.explode(F.array(*[F.lit(x + 0.5) for x in range(6)])))
    r = q.withColumn("regret", E.regret(F.when(F.col("cell") < F.col("threshold"), F.col("cpu")).otherwise(F.col("gpu")), F.col("cpu"), F.col("gpu")))
    return r.groupBy("threshold").agg(F.round(F.max("regret"), 9).alias("most"), F.count_if(F.col("regret") > 0).alias("wrong"), F.round(F.avg("regret"), 9).alias("mean"))


@query("j15_threshold_sweep", f"{SWEEP} SELECT * FROM g")
def j15(spark, d):
    return _sweep(spark, d)


@query("w7_best_threshold", f"{SWEEP} SELECT * FROM g ORDER BY most, wrong, mean, threshold LIMIT 1")
def w7(spark, d):
    return _sweep(spark, d).orderBy("most", "wrong", "mean", "threshold").limit(1)


@query("x4_union_of_candidates", "SELECT event_id % 100 AS id FROM events UNION SELECT vec_id FROM embeddings")
def x4(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % 100).alias("id")).union(table(spark, d, "embeddings").select("vec_id")).distinct()


@query("x6_subset", f"{META} SELECT count(*) = 0 AS is_subset, count(*) AS outside FROM embeddings WHERE vec_id NOT IN (SELECT id FROM rec WHERE live)")
def x6(spark, d):
    out = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(meta(spark, d).where("live").select("id"), "id", "left_anti")
    return out.agg((F.count("*") == 0).alias("is_subset"), F.count("*").alias("outside"))


# windows, gates, payloads
@query("w2_synthetic_metadata")
def w2(spark, d, seed=17):
    """Owner and time of every vector, drawn in four ways from two uniform numbers a row; the same for any partitioning."""

    def make(batches):
        for own in batches:
            i = own.id.to_numpy()
            u, v = uniform(2 * i, seed), uniform(2 * i + 1, seed)
            yield pd.DataFrame(
                {
                    "id": i,
                    "independent_owner": np.floor(u * 100).astype(np.int64),
                    "positive_owner": np.floor((0.8 * u + 0.2 * v) * 100).astype(np.int64),
                    "negative_owner": np.floor((1 - (0.8 * u + 0.2 * v)) * 100).clip(0, 99).astype(np.int64),
                    "skewed_owner": np.where(u < 0.9, 0, 1 + np.floor(v * 99)).astype(np.int64),
                    "skewed_time": np.floor(u**3 * 1e12).astype(np.int64),
                }
            )

    kinds = "id long, independent_owner long, positive_owner long, negative_owner long, skewed_owner long, skewed_time long"
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).mapInPandas(make, kinds)


PAYLOAD = "cells array<struct<name: string, passed: boolean>>, failures array<string>"


@query("w9_latest_runs", "WITH k AS (SELECT event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) SELECT event_id, 1 + k % 4 AS cells, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS failures, k % 9 <> 0 AND NOT (k % 4 >= 2 AND k % 5 = 0) AS passed FROM k")
def w9(spark, d):
    """The latest 500 payloads, read as JSON: cells, failures, and whether there is no failure and all cells passed."""
    k = F.from_json("props", "k long")["k"]
    cells = F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("name"), (~((i == 2) & (k % 5 == 0))).alias("passed")))
    payload = F.to_json(F.struct(cells.alias("cells"), F.when(k % 9 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")).alias("failures")))
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", F.from_json(payload, PAYLOAD).alias("p"))
    passed = (F.size("p.failures") == 0) & F.forall("p.cells", lambda c: c["passed"])
    return e.select("event_id", F.size("p.cells").cast("long").alias("cells"), F.size("p.failures").alias("failures"), passed.alias("passed"))


GATE_RATIO = 2.0


@query("w14_research_gate", f"{CELLS}, b AS (SELECT run, cell, min(p) AS fastest, arg_min(engine, (p, engine)) AS baseline FROM c WHERE engine <> 'click' GROUP BY run, cell), f AS (SELECT user_id % 5 AS run, event_id % 7 AS cell, bool_and(value < 330) AS clean FROM events GROUP BY ALL) SELECT c.run, c.cell, baseline, round(fastest / p, 6) AS ratio, clean AND fastest / p >= 2.0 AS passed FROM c JOIN b ON c.run = b.run AND c.cell = b.cell JOIN f ON c.run = f.run AND c.cell = f.cell WHERE engine = 'click'")
def w14(spark, d):
    """The fastest qualifying baseline of each cell, its ratio to the candidate, and the gate: GATE_RATIO, and no fallback in any sample."""
    c = _cells(spark, d)
    rest = c.where("engine <> 'click'").groupBy("run", "cell").agg(F.min("p").alias("fastest"), F.min_by("engine", F.struct("p", "engine")).alias("baseline"))
    clean = samples(spark, d).groupBy("run", (F.col("id") % 7).alias("cell")).agg(F.bool_and(F.col("value") < 330).alias("clean"))
    ratio = F.col("fastest") / F.col("p")
    return c.where("engine = 'click'").join(rest, ["run", "cell"]).join(clean, ["run", "cell"]).select("run", "cell", "baseline", F.round(ratio, 6).alias("ratio"), (F.col("clean") & (ratio >= GATE_RATIO)).alias("passed"))


@query("w15_kernel_share", f"{SAMPLES}, r AS (SELECT engine, run, (quantile_disc(ns, 0.1) + quantile_disc(ns, 0.2)) / quantile_disc(ns, 0.5) AS share FROM s GROUP BY engine, run) SELECT engine, round(min(share), 6) AS least, round(max(share), 6) AS most FROM r GROUP BY engine")
def w15(spark, d):
    r = samples(spark, d).groupBy("engine", "run").agg(((E.disc("ns", 0.1) + E.disc("ns", 0.2)) / E.lower_median("ns")).alias("share"))
    return r.groupBy("engine").agg(F.round(F.min("share"), 6).alias("least"), F.round(F.max("share"), 6).alias("most"))


@query("w17_router_threshold", f"{ARMS}, u AS (SELECT cell, quantile_disc(gpu - cpu, 0.75) AS upper FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL GROUP BY cell) SELECT coalesce(min(cell) FILTER (upper < 0), 4096) AS threshold FROM u")
def w17(spark, d):
    u = _arms(spark, d).dropna().withColumn("x", F.col("gpu") - F.col("cpu")).groupBy("cell").agg(E.disc("x", 0.75).alias("upper"))
    return u.agg(F.coalesce(F.min(F.when(F.col("upper") < 0, F.col("cell"))), F.lit(MISSING_THRESHOLD)).alias("threshold"))


@query("w18_recomputed", f"{SAMPLES}, r AS (SELECT run, engine, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99, count(*) AS n FROM s GROUP BY run, engine) SELECT run, engine, p50, p95, p99, n FROM r WHERE run = 3")
def w18(spark, d):
    """Runs whose stored percentiles and counts aren't those of their samples; stored ones of run 3 are made wrong."""
    from lodestar.plans.registry import QUERIES

    fresh = QUERIES["a5_a6_nearest_rank"](spark, d)
    stored = fresh.withColumn("p95", F.col("p95") + F.when(F.col("run") == 3, 1).otherwise(0)).withColumnsRenamed({c: f"stored_{c}" for c in ("p50", "p95", "p99", "n")})
    same = [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in ("p50", "p95", "p99", "n")]
    return fresh.join(stored, ["run", "engine"], "full_outer").where(~(same[0] & same[1] & same[2] & same[3])).select("run", "engine", "p50", "p95", "p99", "n")


@query("w19_incomplete_grid", "SELECT u.user_id AS run, r.range AS query FROM (SELECT DISTINCT user_id FROM events) u, range(24) r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_id % 24 = r.range)")
def w19(spark, d):
    """Places of the grid of repetitions and queries that no row fills."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 24).alias("query"))
    grid = e.select("run").distinct().withColumn("query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return grid.join(e, ["run", "query"], "left_anti")


@query("w21_counterfactual", f"{ARMS} SELECT run, cell, round(cpu - gpu * 0.5 * (1 - least(cpu / gpu, 1)), 6) AS p50 FROM p WHERE cpu IS NOT NULL AND gpu IS NOT NULL")
def w21(spark, d):
    a = _arms(spark, d).dropna()
    return a.select("run", "cell", F.round(F.col("cpu") - F.col("gpu") * 0.5 * (1 - F.least(F.col("cpu") / F.col("gpu"), F.lit(1))), 6).alias("p50"))


LABELS = {"click": "Click-through", "view": "Page view", "purchase": "Purchase", "signup": "Sign-up", "error": "Error"}


@query("w22_labelled", f"{SAMPLES}, l AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS engine, unnest(['Click-through', 'Page view', 'Purchase', 'Sign-up', 'Error']) AS label, unnest([1, 2, 3, 4, 5]) AS place) SELECT place, label, printf('%.3f', quantile_disc(ns, 0.5) / 1000) AS ms FROM s JOIN l USING (engine) GROUP BY place, label")
def w22(spark, d):
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("engine")).cast("int")
    p = samples(spark, d).groupBy("engine").agg(E.lower_median("ns").alias("p"))
    return p.select(place.alias("place"), names[F.col("engine")].alias("label"), F.format_string("%.3f", F.col("p") / 1000).alias("ms"))


@query("w23_pairs", f"{ARMS} SELECT cell, count(*) FILTER (cpu IS NOT NULL AND gpu IS NOT NULL) AS completed, count(*) FILTER (cpu / gpu >= 1) AS qualified, round(avg(cpu / gpu), 6) AS ratio FROM p GROUP BY cell")
def w23(spark, d):
    ratio = F.col("cpu") / F.col("gpu")
    return _arms(spark, d).groupBy("cell").agg(F.count_if(F.col("cpu").isNotNull() & F.col("gpu").isNotNull()).alias("completed"), F.count_if(ratio >= 1).alias("qualified"), F.round(F.avg(ratio), 6).alias("ratio"))


@query("w25_augmented_corpus", "SELECT i.range AS row, p_partkey AS source, p_name || ' row ' || i.range AS text FROM range(3 * (SELECT count(*) FROM part)) i JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) p ON i.range % (SELECT count(*) FROM part) = place")
def w25(spark, d):
    """A corpus of three times the rows: each cycle repeats the source rows with the new row's number as a token."""
    p = E.global_rank(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "place")
    n = p.count()
    rows = p.withColumn("row", F.explode(F.array(*[F.col("place") + i * n for i in range(3)])))
    return rows.select("row", F.col("p_partkey").alias("source"), F.concat("p_name", F.lit(" row "), F.col("row").cast("string")).alias("text"))


# validation of results
@query("e1_recall_gate", "WITH r AS (SELECT user_id AS q, count(*) FILTER (event_type <> 'error') / count(*) AS recall FROM events GROUP BY user_id) SELECT q, recall + 1e-12 >= 0.8 AS passed FROM r")
def e1(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("q")).agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("recall"))
    return r.select("q", (F.col("recall") + 1e-12 >= 0.8).alias("passed"))


@query("e3_score_validation", f"{_batch('true', 10, STATED).replace('SELECT query_id, CAST(rank AS INT)', 'SELECT query_id, count(*) AS hits, 0 AS bad FROM (SELECT query_id, CAST(rank AS INT)')}) GROUP BY query_id")
def e3(spark, d):
    """Of each query its hits, and those whose distance isn't finite, isn't in order, or is over 1e-5 from the one in double precision."""
    e = table(spark, d, "embeddings")
    hits = search.batch_top_k(records(spark, d), _queries(spark, d, STATED), 10)
    q = e.where(STATED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = e.join(F.broadcast(hits), F.col("vec_id") == F.col("id")).join(F.broadcast(q), "query_id")
    before = F.lag("distance").over(Window.partitionBy("query_id").orderBy("rank"))
    x = F.col("distance").cast("double")
    bad = F.isnan(x) | (F.abs(x - V.oracle_distance(F.col("q"), F.col("embedding"))) > 1e-5) | (F.coalesce(before, F.col("distance")) > F.col("distance"))
    return rows.withColumn("bad", bad).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if("bad").cast("int").alias("bad"))


@query("e4_result_validation", f"{META}, q AS (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM rec JOIN embeddings e ON rec.id = e.vec_id WHERE live AND user_id < 500)) AS results, 0 AS invalid FROM q")
def e4(spark, d):
    """Of each query its results, and those that are too many, unknown, deleted, not eligible or repeated."""
    r = records(spark, d).where("user_id < 500")
    hits = search.batch_top_k(r, _queries(spark, d, STATED), 10).select("query_id", "id", "rank")
    good = meta(spark, d).where("live and user_id < 500").select("id", F.lit(True).alias("good"))
    n = F.count("*").over(Window.partitionBy("query_id", "id"))
    j = hits.withColumn("n", n).join(good, "id", "left")
    return j.groupBy("query_id").agg(F.count("*").alias("results"), F.count_if(F.col("good").isNull() | (F.col("n") > 1) | (F.col("rank") > 10)).cast("int").alias("invalid"))


TRUTHS = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events), t AS (SELECT user_id AS q, list(event_id ORDER BY place) FILTER (place <= 10) AS ids, count(*) AS eligible FROM r GROUP BY user_id)"


@query("e5_truth_replay", f"{TRUTHS} SELECT q, CAST(len(ids) AS BIGINT) AS cardinality, eligible, q % 7 = 3 AS missing, len(ids) <> least(10, eligible) OR q % 7 = 3 AS invalid FROM t")
def e5(spark, d):
    """Stored truths checked as on replay: min(k, eligible) ids, none twice, none missing; every seventh query's is lost."""
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    r = e.withColumn("place", place)
    counts = e.groupBy(F.col("user_id").alias("q")).agg(F.count("*").alias("eligible"))
    truth = r.where("place <= 10").groupBy(F.col("user_id").alias("q")).agg(F.collect_list("event_id").alias("ids"))
    stored = truth.withColumn("text", F.when(F.col("q") % 7 != 3, F.array_join("ids", ";"))).select("q", "text", F.size("ids").cast("long").alias("cardinality"))
    ids = F.split("text", ";")
    wrong = (F.size(ids) != F.least(F.lit(10), F.col("eligible"))) | (F.size(F.array_distinct(ids)) != F.size(ids))
    return counts.join(stored, "q", "left").select("q", "cardinality", "eligible", F.col("text").isNull().alias("missing"), (F.col("text").isNull() | F.coalesce(wrong, F.lit(True))).alias("invalid"))


@query("e9_run_comparison", f"{CELLS}, g AS (SELECT user_id % 5 AS run, event_id % 7 AS cell, count(*) FILTER (event_type <> 'error') / count(*) AS recall FROM events GROUP BY ALL), x AS (SELECT c.run, c.cell, p, recall FROM c JOIN g ON c.run = g.run AND c.cell = g.cell WHERE engine = 'click') SELECT a.cell, CASE WHEN a.recall + 1e-12 >= 0.75 AND b.recall + 1e-12 >= 0.75 THEN round(b.p / a.p, 6) END AS ratio FROM x a JOIN x b ON a.cell = b.cell WHERE a.run = 0 AND b.run = 1")
def e9(spark, d):
    """The candidate's 95th percentile by the baseline's; withheld where either misses its recall gate."""
    recall = samples(spark, d).groupBy("run", (F.col("id") % 7).alias("cell")).agg((F.count_if(F.col("engine") != "error") / F.count("*")).alias("recall"))
    x = _cells(spark, d).where("engine = 'click'").join(recall, ["run", "cell"])
    a, b = (x.where(F.col("run") == r).select("cell", F.col("p").alias(f"p{r}"), (F.col("recall") + 1e-12 >= 0.75).alias(f"good{r}")) for r in (0, 1))
    return a.join(b, "cell").select("cell", F.when(F.col("good0") & F.col("good1"), F.round(F.col("p1") / F.col("p0"), 6)).alias("ratio"))


@query("e10_performance_matrix", f"{CELLS} SELECT run, cell, max(p) FILTER (engine = 'click') AS click, max(p) FILTER (engine = 'view') AS view, max(p) FILTER (engine = 'purchase') AS purchase, arg_min(engine, (p, engine)) AS fastest FROM c GROUP BY run, cell")
def e10(spark, d):
    p = lambda e: F.max(F.when(F.col("engine") == e, F.col("p"))).alias(e)
    return _cells(spark, d).groupBy("run", "cell").agg(p("click"), p("view"), p("purchase"), F.min_by("engine", F.struct("p", "engine")).alias("fastest"))


# small functions and reads
@query("k16_prepared_oracle", _batch("user_id < 500", 10, STATED).replace("(1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]))::FLOAT", "round(1.0 - list_inner_product(q::DOUBLE[], vector::DOUBLE[]), 6)").replace("ORDER BY d, id", "ORDER BY round(d, 6), id").replace("SELECT query_id, CAST(rank AS INT) AS rank, id, round(CAST(d AS DOUBLE), 6) + 0.0 AS distance", "SELECT query_id, count(*) AS hits, round(sum(d), 4) AS total") + " GROUP BY query_id")
def k16(spark, d):
    """The oracle with rows filtered and lengths checked once for all queries: hits and the sum of their distances by query."""
    e = table(spark, d, "embeddings")
    given = [(r[0], list(r[1])) for r in e.where(STATED).select("vec_id", "embedding").collect()]
    rows = e.join(meta(spark, d).where("live and user_id < 500"), F.col("vec_id") == F.col("id")).where(V.norm(F.col("embedding")) > 0).select("id", F.col("embedding").alias("vector"))
    return search.oracle_top_k(rows, given, 10).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.sum("distance"), 4).alias("total"))


@query("f15_optional_parameters", f"{META} SELECT 'none' AS given, count(*) AS n FROM rec WHERE live UNION ALL SELECT 'user', count(*) FROM rec WHERE live AND user_id = 3 UNION ALL SELECT 'upper', count(*) FROM rec WHERE live AND timestamp < 1704100000000000")
def f15(spark, d):
    """Filters made of whichever parameters a request has."""
    from lodestar.operators.predicate import Filter

    wanted = {"none": {}, "user": {"user": "3"}, "upper": {"upper": "1704100000000000"}}
    m = meta(spark, d)
    return m.agg(*[F.count_if(Filter(**{k: int(v) for k, v in w.items()}).live()).alias(n) for n, w in wanted.items()]).select(F.explode(F.create_map(*[x for n in wanted for x in (F.lit(n), F.col(n))])).alias("given", "n"))


@query("f18_qualified", f"{CELLS} SELECT run, cell, engine, p FROM c WHERE engine <> 'error' AND p > 0 AND cell % 2 = 0")
def f18(spark, d):
    c = _cells(spark, d).withColumns({"status": F.when(F.col("engine") == "error", "failed").otherwise("completed"), "qualified": (F.col("p") > 0) & (F.col("cell") % 2 == 0)})
    return c.where((F.col("status") == "completed") & F.col("qualified")).select("run", "cell", "engine", "p")


@query("f19_strict_and_inclusive", "SELECT count(*) FILTER (event_id % 1000 < 10) AS strict, count(*) FILTER (event_id % 1000 <= 10) AS inclusive FROM events")
def f19(spark, d):
    x = F.col("event_id") % 1000
    return table(spark, d, "events").agg(F.count_if(x < 10).alias("strict"), F.count_if(x <= 10).alias("inclusive"))


@query("r2_by_slot", f"{META} SELECT slot, id, live FROM rec WHERE slot % 50 = 0")
def r2(spark, d):
    """The rows in the stated slots, deleted ones too."""
    wanted = meta(spark, d).where("slot % 50 = 0").select("slot")
    return meta(spark, d).join(wanted, "slot", "left_semi").select("slot", "id", "live")


@query("r5_capped_page", f"{META} SELECT id FROM rec ORDER BY slot LIMIT 500")
def r5(spark, d):
    from lodestar.operators.predicate import page
    from lodestar.sources.collection import MAX_PAGE

    return page(meta(spark, d), 0, min(1000, MAX_PAGE), None)[0].select("id")


@query("s18_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def s18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("s21_ranges", "SELECT event_id, user_id AS low, user_id + event_id % 9 AS high FROM events")
def s21(spark, d):
    """Ranges written as a..b, read back."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("..", F.col("user_id").cast("string"), (F.col("user_id") + F.col("event_id") % 9).cast("string")).alias("text"))
    part = F.split("text", "\\.\\.")
    return e.select("event_id", F.get(part, F.lit(0)).cast("long").alias("low"), F.get(part, F.lit(1)).cast("long").alias("high"))


@query("s22_families", "SELECT event_id, event_type AS family, CASE WHEN event_id % 3 = 0 THEN 'cpu' ELSE 'gpu' END AS arm FROM events")
def s22(spark, d):
    """Family and arm from names such as view-cpu."""
    e = table(spark, d, "events").select("event_id", F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "-cpu").otherwise("-gpu")).alias("name"))
    return e.select("event_id", F.regexp_replace("name", "-(cpu|gpu)$", "").alias("family"), F.substring_index("name", "-", -1).alias("arm"))


@query("s25_wire_ids", f"{META} SELECT id, user_id, timestamp FROM rec")
def s25(spark, d):
    """Records written as JSON with ids as strings, as programs without 64-bit numbers need, and read back."""
    wire = meta(spark, d).select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("id", "user_id")], "timestamp")).alias("wire"))
    r = wire.select(F.from_json("wire", "id string, user_id string, timestamp long").alias("r"))
    return r.select(*[F.col(f"r.{c}").cast("long").alias(c) for c in ("id", "user_id", "timestamp")])


@query("u3_routing", "SELECT event_id, CASE WHEN event_id % 16 >= 8 THEN 'accelerator' WHEN event_id % 3 = 0 THEN 'processor' WHEN user_id < 50 THEN 'processor' ELSE 'accelerator' END AS target FROM events")
def u3(spark, d):
    """The rule of automatic routing: the processor for small batches without a profile, or with too few eligible rows for it."""
    batch, profile, eligible_rows = F.col("event_id") % 16, F.when(F.col("event_id") % 3 != 0, 50), F.col("user_id")
    target = F.when((batch < 8) & (profile.isNull() | (eligible_rows < profile)), "processor").otherwise("accelerator")
    return table(spark, d, "events").select("event_id", target.alias("target"))
