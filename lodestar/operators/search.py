"""Exact filtered top-k by cosine distance, single and in batches; results are ordered by (distance as float, id).

All ways give identical results. REFERENCE scores every eligible row with Columns and keeps k: Spark plans a
per-partition heap and a merge. BLOCK and INT8 work on Arrow batches: a batch is scored by one matrix product, in
single precision or of 8-bit codes; rows that can't be among a query's k nearest of the batch, even with the proven
error bound, are dropped; what is left is scored in double precision, summed in the order of components as the
Columns do, and k rows per query leave the batch. Of equal vectors k at most are looked at. Only the queries are
broadcast, at most MAX_QUERIES at once; more are taken in parts, so there is no cross join and no pair of a query
and a far row ever becomes a row. AUTO is BLOCK, which is the faster for one query too, or REFERENCE where no bound
holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators.predicate import ALL, Filter, eligible

REFERENCE, BLOCK, INT8, AUTO = "reference", "block", "int8", "auto"
STRATEGIES = (REFERENCE, BLOCK, INT8, AUTO)
MAX_QUERIES = 4096
_SLACK = 1e-6
"""Distances are rounded to float, and ties go by id."""


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError("UnknownStrategy")
    return strategy


def top_k(records: DataFrame, query: Sequence[float], k: int, where: Filter = ALL, strategy: str = AUTO) -> DataFrame:
    """id, distance of the k nearest eligible rows. k is checked first, then the query, even if nothing is eligible."""
    V.check_k(k)
    check_strategy(strategy)
    q = V.validate(query, len(query))
    rows = eligible(records, where)
    if strategy == AUTO and V.fp32_bound(len(q)) is not None:
        strategy = BLOCK
    if strategy in (BLOCK, INT8):
        near = nearest(rows, [(0, q)], k, strategy).select("id", "distance")
    else:
        near = rows.select("id", V.distance(V.literal(q), F.col("vector")).alias("distance"))
    return near.orderBy("distance", "id").limit(k)


def matrix_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def few_equals(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers without those of equal vectors beyond the k least ids."""
    bits = np.ascontiguousarray(v).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(9).integers(0, 1 << 64, v.shape[1], np.uint64) | np.uint64(1)
    h = (bits * odd).sum(1)
    order = np.lexsort((ids, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    more = np.arange(len(order)) - first >= k
    more[more] = (bits[order[more]] == bits[order[first[more]]]).all(1)
    return np.sort(order[~more])


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As V.distance has them, to the bit: products in double precision, summed one after another."""
    out = np.empty(len(a), np.float32)
    for c in range(0, len(a), 1 << 14):
        products = a[c : c + (1 << 14)].astype(np.float64) * b[c : c + (1 << 14)]
        out[c : c + (1 << 14)] = 1.0 - np.add.accumulate(products, axis=1)[:, -1]
    return out


def bounded(matrix: np.ndarray, v: np.ndarray, strategy: str) -> tuple[np.ndarray, np.ndarray]:
    """Products of queries and rows, and how far each can be off."""
    if strategy == INT8:
        (sq, cq, _), (sv, cv, lv) = V.quantised(matrix), V.quantised(v)
        kind = np.float32 if matrix.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of codes' products are exact
        product = (cq.astype(kind) @ cv.astype(kind).T).astype(np.float64) * sq[:, None] * sv[None, :]
        lq = np.abs(cq.astype(np.float64)).sum(1)
        return product, (sq[:, None] * sv[None, :] / 2 * lq[:, None] + sq[:, None] / 2 * lv[None, :]) * 1.0001 + 1e-7
    bound = V.fp32_bound(matrix.shape[1])
    if bound is None:
        raise ValueError("no error bound for so many dimensions; use the reference strategy")
    product = matrix @ v.T
    return product, np.full((1, 1), bound)


def hopeful(product: np.ndarray, bound: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and rows: pairs that may be among a query's k nearest rows, at least k if there are as many."""
    low, high = product - bound, product + bound
    if allowed is not None:
        low = np.where(allowed, low, -np.inf)
    least = -np.partition(-low, k - 1, axis=1)[:, k - 1] if product.shape[1] > k else np.full(len(product), -np.inf)
    good = high >= (least - 2 * _SLACK)[:, None]
    return np.nonzero(good if allowed is None else good & allowed)


def first_k(q: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k least (value, id) of each query."""
    order = np.lexsort((ids, value, q))
    new = np.append(True, q[order][1:] != q[order][:-1]) if len(q) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else order
    return order[np.arange(len(order)) - first < k]


def nearest(rows: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, strategy: str = BLOCK) -> DataFrame:
    """query_id, id, distance: the k nearest rows of each Arrow batch to each query."""
    names = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float32)
    bounded(matrix[:1], matrix[:1], strategy)  # refused here if at all
    table = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = table.value
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0).to_numpy(), matrix_of(batch.column(1), matrix.shape[1])
                own = few_equals(v, ids, k)
                ids, v = ids[own], v[own]
                for c in range(0, len(names), 256):
                    q, r = hopeful(*bounded(matrix[c : c + 256], v, strategy), k)
                    distance = exact_distances(matrix[c : c + 256][q], v[r])
                    best = first_k(q, distance, ids[r], k)
                    yield pa.RecordBatch.from_pydict({"query_id": names[c : c + 256][q[best]], "id": ids[r[best]], "distance": distance[best]})

    return rows.select("id", "vector").mapInArrow(work, "query_id long, id long, distance float")


def batch_top_k(records: DataFrame, queries: DataFrame, k: int, where: Filter = ALL, strategy: str = AUTO) -> DataFrame:
    """query_id, rank, id, distance for every row (query_id, query) of queries, one shared filter.

    Queries are collected: they are a stated batch, not data. Each is normalised as records are.
    """
    V.check_k(k)
    check_strategy(strategy)
    return ranked(_batch_scored(records, queries, k, where, strategy), k)


def _batch_scored(records: DataFrame, queries: DataFrame, k: int, where: Filter, strategy: str) -> DataFrame:
    """query_id, id, distance: at least the k nearest rows to each query."""
    rows = eligible(records, where).select("id", "vector")
    spark = records.sparkSession
    given = [(r[0], V.validate(r[1], len(r[1]))) for r in queries.select("query_id", "query").collect()]
    out = spark.createDataFrame([], "query_id long, id long, distance float")
    for i in range(0, len(given), MAX_QUERIES):
        part = given[i : i + MAX_QUERIES]
        if strategy == REFERENCE:
            units = F.broadcast(spark.createDataFrame(part, "query_id long, query array<float>"))
            out = out.union(rows.join(units).select("query_id", "id", V.distance(F.col("query"), F.col("vector")).alias("distance")))
        else:
            out = out.union(nearest(rows, part, k, INT8 if strategy == INT8 else BLOCK))
    return out


def oracle_top_k(rows: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """query_id, rank, id, distance: the k nearest of rows (id, vector) of any length, in double precision throughout.

    Equal to nine places counts as a tie, which goes by id.
    """
    names, matrix = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)
    table = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = table.value
        total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0).to_numpy(), matrix_of(batch.column(1), matrix.shape[1])
                own = few_equals(v, ids, k)
                ids, v = ids[own], v[own].astype(np.float64)
                length = np.sqrt(total(v * v))
                for q, row in zip(names.tolist(), matrix, strict=True):
                    d = 1 - np.clip(total(row * v) / (np.sqrt(total(row[None, :] ** 2)) * length), -1, 1)
                    near = np.flatnonzero(d <= (np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf) + 2e-9)
                    yield pa.RecordBatch.from_pydict({"query_id": np.full(len(near), q), "id": ids[near], "distance": d[near]})

    scored = rows.select("id", "vector").mapInArrow(work, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def tensor_top_k(records: DataFrame, queries: DataFrame, k: int, where: Filter = ALL) -> DataFrame:
    """query_id, tied, rank, id, distance: the k nearest, and whether the place behind the last is as near as the last.

    As programs on tensors have it: k + 1 places are taken, so that a tie at the cut is seen; it goes by id. Of queries, of
    which those take 128 at once, any number is worked on in parts, as batch_top_k does; ids must not be negative.
    """
    V.check_k(k)
    if not records.where("id < 0").isEmpty():
        raise ValueError("NegativeId")
    near = ranked(_batch_scored(records, queries, k + 1, where, BLOCK), k + 1)
    own = Window.partitionBy("query_id")
    last, more = (F.max(F.when(F.col("rank") == r, F.col("distance"))).over(own) for r in (k, k + 1))
    cut = near.withColumn("tied", F.coalesce(last == more, F.lit(False)))
    return cut.where(F.col("rank") <= k).select("query_id", "tied", "rank", "id", "distance")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def search_rows(records: DataFrame, plan: DataFrame, query: Sequence[float], k: int, where: Filter = ALL) -> DataFrame:
    """top_k over a compiled list of slots; refuses a list with a slot that is no longer eligible."""
    from lodestar.operators.predicate import unmatched

    V.check_k(k)
    q = V.validate(query, len(query))
    if not unmatched(plan, records, where).isEmpty():
        raise ValueError("InvalidEligibleRow")
    return top_k(records.join(plan.select("slot"), "slot", "left_semi"), q, k, where)


def enrich(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with their records and similarity; hits are at most k per query, so they are the broadcast side."""
    return records.join(F.broadcast(hits), "id").withColumn("similarity", V.similarity(F.col("distance")))
