"""Inverted lists: deterministic spherical k-means on an even sample, probing, exact or 8-bit scoring with exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestar.functions import vectors as V
from lodestar.operators import search as exact
from lodestar.operators.predicate import ALL, Filter, eligible

SAMPLE, ROUNDS, MAX_LISTS, RERANK = 2048, 4, 64, 32


def check(nprobe: int, lists: int) -> None:
    if not 1 <= nprobe <= lists <= MAX_LISTS:
        raise ValueError("InvalidIvfConfig")


@dataclass
class Index:
    """centroids: at most 64, on the driver. paths: folders with the rows by list, if they are stored. gone: ids deleted since."""

    centroids: np.ndarray
    paths: tuple[str, ...] = ()
    gone: DataFrame | None = None


def centroids(records: DataFrame, lists: int) -> np.ndarray:
    """Rounds of assignment and renormalised means over a sample spaced evenly by slot; an empty list keeps its centroid."""
    n = records.count()
    take = min(n, SAMPLE)
    if not take:
        return np.zeros((0, 0), np.float32)
    wanted = [i * n // take for i in range(take)]
    spark = records.sparkSession
    at = spark.createDataFrame([(s,) for s in wanted], "slot long")
    got = records.join(F.broadcast(at), "slot").select("slot", "vector").orderBy("slot").collect()
    sample = np.array([r[1] for r in got], np.float32)
    lists = min(lists, n, len(sample))
    c = sample[[i * len(sample) // lists for i in range(lists)]].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ c.T).argmax(1)
        for j in range(lists):
            own = sample[nearest == j]
            if len(own):
                total = own.sum(0)
                length = np.linalg.norm(total)
                if length > 0:
                    c[j] = total / length
    return c


def assign(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The list with the greatest product; ties go to the lowest."""
    return (v.astype(np.float64) @ c.astype(np.float64).T).argmax(1).astype(np.int32)


def with_lists(rows: DataFrame, c: np.ndarray, vector: str = "vector") -> DataFrame:
    """All columns and list, assigned in Arrow batches by one product each."""
    at, table = rows.columns.index(vector), rows.sparkSession.sparkContext.broadcast(c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("list", pa.array(assign(exact.matrix_of(batch.column(at), table.value.shape[1]), table.value)))

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


def build(records: DataFrame, lists: int, path: str | None = None) -> Index:
    """With a path the rows are stored there in a folder for each list, so that a search reads the probed lists only."""
    check(1, lists)
    index = Index(centroids(records, lists), (path,) if path else ())
    if path and len(index.centroids):
        store(records, index.centroids, path)
    return index


def store(records: DataFrame, c: np.ndarray, path: str) -> None:
    with_lists(records, c).write.partitionBy("list").parquet(path)


def probed(c: np.ndarray, queries: np.ndarray, nprobe: int, union: bool) -> np.ndarray:
    """Of each query and list whether it's probed: the nprobe lists with the greatest products."""
    product = queries.astype(np.float64) @ c.astype(np.float64).T
    out = np.zeros(product.shape, bool)
    np.put_along_axis(out, np.argsort(-product, axis=1, kind="stable")[:, :nprobe], True, axis=1)
    return np.broadcast_to(out.any(0), out.shape) if union else out


def search(index: Index, records: DataFrame, queries: DataFrame, k: int, nprobe: int, where: Filter = ALL, codes: bool = False, union: bool = False) -> DataFrame:
    """query_id, rank, id, distance; fewer than k if the probed lists hold fewer eligible rows.

    queries (query_id, query), unit vectors, a stated batch. codes: RERANK x k rows by 8-bit product first. union: a
    batch's queries share their candidates, as when one pass serves them all. Rows come from the index's folder, of
    which only probed lists are read, or from records, whose lists are found in passing.
    """
    V.check_k(k)
    given = queries.select("query_id", "query").collect()
    if not given or not len(index.centroids):
        return records.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance float")
    check(nprobe, len(index.centroids))
    names, matrix = np.array([r[0] for r in given], np.int64), np.array([r[1] for r in given], np.float32)
    probe = probed(index.centroids, matrix, nprobe, union)
    if index.paths:
        wanted = F.col("list").isin(np.flatnonzero(probe.any(0)).tolist())
        parts = [eligible(records.sparkSession.read.parquet(p).where(wanted), where).select("id", "vector", F.col("list").cast("int").alias("list")) for p in index.paths]
        rows = reduce(DataFrame.unionByName, parts)
        if index.gone is not None:
            rows = rows.join(index.gone, "id", "left_anti").select("id", "vector", "list")
    else:
        rows = eligible(records, where).select("id", "vector")
    table = rows.sparkSession.sparkContext.broadcast((names, matrix, probe, index.centroids))
    first = RERANK * k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, probe, c = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), exact.matrix_of(batch.column(1), matrix.shape[1])
            lists = batch.column(2).to_numpy() if batch.num_columns > 2 else assign(v, c)
            for i in range(0, len(names), 256):
                own, allowed = matrix[i : i + 256], probe[i : i + 256][:, lists]
                if codes:
                    (sq, cq, _), (sv, cv, _) = V.quantised(own), V.quantised(v)
                    approx = (cq.astype(np.float64) @ cv.astype(np.float64).T) * sq[:, None] * sv[None, :]
                    q, r = np.nonzero(allowed)
                    best = exact.first_k(q, -approx[q, r], ids[r], first)
                    q, r = q[best], r[best]
                    rough = -approx[q, r]
                    distance = exact.exact_distances(own[q], v[r])
                else:
                    q, r = exact.hopeful(*exact.bounded(own, v, exact.BLOCK), k, allowed)
                    distance = exact.exact_distances(own[q], v[r])
                    best = exact.first_k(q, distance, ids[r], k)
                    q, r, distance = q[best], r[best], distance[best]
                    rough = distance.astype(np.float64)
                yield pa.RecordBatch.from_pydict({"query_id": names[i : i + 256][q], "id": ids[r], "distance": distance, "rough": rough})

    near = rows.mapInArrow(work, "query_id long, id long, distance float, rough double")
    if codes:
        best = Window.partitionBy("query_id").orderBy("rough", "id")
        near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first)
    return exact.ranked(near, k)


def recalls(index: Index, records: DataFrame, queries: DataFrame, k: int, efforts: Sequence[int], where: Filter = ALL) -> dict[int, float]:
    """Of each nprobe the share of the exact k nearest that it finds, over all queries.

    A true neighbour is found if its list is among those probed, so the places of their lists in the order of probing
    tell the recall of every effort at once.
    """
    truth = exact.batch_top_k(records, queries, k, where).select("query_id", "id")
    rows = with_lists(records.join(F.broadcast(truth), "id").select("query_id", "vector"), index.centroids)
    found = rows.groupBy("query_id", "list").count().collect()  # lists x queries at most
    at = {r[0]: np.argsort(np.argsort(-(index.centroids.astype(np.float64) @ np.array(r[1], np.float64)), kind="stable"), kind="stable") for r in queries.select("query_id", "query").collect()}
    total = sum(r[2] for r in found)
    return {n: sum(r[2] for r in found if at[r[0]][r[1]] < n) / total if total else 1.0 for n in efforts}


def tune(recalls: dict[int, float], target: float) -> int:
    """The smallest effort that meets the target; ValueError if none does."""
    good = [n for n, r in recalls.items() if r + 1e-12 >= target]
    if not good:
        raise ValueError("RecallTargetMissed")
    return min(good)
