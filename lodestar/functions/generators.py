"""Seeded generators in wrapping 64-bit arithmetic, which ANSI SQL refuses, so they are NumPy code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Increments and multipliers of the well-known generators.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def splitmix64(index: np.ndarray, seed: int) -> np.ndarray:
    """The index-th output (from 0) of SplitMix64 from a seed; any can be had without those before."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % 2**64) + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        return z ^ (z >> np.uint64(31))


def uniform(index: np.ndarray, seed: int) -> np.ndarray:
    return (splitmix64(index, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53


def xorshift(state: int) -> int:
    state ^= state << 13 & (2**64 - 1)
    state ^= state >> 7
    return state ^ (state << 17 & (2**64 - 1))


def lcg(state: int) -> int:
    return (state * LCG_A + LCG_C) % 2**64


def shuffled(n: int, seed: int) -> list[int]:
    """A Fisher-Yates permutation by the LCG's whole state modulo the places left; for query orders, which are small."""
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        seed = lcg(seed)
        j = seed % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def vectors(spark: SparkSession, rows: int, dimension: int, seed: int, clusters: int = 0) -> DataFrame:
    """id, vector: seeded vectors in -1 .. 1; with clusters, one axis of each row is moved by 8. Distributed, the same for any partitioning."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = uniform(ids[:, None] * dimension + np.arange(dimension), seed) * 2 - 1
            if clusters:
                v[np.arange(len(ids)), ids % clusters % dimension] += 8.0
            flat = pa.array(v.astype(np.float32).ravel())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dimension, dtype=np.int32)), flat)})

    return spark.range(rows).mapInArrow(make, "id long, vector array<float>")
