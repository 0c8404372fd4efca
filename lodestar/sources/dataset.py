"""A prepared dataset in one file: vectors of a corpus, of tuning and of evaluation queries, little-endian and checksummed.

A header of 8 bytes of magic and u64 dimension, corpus rows, tuning rows, evaluation rows, seed and provenance (0:
synthetic, 1: imported); rows of floats in that order; the CRC-32 of all before. Readers take any magic that ends in a
digit; a writer's magic is an argument, for files that another program is to read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.generators import uniform

MAGIC = b"LODSET01"
SYNTHETIC, IMPORTED = 0, 1
BUDGET = 1 << 30
_HEAD = "<8sQQQQQQ"
_HEAD_BYTES = struct.calcsize(_HEAD)


class Damaged(ValueError):
    """args[0] names the rule that the file breaks."""


@dataclass
class Head:
    dimension: int
    corpus: int
    tuning: int
    evaluation: int
    seed: int
    provenance: int

    @property
    def rows(self) -> int:
        return self.corpus + self.tuning + self.evaluation


def _write(path: str, head: Head, parts: Iterator[np.ndarray], magic: bytes) -> None:
    pending, crc, n = f"{path}.pending", 0, 0
    with open(pending, "wb") as f:
        raw = struct.pack(_HEAD, magic, head.dimension, head.corpus, head.tuning, head.evaluation, head.seed, head.provenance)
        f.write(raw)
        crc = zlib.crc32(raw)
        for part in parts:
            raw = np.ascontiguousarray(part, "<f4").tobytes()
            crc, n = zlib.crc32(raw, crc), n + len(part)
            f.write(raw)
        f.write(struct.pack("<I", crc))
        f.flush()
        os.fsync(f.fileno())
    try:
        if n != head.rows:
            raise Damaged("RowCount")
        os.link(pending, path)  # fails if the target exists
    finally:
        os.unlink(pending)


def prepare(path: str, dimension: int, corpus: int, tuning: int, evaluation: int, seed: int = 0, magic: bytes = MAGIC) -> Head:
    """Seeded unit vectors, the same for the same seed."""
    head = Head(dimension, corpus, tuning, evaluation, seed, SYNTHETIC)

    def parts() -> Iterator[np.ndarray]:
        for i in range(0, head.rows, 8192):
            ids = np.arange(i, min(i + 8192, head.rows))
            v = uniform(ids[:, None] * dimension + np.arange(dimension), seed) * 2 - 1
            yield v / np.linalg.norm(v, axis=1, keepdims=True)

    _write(path, head, parts(), magic)
    return head


def import_raw(source: str, path: str, dimension: int, corpus: int, tuning: int, evaluation: int, crc: int, magic: bytes = MAGIC) -> Head:
    """Floats of another program, rows one after another without a header, whose CRC-32 is known; rows become unit vectors."""
    head = Head(dimension, corpus, tuning, evaluation, 0, IMPORTED)
    if os.path.getsize(source) != 4 * dimension * head.rows:
        raise Damaged("Length")
    rows = np.memmap(source, "<f4", "r", shape=(head.rows, dimension))
    seen = 0
    for i in range(0, head.rows, 8192):
        seen = zlib.crc32(rows[i : i + 8192].tobytes(), seen)
    if seen != crc:
        raise Damaged("Checksum")

    def parts() -> Iterator[np.ndarray]:
        for i in range(0, head.rows, 8192):
            v = rows[i : i + 8192].astype(np.float64)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            if not np.isfinite(length).all() or (length == 0).any():
                raise Damaged("Norm")
            yield v / length

    _write(path, head, parts(), magic)
    return head


def check(raw: bytes, budget: int = BUDGET) -> Head:
    """The header, after the rules: budget, magic, length, checksum."""
    if len(raw) > budget:
        raise Damaged("Budget")
    if len(raw) < _HEAD_BYTES + 4:
        raise Damaged("Length")
    magic, *numbers = struct.unpack_from(_HEAD, raw)
    head = Head(*numbers)
    if not magic[7:8].isdigit():
        raise Damaged("Magic")
    if not head.dimension or len(raw) != _HEAD_BYTES + 4 * head.dimension * head.rows + 4:
        raise Damaged("Length")
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise Damaged("Checksum")
    return head


def load(spark: SparkSession, path: str, budget: int = BUDGET) -> DataFrame:
    """split (corpus, tuning, evaluation), id (from 0 in each split), vector. Files are read whole by tasks, so they must fit the budget.

    A broken rule, or a row that isn't a unit vector, stops the read with Damaged's rule.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py()
                head = check(raw, budget)
                v = np.frombuffer(raw, "<f4", head.rows * head.dimension, _HEAD_BYTES).reshape(-1, head.dimension)
                if not (np.abs((v.astype(np.float64) ** 2).sum(1) - 1) <= 1e-5).all():
                    raise Damaged("Norm")
                at = 0
                for split, n in (("corpus", head.corpus), ("tuning", head.tuning), ("evaluation", head.evaluation)):
                    for i in range(0, n, 8192):
                        own = v[at + i : at + min(i + 8192, n)]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, head.dimension, dtype=np.int32)), pa.array(own.ravel()))
                        yield pa.RecordBatch.from_pydict({"split": pa.array([split] * len(own)), "id": np.arange(i, i + len(own)), "vector": lists})
                    at += n

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "split string, id long, vector array<float>")
