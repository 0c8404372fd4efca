"""Best-fit packing planned on the histogram of lengths: documents only take the slots that the plan has for their length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import tokens, wordscan
from lodestar.llm.common import arrow_map, gapless, partitions, salt_offsets, written

CAPACITY, END_ID = 2048, 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: (number of equal bins, [(length, how many in each bin)]) with lengths falling.

    Lengths go from long to short; the pieces of one go to the fullest bins with room, all equal bins at once,
    and what is left opens new bins. A length splits at most two groups of equal bins, so the work and the
    plan grow with the number of lengths, at most the capacity, not with the number of documents.
    """
    by_room: dict[int, list[tuple[int, list]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in [r for r in sorted(by_room) if r >= length]:
            if not left:
                break
            each, stay = room // length, []
            for n, items in by_room.pop(room):
                full, rest = min(n, left // each), 0
                if full:
                    by_room[room - each * length].append((full, [*items, (length, each)]))
                    left -= full * each
                if full < n and left:
                    rest, left = left, 0
                    by_room[room - rest * length].append((1, [*items, (length, rest)]))
                if n - full - bool(rest):
                    stay.append((n - full - bool(rest), items))
            if stay:
                by_room[room] += stay
        each = capacity // length
        if full := left // each:
            by_room[capacity - each * length].append((full, [(length, each)]))
        if rest := left % each:
            by_room[capacity - rest * length].append((1, [(length, rest)]))
    return [group for room in sorted(by_room) for group in by_room[room]]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, each, first sequence, offset), sorted: pieces of a length, by rank, take a group's bins each at a time."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for n, items in groups:
        offset = 0
        for length, each in items:
            out.append((length, rank[length], each, sequence, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, key: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """key, piece, start, length, ids_crc32: a document's ids and the end id, cut every capacity ids."""

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = tokens.encoder(vocabulary)
        for block in wordscan.blocks(batch.column(1)):
            flat, at = enc.ids(block)
            flat, n = flat.astype("<u4"), np.diff(at) + 1
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            end = np.array([end_id], "<u4").tobytes()
            begin, stop = at[doc] + start, np.minimum(at[doc] + start + length, at[doc + 1])
            last = (piece == count[doc] - 1).tolist()
            crc = [zlib.crc32(end, c) if e else c for c, e in zip((zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), last, strict=True)]
            yield {"key": batch.column(0).slice(block.first, len(n)).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), f"key {kind}, piece int, start long, length long, ids_crc32 long", cut, keeps=True)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null text is empty and is one piece with the end id alone. Rows with equal or null keys are documents of
    their own; other columns are not read, so their names don't matter. An empty table gives an empty one. Spans refer to a document's ids followed by the end id.

    Texts are encoded once; the pieces, 40 bytes each, are written to the shared folder. The driver gets the
    histogram (at most capacity rows) and plans. A length with many pieces is split over salts, in proportion,
    for its ranks, so equal lengths don't meet in a task.
    """
    cut = written(pieces(docs, vocabulary, key, text, capacity, end_id), "pieces")
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    if not counts:
        return cut.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", F.col("start").alias("sequence_id"), F.col("start").alias("offset"))
    share = max(64, sum(counts.values()) // (4 * partitions(spark)))
    salts = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), "salts").cast("int")).drop("salts")
    offsets = salt_offsets(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "length", "salt")
    ranked = gapless(salted, "length", "salt", ["key", "piece", "ids_crc32"], "rank", offsets)
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))

    def take(batch: pa.RecordBatch) -> Iterator[dict]:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        s = table.value
        row = s[np.searchsorted((s[:, 0] << 44) + s[:, 1], (length << 44) + rank, "right") - 1]
        local = rank - row[:, 1]
        own = {n: batch.column(i) for i, n in enumerate(("key", "piece", "start", "length", "ids_crc32"))}
        yield own | {"sequence_id": row[:, 3] + local // row[:, 2], "offset": row[:, 4] + local % row[:, 2] * length}

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return arrow_map(ranked.select("key", "piece", "start", "length", "ids_crc32", "rank"), schema, take).withColumnRenamed("key", key)
