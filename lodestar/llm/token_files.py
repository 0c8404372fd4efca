"""Token ids in binary blocks: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A block holds whole documents. Its bytes, all little-endian: magic "RVB1"; u32 number of documents; u64
number of ids; per document u8 "has a key", i64 key, u32 crc of its ids, u64 number of ids (four arrays);
control bytes, one for four ids with two bits each (length - 1, the first id in the lowest bits); data
bytes, the least significant first; u32 crc32 of all before. An id is written as its rank by frequency in
the whole corpus, so that the 256 most frequent ids take one byte. Blocks are rows of a Parquet table,
whose committers survive lost executors on any file system; the rank table is a table beside it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens, wordscan
from lodestar.llm.common import arrow_map, drop, in_batches, shared_dir, written

BLOCK_IDS = 1 << 18
"""A block is closed when it has so many ids; a longer document makes a longer block."""
END_ID = 1
_MAGIC = b"RVB1"
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
"""By control byte: how many data bytes each of its four ids takes."""


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of integers below 2^32."""
    v = values.astype("<u4")
    size = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    octets = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def decode_ids(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(keys: list, crcs: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ids(ranks)
    has = np.array([k is not None for k in keys], np.uint8)
    out = b"".join([_MAGIC, struct.pack("<IQ", len(keys), len(ranks)), has.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), crcs.astype("<u4").tobytes(), counts.astype("<u8").tobytes(), control, data])
    return out + struct.pack("<I", zlib.crc32(out))


def unpack_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, crcs as written, numbers of ids, and all ranks; ValueError if the block is damaged."""
    if block[:4] != _MAGIC or len(block) < 20 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    docs, n = struct.unpack("<IQ", block[4:16])
    at, parts = 16, []
    for kind in ("u1", "<i8", "<u4", "<u8"):
        parts.append(np.frombuffer(block, kind, docs, at))
        at += docs * parts[-1].itemsize
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    data = np.frombuffer(block, np.uint8, len(block) - 4 - at - len(control), at + len(control))
    keys = [int(k) if h else None for h, k in zip(parts[0], parts[1], strict=True)]
    return keys, parts[2], parts[3].astype(np.int64), decode_ids(control, data, n)


def write_files(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Writes path/blocks and path/ranks; see the module. Documents are in ascending order of key over all blocks.

    Keys are integers. A null text is empty and has the end id alone; a null key comes first; rows with equal keys follow one
    another in the order of their ids' crc. An empty table writes no block. Texts are encoded once, into a
    table of ids in the shared folder, from which frequencies are counted (one row per id and task, summed
    by id) and blocks made. The shuffle that orders documents moves ids, not texts.
    """
    def ids(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = tokens.encoder(vocabulary)
        for block in wordscan.blocks(batch.column(1)):
            flat, at = enc.ids(block)
            n = len(at) - 1
            own = np.full(len(flat) + n, end_id, np.uint16)
            own[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(at))] = flat
            at = at + np.arange(n + 1)
            raw = [own[at[i] : at[i + 1]] for i in range(n)]
            yield {"key": batch.column(0).slice(block.first, n), "n": np.diff(at), "crc": np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in raw], np.int64), "ids": pa.array([x.tobytes() for x in raw], pa.binary())}

    encoded = written(arrow_map(docs.select(F.col(key).cast("long"), text), "key long, n long, crc long, ids binary", ids, keeps=True), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw = batch.column(0)
            total += np.bincount(np.frombuffer(b"".join(raw.to_pylist()), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    ranked = in_batches(encoded.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r[0] for r in sorted(ranked.collect(), key=lambda r: (-r[1], r[0]))]  # at most a vocabulary
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(np.array(order, "<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    lookup = np.zeros(1 << 16, np.uint32)
    lookup[order] = np.arange(len(order))
    table = spark.sparkContext.broadcast(lookup)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, crcs, counts, raw, held, number, base = [], [], [], [], 0, 0, 0

        def made() -> pa.RecordBatch:
            ranks = table.value[np.frombuffer(b"".join(raw), "<u2")]
            out = pack_block(keys, np.array(crcs), np.array(counts), ranks)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "base": [base], "n_ids": [len(ranks)], "data": pa.array([out], pa.binary())})

        for batch in batches:
            shard = batch.column(4)[0].as_py()
            for k, n, c, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys.append(k), counts.append(n), crcs.append(c), raw.append(x)
                held += n
                if held >= BLOCK_IDS:
                    yield made()
                    keys, crcs, counts, raw, held, number, base = [], [], [], [], 0, number + 1, base + held
        if keys:
            yield made()

    dealt = encoded.repartitionByRange("key", "crc").sortWithinPartitions("key", "crc").select("key", "n", "crc", "ids", F.spark_partition_id())
    in_batches(dealt, pack, "shard int, block int, base long, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop(encoded)


def read_files(spark, path: str) -> DataFrame:
    """Per document, read from the blocks: key, start (ids of all documents before), n_tokens, ids (binary, unsigned 32-bit).

    A block's row has the number of ids before it in its shard; the sums over shards, of which there are as many
    as shuffle partitions, are broadcast. Decoded ids stay in the task that read them.
    """
    blocks = spark.read.schema("shard int, block int, base long, n_ids long, data binary").parquet(f"{path}/blocks")
    ranks = spark.read.schema("ids binary").parquet(f"{path}/ranks").first()
    ids = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks[0]) if ranks else b"", "<u4"))

    def unpack(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            keys, crcs, counts, got = unpack_block(batch.column(2)[i].as_py())
            flat = ids.value[got].astype("<u4")
            ends = np.cumsum(counts)
            raw = [flat[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
            if any(zlib.crc32(x) != c for x, c in zip(raw, crcs.tolist(), strict=True)):
                raise ValueError("a document's ids differ from those written")
            n = len(keys)
            yield {"shard": pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), "key": pa.array(keys, pa.int64()), "at": ends - counts + batch.column(1)[i].as_py(), "n_tokens": counts, "ids": pa.array(raw, pa.binary())}

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), zero).alias("shard_base"))
    docs = arrow_map(blocks.select("shard", "base", "data"), "shard int, key long, at long, n_tokens long, ids binary", unpack)
    return docs.join(F.broadcast(shards), "shard").select("key", (F.col("shard_base") + F.col("at")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The documents' ids, written to a new folder in the shared one and read back."""
    path = f"{shared_dir(docs.sparkSession)}/files-{id(docs):x}-{np.random.default_rng().integers(1 << 62):x}"
    write_files(docs, path, vocabulary, **options)
    return read_files(docs.sparkSession, path)
