"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import tokens, wordscan
from lodestar.llm.common import arrow_map

SAMPLE_ROWS, SAMPLE_BYTES, FREQUENT = 500, 1 << 16, 1 << 16
"""The first tier holds the FREQUENT most frequent pre-tokens of SAMPLE_ROWS texts under SAMPLE_BYTES. It only saves time:
a pre-token that it lacks is counted by the second tier, so no result depends on the sample."""


def frequent_table(docs: DataFrame, text: str, path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits, keys and lengths of an open-addressing table of frequent pre-tokens (hash to number of tokens)."""
    rows = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(text).take(SAMPLE_ROWS)
    enc = tokens.encoder(path)
    seen, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block in wordscan.blocks(pa.array([r[0] for r in rows], pa.large_string())):
        if block.bounds[-1]:
            units = enc.units(block)
            seen.append(units[0].hash)
            sizes.append(enc.sizes(block, units))
    h, first, n = np.unique(np.concatenate(seen), return_index=True, return_counts=True)
    size = np.concatenate(sizes)[first]
    top = np.argsort(-n, kind="stable")[:FREQUENT]
    top = top[size[top] < 256]
    bits = max(4, int(2 * max(1, len(top)) - 1).bit_length())
    keys, lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
    lengths[tokens.place(keys, bits, h[top])] = size[top]
    return bits, keys, lengths


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every whole text, as the library counts them without added tokens.

    A null text is empty: 0 bytes, 0 tokens. Rows with a null or repeated key are counted like any others;
    other columns are not read. Memory of a task: a block of text, the first tier (at most 2 MB) and its
    worker's table of the pre-tokens that it met (bounded by tokens.MAX_WORDS).
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text, path))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        bits, keys, lengths = table.value
        enc = tokens.encoder(path)
        n_tokens, n_bytes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for block in wordscan.blocks(batch.column(1)):
            rows = slice(block.first, block.first + len(block.bounds) - 1)
            n_bytes[rows] = np.diff(block.bounds)
            if block.bounds[-1]:
                units = enc.units(block)
                slot = tokens.find(keys, bits, units[0].hash)
                size = lengths[slot].astype(np.int64)
                if (miss := np.flatnonzero(slot < 0)).size:
                    size[miss] = enc.sizes(block, units, miss)
                n_tokens[rows] = wordscan.sums(size, units[0].at)
        yield {"key": batch.column(0), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(key, text), f"key {kind}, n_bytes long, n_tokens long, over_limit boolean", work, keeps=True)
    return out.withColumnRenamed("key", key)
