"""Words of whole texts as numpy arrays: the kernel that the operators on words share.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Arrow gives the texts of a batch as one
buffer, so splitting and hashing are vectorised over all of them; no Python object is made for a
word. Hashes have 64 bits, and any two different words share one with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
"""Texts are worked on in blocks of about so many bytes (a longer text is a block of its own)."""

_PAD = 40
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Block:
    """Some texts of a batch: rows first .. first + len(bounds) - 2; their bytes, padded with zeros."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


@dataclass
class Words:
    """starts, ends: byte positions in the block; hash; at: words at[i] .. at[i + 1] - 1 are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column in blocks; a null is an empty text. lower: A-Z become a-z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        j = min(j, n)
        own = np.zeros(bounds[j] - bounds[i] + _PAD, np.uint8)
        part = data[bounds[i] : bounds[j]]
        own[: len(part)] = _LOWER[part] if lower else part
        yield Block(i, own, bounds[i : j + 1] - bounds[i])
        i = j


def lowered(block: Block) -> np.ndarray:
    """The block's bytes with A-Z and the capitals among U+00C0-U+00DE in lower case; lengths don't change."""
    n = int(block.bounds[-1])
    low = _LOWER[block.data]
    lead = np.flatnonzero(block.data[:n] == 0xC3)
    tail = block.data[lead + 1]
    low[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 32
    return low


def words(block: Block) -> Words:
    w = spans(block)
    w.hash = hashes(block.data, w.starts, w.ends)
    return w


def spans(block: Block, between: np.ndarray = _SEP) -> Words:
    """The words without their hashes; between: of each byte, whether it stands between words."""
    n = int(block.bounds[-1])
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(block.bounds), np.int64))
    data = block.data
    sep = between[data[:n]]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, sep[:-1]
    edge[block.bounds[:-1][block.bounds[:-1] < n]] = True
    starts = np.flatnonzero(edge & ~sep)
    edge[-1], edge[:-1] = True, sep[1:]
    edge[block.bounds[1:][block.bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~sep) + 1
    return Words(starts, ends, np.zeros(0, np.uint64), np.searchsorted(starts, block.bounds))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each span of padded bytes; the same for the same bytes anywhere."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    length = ends - starts
    h = (eight[starts] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _M2)
    h *= _M1
    h ^= h >> np.uint64(32)
    for j in (8, 16, 24):
        more = np.flatnonzero(length > j)
        if not len(more):
            break
        k = eight[starts[more] + j] & _MASK[np.minimum(length[more] - j, 8)]
        k ^= h[more]
        k *= _M1
        h[more] = k ^ (k >> np.uint64(29))
    h = mix(h)
    for i in np.flatnonzero(length > 32):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    h[h == 0] = 1
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words; one for each word that has n - 1 behind it in the array (not in its text)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) + h[k : len(h) - n + 1 + k]
    return mix(out)


def window_owner(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting words of the windows of n that lie within a text, and their texts' numbers."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    return first + np.arange(len(owner)), owner


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], also for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
