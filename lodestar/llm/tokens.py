"""Token ids of whole texts, exactly as the tokenizers library gives them, at the price of a table lookup per word.

The vocabulary file normalises and splits so that no token crosses white space, and 0x20 and
0x09-0x0D are white space to it. So a text's ids are the ids of its words one after another. A
worker keeps an open-addressing table from a unit's 64-bit hash to its ids; only units that it has
not met are encoded. A unit is a pre-token of an ordinary Latin word: those go through ``Merges``,
which applies the file's merges to many at once. A word with anything else in it (other scripts,
combining marks, apostrophes, special strings, great length) is a unit as a whole and goes to the library itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from lodestar.llm.common import CACHES
from lodestar.llm.wordscan import Block, Words, hashes, mix, spans

MAX_WORDS = 1 << 20
"""Words that a worker's table holds at most; then it starts anew, so memory is bounded."""
MAX_POOL = 1 << 23
_LONG = 48
_NONE = np.int32(1 << 30)


def library(path: str):
    """The library's tokenizer with its defaults."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    if out.get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits: a vocabulary has 65,536 tokens at most")
    return out


def _byte_chars() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merges of a vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 18
        slots = mix(keys) >> np.uint64(64 - self.bits)
        self.keys = np.full(1 << self.bits, (1 << 63), np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        wait = np.arange(len(keys))
        self.probes = 0
        while len(wait):
            self.probes += 1
            free = wait[self.keys[slots[wait]] == np.uint64(1 << 63)]
            _, one = np.unique(slots[free], return_index=True)
            put = free[one]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], put
            wait = np.setdiff1d(wait, put)
            slots[wait] = (slots[wait] + np.uint64(1)) & np.uint64((1 << self.bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        slot = mix(key) >> np.uint64(64 - self.bits)
        found = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        seek = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != np.uint64(1 << 63)))
        key, slot = key[seek], slot[seek]
        for _ in range(self.probes):
            if not len(seek):
                break
            slot = (slot + np.uint64(1)) & np.uint64((1 << self.bits) - 1)
            hit = self.keys[slot] == key
            found[seek[hit]] = self.ranks[slot[hit]]
            go = ~hit & (self.keys[slot] != np.uint64(1 << 63))
            seek, slot, key = seek[go], slot[go], key[go]
        return found

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, given as spans of bytes, one after another, and how many each has."""
        order = np.argsort(sizes, kind="stable")
        ordered, ids, counts = sizes[order], [], []
        i = 0
        while i < len(order):
            j = min(int(np.searchsorted(ordered, max(6, ordered[i] + 3), "right")), i + 20_000)
            flat, count = self._merge(data, starts[order[i:j]], ordered[i:j])
            ids.append(flat)
            counts.append(count)
            i = j
        count = np.concatenate(counts)
        return reorder(np.concatenate(ids), count, np.argsort(order, kind="stable"))

    def _merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest-ranked pair that comes first is merged, in every row at once, until none is left."""
        width, n = int(sizes[-1]), len(sizes)
        first = np.cumsum(sizes) - sizes
        flat = data[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]
        ids = np.zeros((n, width + 1), np.int32)
        rows = np.repeat(np.arange(n), sizes)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[rows, cols] = self.inner[flat]
        ids[np.arange(n), sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        ranks = np.full((n, width), _NONE, np.int32)
        pair = cols < np.repeat(sizes, sizes) - 1
        r, c = rows[pair], cols[pair]
        ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        final, count = np.zeros((n, width), np.uint16), sizes.copy()
        left, live, col = sizes.copy(), np.arange(n), np.arange(width)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            go = best < _NONE
            if not go.all():
                end = ~go
                final[live[end]], count[live[end]] = ids[end, :-1], left[end]
                live, ids, ranks, left, at, best = live[go], ids[go], ranks[go], left[go], at[go], best[go]
            if not len(live):
                break
            left -= 1
            i, keep = np.arange(len(live)), col <= at[:, None]
            ids[:, :-1] = np.where(keep, ids[:, :-1], ids[:, 1:])
            ids[i, at] = self.made[best]
            ranks[:, :-1] = np.where(keep[:, :-1], ranks[:, :-1], ranks[:, 1:])
            ranks[:, -1] = _NONE
            ranks[i, at] = _NONE
            for where in (at - 1, at):
                ok = np.flatnonzero((where >= 0) & (where < left - 1))
                ranks[ok, where[ok]] = self.rank(ids[ok, where[ok]], ids[ok, where[ok] + 1])
        return final[np.arange(width) < count[:, None]], count


def reorder(flat: np.ndarray, count: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of count[i] values each, put in another order."""
    at, count = (np.cumsum(count) - count)[order], count[order]
    return flat[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count


def _classes() -> np.ndarray:
    """Of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 for which a word goes to the library."""
    kind = np.full(256, 4, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[list(b"'<")] = 4
    return kind


_CLASS = _classes()


class Encoder:
    """Ids of words, kept by their hashes."""

    def __init__(self, path: str):
        self.library, self.merges = library(path), Merges(path)
        self.clear()

    def clear(self) -> None:
        self.bits, self.count, self.used = 16, 0, 0
        self.keys, self.at, self.size = (np.zeros(1 << self.bits, t) for t in (np.uint64, np.int32, np.int32))
        self.pool = np.zeros(1 << 16, np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, or -1."""
        return find(self.keys, self.bits, h)

    def _insert(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while (self.count + len(h)) * 2 > 1 << self.bits:
            old, (at, size) = self.keys, (self.at, self.size)
            self.bits += 1
            self.keys, self.at, self.size = (np.zeros(1 << self.bits, t) for t in (np.uint64, np.int32, np.int32))
            full = np.flatnonzero(old)
            slots = place(self.keys, self.bits, old[full])
            self.at[slots], self.size[slots] = at[full], size[full]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        slots = place(self.keys, self.bits, h)
        self.at[slots], self.size[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.count += len(h)

    def units(self, block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
        """What is looked up: pre-tokens of ordinary words, other words whole; which are whole; the bytes in lower case.

        A word is ordinary if it has only ASCII and the letters U+00C0-U+00FF, and neither ' nor <.
        """
        w, n = spans(block), int(block.bounds[-1])
        raw = block.data
        kind = _CLASS[raw[:n]]
        low = raw.copy()
        low[:n] += ((raw[:n] >= 65) & (raw[:n] <= 90)).view(np.uint8) << 5
        lead = np.flatnonzero(raw[:n] == 0xC3)
        tail = raw[lead + 1]
        good = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[good], tail[good]
        kind[lead] = kind[lead + 1] = 1
        low[lead + 1] += (tail <= 0x9E).astype(np.uint8) << 5
        odd = np.zeros(n + 1, np.int32)
        np.cumsum(kind == 4, out=odd[1:])
        odd = odd[w.ends] > odd[w.starts]
        new = np.empty(n, bool)
        new[0], new[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new &= kind > 0
        for a, b in zip(w.starts[odd].tolist(), w.ends[odd].tolist(), strict=True):
            new[a:b] = False
        new[w.starts] = True
        starts = np.flatnonzero(new)
        own = np.searchsorted(w.starts, starts, "right") - 1
        ends = w.ends[own]
        same = np.flatnonzero(own[1:] == own[:-1])
        ends[same] = starts[same + 1]
        whole = odd[own]
        h = hashes(low, starts, ends)
        if (k := np.flatnonzero(whole)).size:
            h[k] = hashes(raw, starts[k], ends[k])
        return Words(starts, ends, h, np.searchsorted(starts, block.bounds)), whole | (ends - starts > _LONG), low

    def learn(self, block: Block, w: Words, whole: np.ndarray, low: np.ndarray, which: np.ndarray) -> None:
        """Adds the units numbered which, whose hashes are absent."""
        h, first = np.unique(w.hash[which], return_index=True)
        rows = which[first]
        hard = whole[rows]
        order = np.concatenate([np.flatnonzero(~hard), np.flatnonzero(hard)])
        ids, count = [], []
        if (easy := rows[~hard]).size:
            flat, n = self.merges.encode(low, w.starts[easy], w.ends[easy] - w.starts[easy])
            ids.append(flat)
            count.append(n)
        if hard.any():
            texts = [block.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8") for i in rows[hard]]
            got = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            ids += [np.array(x, np.uint16) for x in got]
            count.append(np.array([len(x) for x in got], np.int64))
        self._insert(h[order], np.concatenate(count), np.concatenate(ids))

    def slots(self, block: Block, units: tuple[Words, np.ndarray, np.ndarray], which: np.ndarray | None = None) -> np.ndarray:
        """The slot of each unit, or of those numbered which, after learning those it lacked."""
        if self.count > MAX_WORDS or self.used > MAX_POOL:
            self.clear()
        h = units[0].hash if which is None else units[0].hash[which]
        s = self.find(h)
        if (lacks := np.flatnonzero(s < 0)).size:
            self.learn(block, *units, lacks if which is None else which[lacks])
            s = self.find(h)
        return s

    def sizes(self, block: Block, units: tuple[Words, np.ndarray, np.ndarray], which: np.ndarray | None = None) -> np.ndarray:
        """How many tokens each unit, or each of those numbered which, has."""
        s = self.slots(block, units, which)
        return self.size[s]

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts one after another, and where each text's begin (one more at the end)."""
        if not block.bounds[-1]:
            return np.zeros(0, np.uint16), np.zeros(len(block.bounds), np.int64)
        units = self.units(block)
        s, w = self.slots(block, units), units[0]
        size = self.size[s]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.at[s] - (ends - size), size) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[w.at]


def find(keys: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Slots of hashes in an open-addressing table of 2^bits keys (0: free), or -1."""
    last = np.uint64((1 << bits) - 1)
    slot = h & last
    got = keys[slot]
    out = np.where(got == h, slot.astype(np.int64), -1)
    seek = np.flatnonzero((got != h) & (got != 0))
    slot = slot[seek]
    while len(seek):
        slot = (slot + np.uint64(1)) & last
        got, want = keys[slot], h[seek]
        hit = got == want
        out[seek[hit]] = slot[hit]
        go = ~hit & (got != 0)
        seek, slot = seek[go], slot[go]
    return out


def place(keys: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Puts distinct absent hashes into the table; their slots."""
    last = np.uint64((1 << bits) - 1)
    slot, wait = h & last, np.arange(len(h))
    while len(wait):
        free = wait[keys[slot[wait]] == 0]
        _, one = np.unique(slot[free], return_index=True)
        put = free[one]
        keys[slot[put]] = h[put]
        placed = np.zeros(len(h), bool)
        placed[put] = True
        wait = wait[~placed[wait]]
        slot[wait] = (slot[wait] + np.uint64(1)) & last
    return slot.astype(np.int64)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """This worker's encoder; it keeps its table from task to task."""
    return Encoder(path)


CACHES.append(encoder.cache_clear)


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
