"""Benchmark decontamination: latent semantic retrieval of passages, then longest common subsequence and answer checks.

Words are runs of ASCII letters, digits and bytes from 0x80, in lower case. A passage is STEP * 2 words of a
document, one every STEP words; an item's passages follow one another. Passages are TF-IDF vectors over
2^BITS hashed words, with document frequencies counted over all documents. A randomised SVD, computed by
executors over all passages of all documents and of the benchmark, gives RANK latent directions; documents and
benchmark count alike, whichever has more passages. Every passage of every
document is compared with all items' passages: the product of the two latent vectors by the
length of the item's latent and of the document's whole vector, so that what a document has besides counts
against it. An exact copy reaches the share of the item's length that the latent space keeps; candidates are
pairs that reach COSINE of this share, and whose common words have OVERLAP of the squared IDF of the one
that has more. For an item shorter than a passage both count against the item's own length and weight, as the rest of
the passage isn't its own; its verbatim copies are candidates in any case, found by its rarest word and compared
word by word. There the document's words around the aligned place are compared with the item's by their longest
common subsequence, whose share of the item is the coverage. A copy has a coverage of COPY; from PARAPHRASE
on, the answer words of the item, its KEYS rarest ones, must be there too, ANSWERED of them at least.

Both tests of a candidate must hold, so their order doesn't matter: pairs that can't reach OVERLAP are left out
before any latent vector is made. Of two sets of words, each without its lightest ones that weigh less than OVERLAP
together, the heaviest common word is in both; an inverted index of the items' words gives just these pairs. So the
work grows with the pairs that share heavy words, not with all passages times all items.

The model, the frequencies and the items go to every task as broadcasts of bounded size (a benchmark over
MAX_ITEMS items is worked on in parts, the model being made once), so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import tokens, wordscan
from lodestar.llm.common import arrow_map, drop, give_back, in_batches, written
from lodestar.llm.toxicity import _BETWEEN

BITS, RANK, EXTRA, POWER = 13, 128, 8, 2
STEP = 10
COSINE, OVERLAP = 0.2, 0.2
COPY, PARAPHRASE, KEYS, ANSWERED = 0.8, 0.5, 5, 2
BLOCK_BYTES = 1 << 18
"""Texts are searched in blocks of about so many bytes, whose latent vectors fit a cache."""
MAX_ITEMS = 20_000
MIN_WORDS = 5
"""Items of fewer words are found only word for word."""


def read(block: wordscan.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where texts begin."""
    w = wordscan.spans(block, _BETWEEN)
    return wordscan.hashes(wordscan.lowered(block), w.starts, w.ends), w.at


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def steps(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of STEP words begin (the last of a text may be shorter), and where each text's runs begin."""
    n = -(-np.diff(at) // STEP)
    runs = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(at[:-1] - runs[:-1] * STEP, n) + np.arange(runs[-1]) * STEP, runs


@dataclass
class Model:
    """vectors: per bucket its latent vector times its IDF. idf: per bucket."""

    vectors: np.ndarray
    idf: np.ndarray

    def latent(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of passages by the length of their TF-IDF vectors, and this length.

        A word that a passage repeats counts for the length as two words.
        """
        place = begin[:, None] + np.arange(2 * STEP)
        there = place < end[:, None]
        own = bucket(h[np.minimum(place, len(h) - 1)])
        length = np.sqrt((self.idf[own] ** 2 * there).sum(1)) + np.float32(1e-9)
        sums = np.zeros((len(begin), self.vectors.shape[1]), np.float32)
        for k in range(2 * STEP):
            sums += self.vectors[own[:, k]] * there[:, k, None]
        return sums / length[:, None], length


def passages(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages, two runs each, and their texts. A text of one run is one passage."""
    begin, runs = steps(at)
    n = np.diff(runs)
    owner = np.repeat(np.arange(len(n)), n)
    keep = np.append(owner[1:] == owner[:-1], False)[: len(owner)] | (n[owner] == 1)
    return begin[keep], owner[keep]


TEXTS = 256
"""Texts whose buckets are marked at once: so many times 2^BITS bytes."""


def bucketed(texts: DataFrame) -> DataFrame:
    """Of each text, the only column, the buckets of its words, 2 bytes each, written once for all passes."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in wordscan.blocks(batch.column(0)):
            h, at = read(block)
            own = bucket(h).astype("<i2").tobytes()
            yield {"words": pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int64)), pa.py_buffer(own)]).cast(pa.binary())}

    return written(arrow_map(texts, "words binary", work), "buckets")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of bucketed texts, and where texts begin."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view("<i2"), (bounds - bounds[0]) // 2


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the number of documents with it, of all bucketed documents; and how many these are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            own, at = _texts(batch.column(0))
            for i in range(0, len(at) - 1, TEXTS):
                part = at[i : i + TEXTS + 1]
                seen = np.zeros((len(part) - 1, 1 << BITS), bool)
                seen[np.repeat(np.arange(len(part) - 1), np.diff(part)), own[part[0] : part[-1]]] = True
                total += seen.sum(0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(seen, -1), "n": np.append(total[seen], n)})

    rows = in_batches(texts, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()  # 2^BITS at most
    found = dict(map(tuple, rows))
    out = np.zeros(1 << BITS, np.int64)
    n = found.pop(-1, 0)
    out[list(found)] = list(found.values())
    return out, n


RUNS, MANY, SLICES, WAVES = 4096, 64, 64, 4
"""Runs of words worked on at once, and how often a bucket occurs there to be summed by a product of matrices; parts in which sums
of buckets travel; tasks of a pass for each core, each of which sends all sums."""


def _lengths(own: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Squared lengths of TF-IDF vectors of passages, a row of buckets each: of a word that is there n times, n^2 its squared IDF."""
    own = np.sort(own, axis=1).T
    square = idf**2
    total, again = square[own[0]], np.zeros(own.shape[1], np.float32)
    for k in range(1, len(own)):
        again = np.where(own[k] == own[k - 1], again + 2, 0)
        total += square[own[k]] * (again + 1)
    return total


def _add(own: np.ndarray, share: np.ndarray, total: np.ndarray) -> None:
    """Adds to each bucket's row of total the row of share of each place in own. The last bucket is none."""
    order = np.argsort(own.ravel(), kind="stable")
    found = own.ravel()[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    n = np.diff(np.append(first, len(found)))
    name = found[first]
    many = (n > MANY) & (name != len(total) - 1)
    if many.any():
        number = np.full(len(total), -1)
        number[name[many]] = np.arange(many.sum())
        counts = np.zeros((many.sum(), len(own)), np.float32)
        for k in range(own.shape[1]):
            at = number[own[:, k]]
            run = np.flatnonzero(at >= 0)
            counts[at[run], run] += 1  # a run is there once
        total[name[many]] += counts @ share
    few = np.flatnonzero(~many & (name != len(total) - 1))
    few = few[np.argsort(-n[few], kind="stable")]  # those that occur k times or more come first
    sums = np.zeros((len(few), share.shape[1]), np.float32)
    run, room = order // own.shape[1], np.empty_like(sums)
    for k, m in enumerate(np.searchsorted(-n[few], -np.arange(n[few].max(initial=0)), "left")):
        sums[:m] += share.take(run[first[few[:m]] + k], axis=0, out=room[:m], mode="clip")
    total[name[few]] += sums


def gram(h: np.ndarray, at: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> int:
    """Adds A'A q by IDF to total, a row of A being the TF-IDF vector, of length 1, of each passage of texts; how many these are.

    To a total with as many rows as q has columns it adds q'A'A q, which takes less. weighted: q times IDF. Both have a last row of zeros, for the places behind a run's words. A passage is a run and the next,
    so a run's words are summed, and take their share, once for both passages that they are in.
    """
    return _gram(bucket(h), at, weighted, idf, total)


def _gram(words: np.ndarray, at: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> int:
    """gram of words' buckets."""
    begin, runs = steps(at)
    stop = np.repeat(at[1:], np.diff(runs))
    last = np.zeros(len(begin), bool)
    last[runs[1:][np.diff(runs) > 0] - 1] = True
    none = len(idf) - 1
    of = np.append(words, none).astype(np.int16)
    for c in range(0, len(begin), RUNS):
        low, high = max(0, c - 1), min(len(begin), c + RUNS + 1)  # the passages of these runs: from one run before to one behind
        place = begin[low:high, None] + np.arange(STEP)
        own = of[np.where(place < stop[low:high, None], place, len(words))]
        sums = np.zeros((len(own), weighted.shape[1]), np.float32)
        room = np.empty_like(sums)
        for k in range(STEP):
            sums += weighted.take(own[:, k], axis=0, out=room, mode="clip")
        follows = np.append(~last[low : high - 1], False)
        after = np.where(follows[:, None], np.append(own[1:], own[:1], axis=0), np.int16(none))
        sums[:-1] += sums[1:] * follows[:-1, None]
        square = (_lengths(np.concatenate([own, after], axis=1), idf) + np.float32(1e-9))[:, None]
        if len(total) == total.shape[1]:
            sums = (sums / np.sqrt(square))[c - low : c - low + RUNS]
            total += sums.T @ sums
            continue
        sums /= square
        share = sums.copy()
        share[1:] += sums[:-1] * follows[:-1, None]
        own, share = own[c - low : c - low + RUNS], share[c - low : c - low + RUNS]
        _add(own, share, total)
    return len(begin)


def _applied(texts: DataFrame, q: np.ndarray, idf: np.ndarray, last: bool = False) -> np.ndarray:
    """A'A q, or q'A'A q if last, of all passages of all bucketed texts, by their number.

    Tasks send sums, which others add up by SLICES.
    """
    spark, shape = texts.sparkSession, (q.shape[1] if last else len(q), q.shape[1])
    zero = np.zeros((1, shape[1]), np.float32)
    table = spark.sparkContext.broadcast((np.concatenate([(q * idf[:, None]).astype(np.float32), zero]), np.append(idf, 0).astype(np.float32)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weighted, own), n = table.value, 0
        total = np.zeros((shape[0] + (not last), shape[1]), np.float32)
        for batch in batches:
            n += _gram(*_texts(batch.column(0)), weighted, own, total)
        if n:
            parts = [x.tobytes() for x in np.split(total[: shape[0]].ravel(), SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": np.arange(SLICES), "n": np.full(SLICES, n), "part": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = got.setdefault(r["slice"], [0, 0.0])
                own[0] += r["n"]
                own[1] = own[1] + np.frombuffer(r["part"], np.float32).astype(np.float64)
        if got:
            yield pa.RecordBatch.from_pydict({"slice": list(got), "n": [x[0] for x in got.values()], "part": pa.array([x[1].tobytes() for x in got.values()], pa.binary())})

    schema = "slice long, n long, part binary"
    few = texts.coalesce(WAVES * spark.sparkContext.defaultParallelism)
    got = in_batches(in_batches(few, part, schema).repartition(8, "slice"), add, schema).collect()
    table.destroy()
    out = np.zeros(shape)
    for r in got:
        out.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(r["part"]) / r["n"]
    return out if last else out * idf[:, None]


def fit(docs: DataFrame, items: DataFrame, key: str, text: str) -> Model:
    """The model of all passages of items, a table with a column text, and of docs, whose key doesn't matter.

    Randomised SVD: Q spans POWER + 1 applications of A'A to random directions, each a pass of the executors over all texts.
    """
    texts = [bucketed(docs.select(text)), bucketed(items.select("text"))]
    seen, n = frequencies(texts[0])
    idf = np.log((n + 1) / (seen + 0.5)).clip(0.01)

    def apply(q: np.ndarray, last: bool = False) -> np.ndarray:
        return sum(_applied(t, q, idf, last) for t in texts)

    q = np.linalg.qr(np.random.default_rng(5).normal(size=(1 << BITS, RANK + EXTRA)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(apply(q))[0]
    small = apply(q, last=True)
    drop(*texts)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis = q @ turn[:, np.argsort(-values)[:RANK]]
    give_back()
    return Model((basis * idf[:, None]).astype(np.float32), idf.astype(np.float32))


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    masks: list[dict[int, int]]
    keys: list[frozenset]
    vectors: np.ndarray
    least: np.ndarray
    square: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    bits: int
    pairs: np.ndarray
    """An open-addressing table of the hashes of (item's number, word)."""
    vocabulary: Vocabulary
    short: np.ndarray
    """Of each passage, whether its item is shorter than a passage of a document."""
    exact: Exact


@dataclass
class Vocabulary:
    """All words of the items, ranked by weight (squared IDF) from 1 on, and for each rank the items that need it.

    long, short: items from the length of a passage on, and below. An item needs its words but the lightest ones that
    weigh less than OVERLAP of its lightest passage together. least: the lightest passage of a long item.
    """

    keys: np.ndarray
    bits: int
    rank: np.ndarray
    words: np.ndarray
    weight: np.ndarray
    long: tuple[np.ndarray, np.ndarray]
    short: tuple[np.ndarray, np.ndarray]
    least: float

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Of words their ranks, or 0."""
        slot = tokens.find(self.keys, self.bits, h)
        return np.where(slot >= 0, self.rank[slot], 0)


_NEARLY = 1 - 1e-4
"""Bounds are lowered by rounding errors of sums, so that the tests that follow decide alone."""


def _vocabulary(words: list[np.ndarray], model: Model, square: np.ndarray, owner: np.ndarray) -> Vocabulary:
    every = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    weight = model.idf[bucket(every)] ** 2
    order = np.lexsort((every, weight))
    every, weight = np.append(np.uint64(0), every[order]), np.append(np.float32(0), weight[order])
    bits = max(4, (2 * len(every)).bit_length())
    keys, rank = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
    rank[tokens.place(keys, bits, every[1:])] = np.arange(1, len(every))
    lightest = np.full(len(words), np.inf)
    np.minimum.at(lightest, owner, square)
    out = Vocabulary(keys, bits, rank, every, weight, (), (), 0.0)
    lists: tuple[list, list] = ([], [])
    for i, h in enumerate(words):
        if np.isfinite(lightest[i]):
            own = np.unique(out.ranks(h))
            own = own[np.cumsum(weight[own], dtype=float) >= OVERLAP * lightest[i] * _NEARLY]
            lists[len(h) < 2 * STEP].append((own, np.full(len(own), i)))
    for name, found in zip(("long", "short"), lists, strict=True):
        r, i = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        order = np.argsort(r, kind="stable")
        setattr(out, name, (np.searchsorted(r[order], np.arange(len(every) + 1)), i[order]))
    out.least = min([float(lightest[i]) for i, h in enumerate(words) if len(h) >= 2 * STEP], default=np.inf)
    return out


def _expand(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row[i] with each of low[i] .. high[i] - 1."""
    n = high - low
    return np.repeat(row, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


@dataclass
class Exact:
    """Items shorter than a passage, in the order of their rarest words' hashes."""

    anchor: np.ndarray
    buckets: np.ndarray
    """Per bucket, whether it has an anchor."""
    item: np.ndarray
    offset: np.ndarray
    n: np.ndarray
    words: np.ndarray
    """A row of 2 * STEP hashes for each item, 0 behind its last."""

    def places(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, items' numbers and first words of all verbatim copies."""
        if not len(self.anchor):
            return at[:0], at[:0], at[:0]
        seen = np.flatnonzero(self.buckets[bucket(h)])
        low, high = np.searchsorted(self.anchor, h[seen]), np.searchsorted(self.anchor, h[seen], "right")
        n = high - low
        seen = np.repeat(seen, n)
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        start = seen - self.offset[row]
        text = np.searchsorted(at, seen, "right") - 1
        ok = (start >= at[text]) & (start + self.n[row] <= at[text + 1])
        for k in range(2 * STEP):
            text, row, start = text[ok], row[ok], start[ok]
            ok = (k >= self.n[row]) | (h[np.minimum(start + k, len(h) - 1)] == self.words[row, k])
        return text[ok], self.item[row[ok]], start[ok]


def _exact(words: list[np.ndarray], model: Model) -> Exact:
    rows = []
    for i, h in enumerate(words):
        if len(h) < 2 * STEP:
            k = int(np.argmax(model.idf[bucket(h)]))
            rows.append((int(h[k]), i, k, len(h), np.pad(h, (0, 2 * STEP - len(h)))))
    rows.sort(key=lambda r: r[:2])
    anchor = np.array([r[0] for r in rows], np.uint64)
    buckets = np.zeros(1 << BITS, bool)
    buckets[bucket(anchor)] = True
    item, offset, n = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
    return Exact(anchor, buckets, item, offset, n, np.array([r[4] for r in rows], np.uint64).reshape(-1, 2 * STEP))


def _pair(item: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = wordscan.mix(h ^ wordscan.mix(item.astype(np.uint64) + np.uint64(1)))
    out[out == 0] = 1
    return out


def prepare(rows: list, model: Model) -> Items:
    ids, words = [], []
    for item, text in rows:
        h, _ = read(next(wordscan.blocks(pa.array([text or ""], pa.large_string()))))
        if len(h):
            ids.append(item)
            words.append(h)
    masks, keys, spans, length, square, owner, offset = [], [], [], [], [], [], []
    for i, h in enumerate(words):
        mask: dict[int, int] = {}
        for k, x in enumerate(h.tolist()):
            mask[x] = mask.get(x, 0) | 1 << k
        masks.append(mask)
        own = np.unique(h)
        keys.append(frozenset(own[np.argsort(-model.idf[bucket(own)], kind="stable")[:KEYS]].tolist()))
        starts = list(range(0, max(1, len(h) - STEP), 2 * STEP)) if len(h) >= MIN_WORDS else []
        for s in starts:
            s = max(0, min(s, len(h) - 2 * STEP))
            own = bucket(h[s : s + 2 * STEP])
            spans.append(model.vectors[own].sum(0))
            square.append(float((model.idf[bucket(np.unique(h[s : s + 2 * STEP]))] ** 2).sum()))
            length.append(np.sqrt((model.idf[own] ** 2).sum()))
            owner.append(i)
            offset.append(s)
    each = np.unique(np.concatenate([_pair(np.full(len(h), i), h) for i, h in enumerate(words)] or [np.zeros(0, np.uint64)]))
    bits = max(4, (2 * len(each)).bit_length())
    pairs = np.zeros(1 << bits, np.uint64)
    tokens.place(pairs, bits, each)
    v = np.array(spans, np.float32).reshape(-1, model.vectors.shape[1])
    norm = np.linalg.norm(v, axis=1) + 1e-9
    short = np.array([len(words[i]) < 2 * STEP for i in owner], bool)
    least = COSINE * norm / np.where(short, np.float32(1), np.array(length, np.float32))
    return Items(ids, words, masks, keys, v / norm[:, None], least, np.array(square, np.float32), np.array(owner, np.int64), np.array(offset, np.int64), bits, pairs, _vocabulary(words, model, np.array(square), np.array(owner, np.int64)), short, _exact(words, model))


def common(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    full = (1 << n) - 1
    v = full
    for x in words:
        if m := mask.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def candidates(h: np.ndarray, begin: np.ndarray, end: np.ndarray, model: Model, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of passages, and of items' passages, that pass both tests: common words, then the cosine of latent vectors.

    Common words: the squared IDF of the words that the passage and the item have, each word counted once, by that of
    the one with more, or of a short item.
    """
    v = items.vocabulary
    place = begin[:, None] + np.arange(2 * STEP)
    own = h[np.minimum(place, len(h) - 1)]
    rank = v.ranks(own.ravel()).reshape(own.shape).astype(np.uint64)
    code = np.where(rank > 0, rank << np.uint64(40), own >> np.uint64(24))
    code = np.sort(np.where(place < end[:, None], code, np.uint64(0)), axis=1)  # words of items last, the heaviest last
    once = code != 0
    once[:, 1:] &= code[:, 1:] != code[:, :-1]
    rank = (code >> np.uint64(40)).astype(np.int64)
    weight = np.where(rank > 0, v.weight[rank], model.idf[(code >> np.uint64(40 - BITS)).astype(np.int64) & ((1 << BITS) - 1)] ** 2) * once
    total = weight.sum(1)
    known = once & (rank > 0)
    most = np.cumsum(weight * known, axis=1)
    row, col = np.nonzero(known & (most >= (OVERLAP * _NEARLY * np.maximum(total, v.least))[:, None]))
    r = rank[row, col]
    p, at = _expand(row, v.long[0][r], v.long[0][r + 1])
    item = v.long[1][at]
    if len(v.short[1]):
        row, col = np.nonzero(known)
        r = rank[row, col]
        more, at = _expand(row, v.short[0][r], v.short[0][r + 1])
        p, item = np.append(p, more), np.append(item, v.short[1][at])
    pair = np.unique(p * len(items.ids) + item)
    p, item = pair // max(1, len(items.ids)), pair % max(1, len(items.ids))
    both = np.empty(len(p), np.float32)
    for c in range(0, len(p), 1 << 16):
        x, i = p[c : c + (1 << 16)], item[c : c + (1 << 16)]
        a, b = np.nonzero(known[x])
        r = rank[x[a], b]
        shared = tokens.find(items.pairs, items.bits, _pair(i[a], v.words[r])) >= 0
        both[c : c + (1 << 16)] = np.bincount(a, v.weight[r] * shared, minlength=len(x))
    k, q = _expand(np.arange(len(p)), np.searchsorted(items.owner, item), np.searchsorted(items.owner, item, "right"))
    p = p[k]
    good = both[k] >= OVERLAP * np.where(items.short[q], items.square[q], np.maximum(total[p], items.square[q]))
    p, q = p[good], q[good]
    some, at = np.unique(p, return_inverse=True)
    vectors, length = model.latent(h, begin[some], end[some])
    near = np.concatenate([np.einsum("ij,ij->i", vectors[at[c : c + 8192]], items.vectors[q[c : c + 8192]]) for c in range(0, len(at), 8192)] or [np.zeros(0)])
    good = near * np.where(items.short[q], length[at], 1) >= items.least[q]
    return p[good], q[good]


def search(block: wordscan.Block, model: Model, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item's number, coverage, common words, answer words found, first word) of each text and item found in it, the best place."""
    h, at = read(block)
    begin, owner = passages(at)
    best: dict[tuple[int, int], tuple] = {}
    tried = set()

    def compare(text: int, i: int, place: int) -> None:
        n = len(items.words[i])
        room = max(STEP, n // 4)
        a, b = max(int(at[text]), place - room), min(int(at[text + 1]), place + n + room)
        if (i, a, b) in tried:
            return
        tried.add((i, a, b))
        own = h[a:b].tolist()
        lcs = common(items.masks[i], n, own)
        if lcs < PARAPHRASE * n:
            return
        found = len(items.keys[i].intersection(own))
        if lcs >= COPY * n or found >= min(ANSWERED, len(items.keys[i])):
            hit = (lcs / n, lcs, found, a - int(at[text]))
            if hit > best.get((text, i), (0,)):
                best[text, i] = hit

    for c in range(0, len(begin), 8192):
        own = owner[c : c + 8192]
        for k, j in zip(*(x.tolist() for x in candidates(h, begin[c : c + 8192], at[own + 1], model, items)), strict=True):
            compare(int(own[k]), int(items.owner[j]), int(begin[c + k]) - int(items.offset[j]))
    for place in zip(*(x.tolist() for x in items.exact.places(h, at)), strict=True):
        compare(*place)
    return [(t, i, *hit) for (t, i), hit in sorted(best.items())]


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[DataFrame]:
    own = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    n = -(-own.count() // MAX_ITEMS)
    for k in range(n):
        yield own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, coverage, common_words, answers_found, first_word: a row for each document and item that it has.

    Null texts are empty; rows with equal or null keys are documents of their own; an item that occurs twice is
    found twice; items under MIN_WORDS words are found only word for word, without words never; empty tables give an
    empty one.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, coverage double, common_words int, answers_found int, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for rows, table in _tables(docs, benchmark, key, text, item, item_text):

        def work(batch: pa.RecordBatch, table=table) -> Iterator[dict]:
            for block in wordscan.blocks(batch.column(1), size=BLOCK_BYTES):
                if hits := search(block, *table.value):
                    t, i, cover, lcs, found, first = zip(*hits, strict=True)
                    ids = table.value[1].ids
                    yield {"key": batch.column(0).take(pa.array(np.array(t) + block.first)), "item": pa.array([ids[x] for x in i], rows), "coverage": np.array(cover), "common_words": np.array(lcs, np.int32), "answers_found": np.array(found, np.int32), "first_word": np.array(first, np.int64)}

        out = out.union(arrow_map(docs.select(key, text), schema, work))
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "coverage", "common_words", "answers_found", "first_word")


def _tables(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str):
    model = fit(docs, benchmark.select(F.col(item_text).alias("text")), key, text)
    for part in _parts(benchmark, item, item_text):
        got = part.toArrow()
        yield got["item"].type, docs.sparkSession.sparkContext.broadcast((model, prepare(list(zip(got["item"].to_pylist(), got["text"].to_pylist(), strict=True)), model)))


def keep(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, all columns as they were, whatever their names.

    Null and empty texts stay; repeated rows are judged alike; an empty table gives an empty one.
    """
    at = docs.columns.index(text)
    out = docs
    for _, table in _tables(docs, benchmark, key, text, item, item_text):

        def work(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for block in wordscan.blocks(batch.column(at), size=BLOCK_BYTES):
                    for hit in search(block, *table.value):
                        ok[block.first + hit[0]] = False
                yield batch.filter(pa.array(ok))

        out = in_batches(out, work, docs.schema)
    return out
