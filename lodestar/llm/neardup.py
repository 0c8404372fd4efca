"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, verified on full shingle sets.

Register i of a set is floor(1 - log_B(min h_i)), where h_i are exponential hashes with rate A, truncated to
0 .. Q + 1: sketches merge by the maximum, and with B near 1 two sets agree in a register about as often as
their similarity says. BANDS bands of ROWS registers find candidates; a pair of similarity 0.8 shares no
band with probability (1 - 0.8^5)^32 = 3e-6.

How hot groups are handled, without a pair cap:
1. Equal sets are one class, found by a 128-bit sum over the set (a partial aggregate), and go on as one.
2. In each bucket every class is compared with the bucket's least id and with the id whose buckets are fullest,
   which near copies are likeliest to be copies of: rows, not pairs, of the bucket.
3. Of components of the links so far, only buckets that still hold two components and three classes have
   untested pairs: those of the rows outside the bucket's largest component, the rest, with all its rows. Blocks
   of the rest meet slices of the bucket, so rows are linear in a bucket as long as its rest is small.
4. A bucket whose rest is over LARGE is dealt anew by FRESH bands of FRESH_ROWS registers that no one has used yet
   (a pair of similarity 0.8 shares none with probability (1 - 0.8^8)^64 = 8e-6), then goes through 2 and 3 again.
Pairs within a component are skipped, as no further link could change the result, and a tile emits at most one
link per component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordscan
from lodestar.llm.common import arrow_map, drop, in_batches, written
from lodestar.llm.components import components

BANDS, ROWS = 32, 5
B, A, Q = 1.001, 20.0, (1 << 16) - 2
MARGIN = 0.16
"""A pair goes on if its estimate is no more than this below the threshold: 5 standard deviations at 160 registers."""
GATE = 0.2
"""A pair is estimated if the share of equal registers is no more than this below: 6 standard deviations."""
BLOCK, SLICE = 512, 2048
"""Rows of a bucket's rest, and of the bucket, that meet in a tile."""
LARGE, FRESH, FRESH_ROWS = 4096, 64, 8
MAX_BROADCAST = 1 << 20
"""Ids, of 8 bytes each, that may be broadcast."""

_M = BANDS * ROWS
_ALL = _M + FRESH * FRESH_ROWS
_RNG = np.random.default_rng(20_240_229)
_XOR = _RNG.integers(0, 1 << 64, _ALL, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, _ALL, np.uint64) | np.uint64(1)


def shingles(w: wordscan.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n-word shingles and where each text's begin; the whole text is one if it has fewer words."""
    docs = len(w.at) - 1
    start, owner = wordscan.window_owner(w.at, n)
    h = wordscan.windows(w.hash, n)[start] if len(start) else np.zeros(0, np.uint64)
    count = np.diff(w.at)
    for k in range(1, n):
        if (few := np.flatnonzero(count == k)).size:
            h = np.append(h, wordscan.mix(wordscan.windows(w.hash, k)[w.at[few]] + np.uint64(k)))
            owner = np.append(owner, few)
    key = wordscan.mix(h + wordscan.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    h, owner = h[first], owner[first]
    order = np.argsort(owner, kind="stable")
    return h[order], np.searchsorted(owner[order], np.arange(docs + 1))


def registers(h: np.ndarray, at: np.ndarray, first: int = 0, end: int = _M) -> np.ndarray:
    """A row of the 16-bit registers first .. end - 1 for each set with an element; at must have no empty range."""
    low = np.empty((len(at) - 1, end - first), np.uint64)
    for i in range(first, end):
        low[:, i - first] = np.minimum.reduceat((h ^ _XOR[i]) * _ODD[i], at[:-1])
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    value = np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B))
    return np.clip(value, 0, Q + 1).astype(np.uint16)


def compared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two matrices of registers, in how many the first is greater, less, equal."""
    more, less = (x > y).sum(-1), (x < y).sum(-1)
    return more, less, x.shape[-1] - more - less


def likelihood(j: np.ndarray, more, less, same, nx, ny) -> np.ndarray:
    """The logarithm of the likelihood of a similarity, unimodal in it, given compared registers and the sets' sizes.

    With u, v the shares of the sizes, a register of the first is greater with probability p(u - vJ), less with
    p(v - uJ), where p(z) = -log_B(1 - z (B - 1) / B).
    """
    u, v = nx / (nx + ny), ny / (nx + ny)
    a, b = (-np.log1p(-np.clip(z, 1e-12, 1) * (B - 1) / B) / np.log(B) for z in (u - v * j, v - u * j))
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by golden section."""
    counts = compared(x, y)
    low, high = np.zeros(np.shape(nx)), np.minimum(nx / ny, ny / nx)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        c, d = high - g * (high - low), low + g * (high - low)
        left = likelihood(c, *counts, nx, ny) > likelihood(d, *counts, nx, ny)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity of greatest likelihood is least or more: the likelihood still grows there, as it is unimodal."""
    counts = compared(x, y)
    near = np.minimum(least, 0.999 * np.minimum(nx / ny, ny / nx))
    return likelihood(near + 1e-4, *counts, nx, ny) >= likelihood(near, *counts, nx, ny)


def sketches(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, n_shingles, f1, f2 (together the set's fingerprint), registers (null for an empty set)."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in wordscan.blocks(batch.column(1), lower=True):
            h, at = shingles(wordscan.words(block), n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            regs = [None] * len(size)
            if len(some):
                begin = np.append(at[some], at[-1])
                f1[some] = np.add.reduceat(wordscan.mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin[:-1])
                f2[some] = np.add.reduceat(wordscan.mix(h + np.uint64(0x14057B7EF767814F)), begin[:-1])
                r = registers(h, begin)
                for k, i in enumerate(some.tolist()):
                    regs[i] = r[k].tobytes()
            yield {"id": batch.column(0).slice(block.first, len(size)), "n_shingles": size, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "registers": pa.array(regs, pa.binary())}

    return arrow_map(docs.select(F.col(key).cast("long"), text), "id long, n_shingles long, f1 long, f2 long, registers binary", work)


def _texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id, text of the documents in ids. Up to MAX_BROADCAST ids are broadcast, so that texts needn't move; more are joined by a shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "id", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, elements: the whole sets, as sorted 48-bit hashes, of the documents in ids.

    Two different shingles of a pair of sets of 10^4 share 48 bits with probability below 10^-6.
    """
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in wordscan.blocks(batch.column(1), lower=True):
            h, at = shingles(wordscan.words(block), n)
            cut = h >> np.uint64(16)
            sets = [np.sort(cut[a:b]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield {"id": batch.column(0).slice(block.first, len(sets)), "elements": pa.array(sets, pa.binary())}

    return arrow_map(_texts(docs, ids, key, text), "id long, elements binary", work)


def elements(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _buckets(reps: DataFrame) -> DataFrame:
    """id, bucket: a row for each band of each class."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        yield {"id": batch.column(0).take(pa.array(np.repeat(np.arange(len(r)), BANDS))), "bucket": _banded(r, np.uint64(0)).ravel().view(np.int64)}

    return arrow_map(reps.select("id", "registers"), "id long, bucket long", work)


def _banded(r: np.ndarray, seed) -> np.ndarray:
    """A hash of each band of rows of bands of registers."""
    h = wordscan.mix(np.arange(r.shape[1], dtype=np.uint64)[None, :] + np.uint64(1) + seed)
    for k in range(r.shape[2]):
        h = wordscan.mix(h + r[:, :, k])
    return h


def _anew(rows: DataFrame, docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, bucket: rows (id, bucket) dealt into smaller buckets, within their own, by fresh registers."""
    ids = written(rows.select("id").distinct(), "ids")
    texts = _texts(docs, ids, key, text)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in wordscan.blocks(batch.column(1), lower=True):
            h, at = shingles(wordscan.words(block), n)
            r = registers(h, at, _M, _ALL).reshape(-1, FRESH, FRESH_ROWS)
            yield {"id": batch.column(0).slice(block.first, len(at) - 1), "bands": pa.array([x.tobytes() for x in _banded(r, np.uint64(0))], pa.binary())}

    bands = written(arrow_map(texts, "id long, bands binary", work), "fresh")

    def deal(batch: pa.RecordBatch) -> Iterator[dict]:
        own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, FRESH)
        out = wordscan.mix(own + wordscan.mix(batch.column(1).to_numpy().view(np.uint64))[:, None])
        yield {"id": batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), FRESH))), "bucket": out.ravel().view(np.int64)}

    return arrow_map(rows.join(bands, "id").select("id", "bucket", "bands"), "id long, bucket long", deal)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 x intersection >= percent x union: first by likelihood, then on full sets."""

    def estimated(batch: pa.RecordBatch) -> Iterator[dict]:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, _M) for i in (2, 3))
        nx, ny = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
        ok = pa.array(np.flatnonzero(likely(x, y, nx, ny, percent / 100 - MARGIN)))
        yield {"a": batch.column(0).take(ok), "b": batch.column(1).take(ok)}

    def exact(batch: pa.RecordBatch) -> Iterator[dict]:
        ok = []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            both = np.sort(np.concatenate([elements(x), elements(y)]))
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                ok.append(i)
        yield {"a": batch.column(0).take(pa.array(ok, pa.int64())), "b": batch.column(1).take(pa.array(ok, pa.int64()))}

    def beside(pairs: DataFrame, own: DataFrame) -> DataFrame:
        columns = [c for c in own.columns if c != "id"]
        for end in "ba":  # the end with fewer repetitions first
            pairs = pairs.join(own.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return pairs.select("a", "b", *[f"{c}_{end}" for c in columns for end in "ab"])

    near = beside(pairs.distinct(), reps.select("id", "registers", "n_shingles"))
    near = near.where(f"100 * least(n_shingles_a, n_shingles_b) >= {percent} * greatest(n_shingles_a, n_shingles_b)")
    hopeful = written(arrow_map(near, "a long, b long", estimated), "likely")
    ids = written(hopeful.select(F.col("a").alias("id")).union(hopeful.select("b")).distinct(), "ids")
    sets = written(full_sets(docs, ids, key, text, shingle), "sets")
    out = written(arrow_map(beside(hopeful, sets), "a long, b long", exact).distinct(), "verified")
    drop(hopeful, ids, sets)
    return out


def _tiled(rows: DataFrame, schema: str, work) -> DataFrame:
    """Runs work over each tile, all rows with equal (bucket, i, j), at most BLOCK + SLICE or so; it yields tuples of schema."""
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            keys = np.stack([t[c].to_numpy() for c in ("bucket", "i", "j")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            rest = t.slice(cut)
            if cut:
                yield of(t.slice(0, cut), np.append(0, ends))
        if rest is not None and rest.num_rows:
            yield of(rest, np.array([0, rest.num_rows]))

    def of(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        own = {c: t[c].to_numpy() for c in ("bucket", "i", "j", "role", "id", "root", "n_shingles")}
        own["registers"] = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(-1, _M)
        own["elements"] = t["elements"] if "elements" in t.column_names else None
        out = [row for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for row in work(own, s, e)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names)

    return in_batches(dealt, run, schema)


QUERY, TARGET = 1, 2
"""Roles of a row in a tile: of the rest that is compared, and of the slice that it is compared with."""


def _near(t: dict, s: int, e: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers x, y of a tile's pairs of different components that may be links."""
    role, size, root, regs = (t[c][s:e] for c in ("role", "n_shingles", "root", "registers"))
    query, target = np.flatnonzero(role & QUERY), np.flatnonzero(role & TARGET)
    found: list[tuple[np.ndarray, np.ndarray]] = [(query[:0], query[:0])]
    columns = np.ascontiguousarray(regs[target].T)
    for c in range(0, len(query), 64):
        q = query[c : c + 64]
        same = np.zeros((len(q), len(target)), np.uint8)
        for k in range(_M):
            same += regs[q, k][:, None] == columns[k][None, :]
        ok = (same >= _M * (percent / 100 - GATE)) & (root[q][:, None] != root[target][None, :])
        ok &= 100 * np.minimum(size[q][:, None], size[target][None, :]) >= percent * np.maximum(size[q][:, None], size[target][None, :])
        a, b = np.nonzero(ok)
        x, y = q[a], target[b]
        for f in range(0, len(x), 8192):
            p, r = x[f : f + 8192], y[f : f + 8192]
            good = likely(regs[p], regs[r], size[p].astype(float), size[r].astype(float), percent / 100 - MARGIN)
            found.append((p[good], r[good]))
    x, y = (s + np.concatenate(f) for f in zip(*found, strict=True))
    return x, y


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements sets[x[i]] and sets[y[i]] share: by products of indicator matrices or pair by pair, as is cheaper."""
    rows, cols = np.unique(x), np.unique(y)
    own = [sets[r] for r in rows.tolist()]
    every = np.unique(np.concatenate(own))
    if len(rows) * len(cols) * len(every) > 400_000 * len(x) + 400 * sum(len(sets[r]) for r in x.tolist()):
        out = np.empty(len(x), np.int64)
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            both = np.sort(np.concatenate([sets[a], sets[b]]))
            out[i] = (both[1:] == both[:-1]).sum()
        return out
    total = np.zeros((len(rows), len(cols)), np.float32)

    def placed(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(group), np.repeat(np.arange(len(group)), [len(g) for g in group])
        at = np.minimum(np.searchsorted(every, flat), len(every) - 1)
        there = every[at] == flat
        order = np.argsort(at[there], kind="stable")
        return owner[there][order], at[there][order]

    (i, a), (j, b) = placed(own), placed([sets[c] for c in cols.tolist()])
    for c in range(0, len(every), 2048):
        left, right = np.zeros((len(rows), 2048), np.float32), np.zeros((len(cols), 2048), np.float32)
        k, m = (slice(*np.searchsorted(z, (c, c + 2048))) for z in (a, b))
        left[i[k], a[k] - c] = 1
        right[j[m], b[m] - c] = 1
        total += left @ right.T
    return total[np.searchsorted(rows, x), np.searchsorted(cols, y)].astype(np.int64)


def _open(shared: DataFrame, first: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components of first and three classes: bucket, main, n, rest, id, root, n_shingles, registers.

    main: the root of most of the bucket's rows; n: its rows; rest: those that aren't of main.
    """
    rows = shared.where("n > 2").select("bucket", "id").join(first, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    parts = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    kinds = parts.groupBy("bucket").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    kinds = written(kinds, "kinds")
    return rows.join(kinds, "bucket").join(reps.select("id", "n_shingles", "registers"), "id").select("bucket", "main", "n", "rest", "id", "root", "n_shingles", "registers")


def _untested(mixed: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the buckets that _open gives.

    A tile holds a block of a bucket's rest against a slice of the bucket. A first pass keeps the rows with a near row
    of another component; a second, with their full sets, tests their pairs: it emits fewer links than the tile
    has components, never pairs.
    """
    blocks, slices = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("n") / SLICE).cast("int")
    block = F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("id"), blocks).cast("int"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int")
    as_target = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.when(i == block, QUERY | TARGET).otherwise(TARGET).alias("role")))
    as_query = F.transform(F.sequence(F.lit(0), slices - 1), lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(QUERY).alias("role")))
    more = F.when(block.isNull(), F.slice(as_query, 1, 0)).otherwise(F.filter(as_query, lambda r: r["j"] != own))
    tiled = mixed.withColumn("tile", F.explode(F.concat(as_target, more))).select("bucket", "tile.i", "tile.j", "tile.role", "id", "root", "n_shingles", "registers")

    def taking_part(t: dict, s: int, e: int) -> Iterator[tuple]:
        for k in np.unique(np.concatenate(_near(t, s, e, percent))).tolist():
            yield tuple(int(t[c][k]) for c in ("bucket", "i", "j", "role", "id", "root"))

    part = written(_tiled(tiled, "bucket long, i long, j long, role long, id long, root long", taking_part), "part")
    ids = written(part.select("id").distinct(), "ids")
    sets = written(full_sets(docs, ids, key, text, shingle), "sets")
    sizes = mixed.select("id", "n_shingles", "registers").dropDuplicates(["id"])
    rows = part.join(sizes, "id").join(sets, "id")

    def linked(t: dict, s: int, e: int) -> Iterator[tuple]:
        x, y = _near(t, s, e, percent)
        if not len(x):
            return
        held = [elements(b) for b in t["elements"].slice(s, e - s).to_pylist()]
        common = _common(held, x - s, y - s)
        size = np.array([len(h) for h in held])
        good = np.flatnonzero(100 * common >= percent * (size[x - s] + size[y - s] - common))
        up: dict[int, int] = {}

        def find(r: int) -> int:
            while up.get(r, r) != r:
                up[r] = up.get(up[r], up[r])
                r = up[r]
            return r

        for p, q in zip(x[good].tolist(), y[good].tolist(), strict=True):
            a, b = find(int(t["root"][p])), find(int(t["root"][q]))
            if a != b:
                up[max(a, b)] = min(a, b)
                yield int(t["id"][p]), int(t["id"][q])

    out = written(_tiled(rows, "a long, b long", linked), "tiles")
    drop(part, ids, sets)
    return out


def _stars(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, bucket): those of buckets of two and more with the bucket's n, and the pairs (a, b) of each with its leads.

    Leads: the least id, and the id whose buckets are the fullest, so the text that others are copies of, if it's there.
    What is summed up by bucket is written before it is joined: a join whose sides are both dealt out for it alone can
    be split where a bucket is hot.
    """
    leads = written(bands.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    shared = written(bands.join(leads, "bucket"), "buckets")
    drop(leads)
    fame = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    second = written(shared.where("n > 2").join(fame, "id").groupBy("bucket").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("other")), "seconds")
    stars = shared.select(F.col("lead").alias("a"), F.col("id").alias("b")).union(shared.join(second, "bucket").select("other", "id"))
    return shared, stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (the least key reachable over links, itself included), kept (key = component_id) of every row.

    A text without words, or null, has an empty set and is linked with nothing; with fewer words than a shingle,
    all its words are one shingle. Rows with one key are one node. Rows with a null key take no part: their
    component is null, and they are kept. An empty table gives an empty one. Keys are integers.
    """
    base = written(sketches(docs, key, text, shingle), "sketches")
    full = base.where("n_shingles > 0 and id is not null")
    reps = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("id"), F.first("registers").alias("registers")), "classes")
    bands = written(_buckets(reps), "bands")
    shared, pairs = _stars(bands)
    links = _verified(pairs, reps, docs, key, text, shingle, percent)
    first = components(links)
    rows = written(_open(shared, first, reps), "open")
    drop(bands, shared, links)
    found = [_untested(rows.where(F.col("rest") <= LARGE), docs, key, text, shingle, percent)]
    hot = rows.where(F.col("rest") > LARGE).select("id", "bucket")
    if not hot.isEmpty():
        bands = written(_anew(hot, docs, key, text, shingle), "bands")
        shared, pairs = _stars(bands)
        found.append(_verified(pairs, reps, docs, key, text, shingle, percent))
        second = _merged(first, found)
        last = written(_open(shared, second, reps), "open")
        drop(bands, shared)
        found.append(_untested(last, docs, key, text, shingle, percent))
        drop(last)
    roots = _merged(first, found)
    drop(rows, *found)
    named = reps.select("f1", "f2", "n_shingles", "id").join(roots, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    out = base.select("id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _merged(roots: DataFrame, links: list[DataFrame]) -> DataFrame:
    """components of what components gave and more links."""
    every = roots.select(F.col("root").alias("a"), F.col("id").alias("b"))
    for more in links:
        every = every.union(more)
    return components(every)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which groups() keeps the key. Repeated rows of a kept key all stay: they are one node.

    Rows with a null key stay. Columns are as they were, whatever their names.
    """
    gone = groups(docs, key, text, shingle, percent).where(~F.col("kept")).select(F.col(key)).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)
