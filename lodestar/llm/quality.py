"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A document fails the base rules if it has under
MIN_WORDS words, or if over MAX_REPEAT percent of its words lie in 5-word windows found twice or more in
it. Others get a probability of good quality; under THRESHOLD they are rejected. The model is trained by the
executors on all labelled rows that pass the base rules: these are dealt by the hash of the id into shards of
about SHARD rows, each task trains on a shard, and the model is the mean of the shards' models, weighted by
their rows. It is calibrated by Platt's method on out-of-fold scores of all these rows. With no row of one of
the labels there is nothing to learn, and documents that pass the base rules are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordscan
from lodestar.llm.common import arrow_map, drop, give_back, in_batches, labelled, summed, trim, written

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
THRESHOLD = 0.25
SHARD = 1200
"""Labelled rows that a task trains on at once, about."""
GRAIN = 1024
"""Scores are counted for the calibration in steps of 1 / GRAIN."""
BITS = 11
"""Word unigrams and bigrams share 2^BITS buckets, character trigrams have as many."""
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def stats(block: wordscan.Block, w: wordscan.Words) -> dict[str, np.ndarray]:
    """The base rules' figures of each text of a block."""
    n, docs = int(block.bounds[-1]), len(block.bounds) - 1
    data = block.data[:n]
    within = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=within[1:])
    symbols = np.zeros(n + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    n_words = np.diff(w.at)
    out = {"n_words": n_words, "word_chars": wordscan.sums(within[w.ends] - within[w.starts], w.at), "n_symbols": symbols[block.bounds[1:]] - symbols[block.bounds[:-1]]}
    # lines with a word, by the hash of the line and the text
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(block.bounds[:-1], cut + 1)
    begin = begin[begin < n]
    end = np.minimum(np.append(begin[1:], n), n)
    stop = np.searchsorted(cut, begin)
    end = np.minimum(end, np.append(cut, n)[stop])
    full = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[full], end[full]
    owner = np.searchsorted(block.bounds, begin, "right") - 1
    key = wordscan.mix(wordscan.hashes(block.data, begin, end) + wordscan.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=docs) - np.bincount(owner[first], minlength=docs)
    # words in windows that a text has more than once
    start, owner = wordscan.window_owner(w.at, WINDOW)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(start):
        key = wordscan.mix(wordscan.windows(w.hash, WINDOW)[start] + wordscan.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, start[again], 1)
        np.add.at(edge, start[again] + WINDOW, -1)
        covered[:-1] = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = wordscan.sums(covered[:-1], w.at)
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def characters(block: wordscan.Block) -> tuple[np.ndarray, np.ndarray]:
    """Each character as the number that its bytes are, and where each text's characters begin."""
    n = int(block.bounds[-1])
    data = block.data[:n]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    four = np.ndarray((n,), "<u4", buffer=block.data, strides=(1,)) if n else np.zeros(0, np.uint32)
    lead = data[starts]
    more = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    return four[starts] & _KEEP[more], np.searchsorted(starts, block.bounds)


def buckets(block: wordscan.Block, w: wordscan.Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, word pairs and character trigrams: bucket numbers, and where each text's begin and end."""
    mask = np.uint64((1 << BITS) - 1)
    one = (w.hash & mask).astype(np.int64)
    pairs = (wordscan.windows(w.hash, 2) & mask).astype(np.int64)
    c, at = characters(block)
    c = np.append(c, np.zeros(2, np.uint32))
    three = ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)).astype(np.int64)
    inner = np.maximum(at[1:] - 2, at[:-1])
    last = np.maximum(w.at[1:] - 1, w.at[:-1])
    return [(one, w.at[:-1], w.at[1:]), (pairs, w.at[:-1], last), (three + (1 << BITS), at[:-1], inner)]


def features(block: wordscan.Block, w: wordscan.Words) -> np.ndarray:
    """A row for each text: shares of the buckets among its n-grams of each kind."""
    docs = len(block.bounds) - 1
    out = np.zeros((docs, 2 << BITS), np.float32)
    for bucket, start, end in buckets(block, w):
        for i in range(docs):
            if end[i] > start[i]:
                out[i] += np.bincount(bucket[start[i] : end[i]], minlength=2 << BITS) / (end[i] - start[i])
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, block: wordscan.Block, w: wordscan.Words) -> np.ndarray:
        total = np.full(len(block.bounds) - 1, self.bias)
        for bucket, start, end in buckets(block, w):
            run = np.zeros(len(bucket) + 1)
            np.cumsum(self.weights[bucket], out=run[1:])
            end = np.minimum(end, len(bucket))
            start = np.minimum(start, end)
            total += (run[end] - run[start]) / np.maximum(end - start, 1)
        return total

    def probability(self, block: wordscan.Block, w: wordscan.Words) -> np.ndarray:
        return sigmoid(self.slope * self.logit(block, w) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on standardised features by Adam, classes weighted alike; weights for raw features."""
    mean, spread = x.mean(0), x.std(0) + 1e-4
    z = (x - mean) / spread
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b, m, v = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        g = ((sigmoid(z @ w + b) - y) * share).astype(np.float32)
        g = np.append(z.T @ g + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / np.sqrt(x.shape[1]) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1].astype(np.float32), b - float(step[-1])
    raw = w / spread
    return raw.astype(np.float64), float(b - mean @ raw)


def platt(score: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1) = sigmoid(slope * score + shift) by Newton's method, targets smoothed as Platt has them.

    times: how often each (score, y) is there.
    """
    n1 = (y * times).sum()
    n0 = times.sum() - n1
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([score, np.ones(len(score))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ theta)
        hess = design.T @ (design * (times * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (times * (p - target)))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def shard_models(rows: pa.Table) -> pa.Table:
    """Weights and bias fitted to a shard's rows of fold 0, of fold 1 and of both, times their number, as far as both labels are there."""
    xs, keep = [], []
    rows = rows.combine_chunks().sort_by("doc_id")
    for block in wordscan.blocks(rows["text"]):
        w = wordscan.words(block)
        ok = np.flatnonzero(~base_failed(stats(block, w)))
        xs.append(features(block, w)[ok])
        keep.append(block.first + ok)
    x, keep = np.concatenate(xs), np.concatenate(keep)
    del xs
    y, fold = rows["label"].to_numpy()[keep].astype(np.float64), rows["fold"].to_numpy()[keep]
    out = []
    for k, own in enumerate((fold == 0, fold == 1, np.ones(len(y), bool))):
        n = int(own.sum())
        if n and y[own].min() != y[own].max():
            w, b = fit(x if k == 2 else x[own], y[own])
            out.append((k, float(n), (np.append(w, b) * n).astype(np.float32).tobytes()))
    trim()
    return pa.table({"slice": pa.array([r[0] for r in out], pa.int64()), "n": pa.array([r[1] for r in out], pa.float64()), "part": pa.array([r[2] for r in out], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows of docs that pass the base rules; None if a label is missing among them.

    A repeated document counts once, with its least text. The driver gets sums of models and counts of scores.
    """
    spark = docs.sparkSession
    once = labelled(docs, labels, "quality").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = written(once.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")), "labelled-quality")
    shards = max(1, round(rows.count() / SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    got = summed(dealt.groupBy("shard").applyInArrow(shard_models, "slice long, n double, part binary"))
    if 2 not in got:
        drop(rows)
        return None
    fitted = {k: Model(part[:-1] / n, float(part[-1] / n)) for k, (n, part) in got.items()}
    table = spark.sparkContext.broadcast([fitted.get(1), fitted.get(0)])  # of each fold the model that hasn't seen it

    def scores(batch: pa.RecordBatch) -> Iterator[dict]:
        label, fold = (batch.column(i).to_numpy() for i in (0, 1))
        for block in wordscan.blocks(batch.column(2)):
            w = wordscan.words(block)
            own = slice(block.first, block.first + len(block.bounds) - 1)
            s = np.zeros(len(block.bounds) - 1)
            for k, model in enumerate(table.value):
                if model:
                    s = np.where(fold[own] == k, model.logit(block, w), s)
            ok = ~base_failed(stats(block, w))
            yield {"label": label[own][ok], "score": np.rint(np.clip(s[ok], -40, 40) * GRAIN).astype(np.int64)}

    counts = arrow_map(rows.select("label", "fold", "text"), "label int, score long", scores).groupBy("label", "score").count().orderBy("label", "score").toArrow()
    slope, shift = platt(counts["score"].to_numpy() / GRAIN, counts["label"].to_numpy().astype(np.float64), counts["count"].to_numpy().astype(np.float64))
    table.destroy()
    drop(rows)
    give_back()
    return Model(fitted[2].weights, fitted[2].bias, slope, shift)


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but text, and the base figures, base_failed, p_good (null without a model), kept.

    Input columns with those names are replaced. A null text is an empty one and fails; repeated rows and
    null ids are scored like any others; an empty table gives an empty one.
    """
    new = [c.split()[0] for c in STATS.split(", ")] + ["base_failed", "p_good", "kept"]
    others = [c for c in docs.columns if c != text and c not in new]
    table = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block, s, p in judged(batch.column(len(others)), table.value):
            n = len(p)
            own = {c: batch.column(i).slice(block.first, n) for i, c in enumerate(others)}
            failed = base_failed(s)
            yield own | s | {"base_failed": failed, "p_good": pa.array(p, mask=np.isnan(p)), "kept": ~failed & ~(p < threshold)}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return arrow_map(docs.select(*others, text), f"{schema}, {STATS}, base_failed boolean, p_good double, kept boolean".lstrip(", "), work)


def judged(column, model: Model | None):
    """For each block of texts: the block, its base figures, the probabilities (NaN without a model)."""
    for block in wordscan.blocks(column):
        w = wordscan.words(block)
        n = len(block.bounds) - 1
        yield block, stats(block, w), model.probability(block, w) if model else np.full(n, np.nan)


def keep(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, all columns as they were."""
    table, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [~base_failed(s) & ~(p < threshold) for _, s, p in judged(batch.column(at), table.value)]
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return in_batches(docs, work, docs.schema)
