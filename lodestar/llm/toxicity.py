"""Toxicity: a convolutional text classifier over hashed word embeddings, with max pooling, trained in numpy.

A word here is a run of ASCII letters and digits and of bytes from 0x80, in lower case. Its embedding is the
sum of three hashed ones: of the word, and of its first 4 and 6 bytes (so that forms of a stem share one).
Filters of widths 1, 2 and 3 run over the whole text; the greatest value of each filter goes, rectified, to
a logistic output. Buckets seen in under MIN_DOCS training texts have the zero embedding, so words that
training never met don't count for either side; without that, long texts would collect chance collisions.

Thresholds are calibrated by language: the language is told from a text's own function words (no column of
the table is an input), and the score is the sigmoid of the logit less the language's threshold, so that
0.5 is the threshold everywhere.

Trained by the executors on all labelled rows that aren't held out, texts that occur repeatedly counted once.
Rows are dealt by the hash of the text's words into shards of about SHARD rows; of each, one fifth is for the
thresholds and the rest for training. Embeddings start from counts over all shards. Then there are ROUNDS rounds:
each task trains on a shard from the common model, and the next common model is the mean of theirs, weighted by
rows (an embedding's by the shard's texts with its bucket). With one shard, that is training at one place.
Thresholds are found from the logits of all calibration rows, counted in steps of 1 / GRAIN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordscan
from lodestar.llm.common import arrow_map, drop, give_back, in_batches, labelled, written
from lodestar.llm.quality import GRAIN, sigmoid

SHARD, ROUNDS, EPOCHS = 3000, 4, 12
"""Labelled rows that a task trains on at once, about; how often models are averaged; times that each row is learnt from in all."""
BITS, DIM, FILTERS, WIDTHS = 22, 8, 6, (1, 2, 3)
MIN_DOCS = 2
HELD_OUT, FOLDS = 0, 5
"""Rows whose crc32 of the id as text leaves HELD_OUT modulo FOLDS are never learnt from."""

_PREFIX = (0, 4, 6)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
# Frequent function words by language.
_FUNCTION = {
    "en": "the of and to in is that it for was on are with as by this be at from or an have not",
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat",
    "fr": "le la les des et en un une du est que qui dans pour pas sur au par avec il elle ce sont plus",
    "es": "el los las del que en un una es por con para su al lo como más pero sus y se o fue",
}
LANGUAGES = (*_FUNCTION, "other")


def _spans_of(words: str) -> np.ndarray:
    block = next(wordscan.blocks(pa.array([words])))
    return wordscan.words(block).hash


_WORDS = np.concatenate([_spans_of(x) for x in _FUNCTION.values()])
_OF = np.repeat(np.arange(len(_FUNCTION)), [len(x.split()) for x in _FUNCTION.values()])
_ORDER = np.argsort(_WORDS)
_WORDS, _OF = _WORDS[_ORDER], _OF[_ORDER]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def read(block: wordscan.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (a row for each of the three hashes), where texts begin, and texts' languages."""
    w = wordscan.spans(block, _BETWEEN)
    low = wordscan.lowered(block)
    h = wordscan.hashes(low, w.starts, w.ends)
    n = w.ends - w.starts
    out = np.empty((len(_PREFIX), len(h)), np.int32)
    for k, most in enumerate(_PREFIX):
        part = wordscan.hashes(low, w.starts, np.minimum(w.ends, w.starts + most)) if most else h
        out[k] = (wordscan.mix(part + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32)
        if most:
            out[k][n < most] = -1
    at = np.searchsorted(_WORDS, h)
    at[at == len(_WORDS)] = 0
    hit = np.flatnonzero(_WORDS[at] == h)
    docs = len(w.at) - 1
    owner = np.searchsorted(w.at, hit, "right") - 1
    votes = np.bincount(owner * len(_FUNCTION) + _OF[at[hit]], minlength=docs * len(_FUNCTION)).reshape(docs, -1)
    language = np.where(votes.max(1) > 0, votes.argmax(1), len(_FUNCTION))
    return out, w.at, language


@dataclass
class Model:
    """rows: sorted bucket numbers (hash k's begin at k << BITS); embed: theirs, with the zero embedding last."""

    rows: np.ndarray
    embed: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def index(self, buckets: np.ndarray) -> np.ndarray:
        """Numbers of embeddings for each word."""
        out = np.empty_like(buckets)
        for k in range(len(buckets)):
            key = np.where(buckets[k] < 0, np.int32(-1), buckets[k] + np.int32(k << BITS))
            at = np.searchsorted(self.rows, key)
            at[at == len(self.rows)] = 0
            out[k] = np.where(self.rows[at] == key, at, len(self.rows)) if len(self.rows) else 0
        return out

    def pool(self, index: np.ndarray, at: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The greatest value of each filter in each text, and, with places, the word at which it begins (-1: none).

        A filter's value at a word is a sum over its width of products that depend on one word each; most words
        have the zero embedding. Only places where a window meets a known word are worked on: elsewhere the value
        is the bias.
        """
        docs = len(at) - 1
        there = (index != len(self.rows)).any(0)
        known = np.flatnonzero(there)
        number = np.full(len(there), -1)
        number[known] = np.arange(len(known))
        owner = np.repeat(np.arange(docs), np.diff(at))
        e = self.embed[index[:, known]].sum(0)
        top = np.tile(self.bias, (docs, 1))
        where = np.full(top.shape, -1)
        for j, width in enumerate(WIDTHS):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            # the windows that hold a known word: begin at most width - 1 words before it
            some = there.copy()
            for s in range(1, width):
                some[:-s] |= there[s:]
            begin = np.flatnonzero(some)
            begin = begin[begin + width <= at[owner[begin] + 1]]
            doc = owner[begin]
            if not len(begin):
                continue
            value = np.tile(self.bias[own], (len(begin), 1))
            for s in range(width):
                share = np.append(e @ self.kernels[j][s], np.zeros((1, FILTERS)), axis=0)  # the last for words with the zero embedding
                value += share.take(number[begin + s], axis=0, mode="wrap")
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            best = np.maximum.reduceat(value, first, axis=0)
            better = best > top[doc[first], own]
            top[doc[first], own] = np.where(better, best, top[doc[first], own])
            if not places:
                continue
            equal = value == np.repeat(best, np.diff(np.append(first, len(doc))), axis=0)
            for f in range(FILTERS):
                r = np.flatnonzero(equal[:, f])[::-1]
                win = np.full(docs, -1)
                win[doc[r]] = begin[r]
                where[doc[first][better[:, f]], j * FILTERS + f] = win[doc[first][better[:, f]]]
        return top, where

    def logit(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.pool(index, at, False)[0], 0) @ self.out + self.out_bias

    def score(self, block: wordscan.Block) -> np.ndarray:
        buckets, at, language = read(block)
        return sigmoid(self.logit(self.index(buckets), at) - self.threshold[language])


def start(rows: np.ndarray, odds: np.ndarray, seed: int = 11) -> Model:
    """The model before training: embeddings are the shrunken log-odds of their buckets."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (len(rows) + 1, DIM))
    embed[:-1, 0] = np.clip(odds, -4, 4) / 2
    embed[-1] = 0
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for k, w in zip(kernels, WIDTHS, strict=True):
        k[:, 0, :] += 1.0 / w
    return Model(rows, embed, kernels, np.full(FILTERS * len(WIDTHS), -1.0), np.full(FILTERS * len(WIDTHS), 0.3), -1.0)


def descend(model: Model, buckets: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, epochs: int) -> None:
    """Trains all of the model together by Adam, in place, on texts with their weights."""
    docs = len(y)
    rng = np.random.default_rng(seed)
    index = model.index(buckets)
    params = [model.embed, *model.kernels, model.bias, model.out]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(docs)
        for i in range(0, docs, 64):
            own = np.sort(order[i : i + 64])
            size = (at[1:] - at[:-1])[own]
            sub = np.concatenate([[0], np.cumsum(size)])
            idx = index[:, np.repeat(at[own] - sub[:-1], size) + np.arange(sub[-1])]
            top, where = model.pool(idx, sub)
            act = np.maximum(top, 0)
            err = (sigmoid(act @ model.out + model.out_bias) - y[own]) * weight[own] / len(own)
            grads = [np.zeros_like(p) for p in params]
            grads[-1] = act.T @ err + 1e-4 * model.out
            back = np.outer(err, model.out) * (top > 0)
            grads[-2] = back.sum(0)
            met, moves = [], []
            for j, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    col = j * FILTERS + f
                    d = np.flatnonzero((back[:, col] != 0) & (where[:, col] >= 0))
                    for s in range(width):
                        three = idx[:, where[d, col] + s]
                        e = model.embed[three].sum(0)
                        grads[1 + j][s, :, f] += back[d, col] @ e
                        met.append(three.ravel())
                        moves.append(np.tile(np.outer(back[d, col], model.kernels[j][s, :, f]), (len(three), 1)))
            met = np.concatenate(met)
            if len(met):
                turn = np.argsort(met, kind="stable")
                first = np.flatnonzero(np.append(True, met[turn][1:] != met[turn][:-1]))
                grads[0][met[turn][first]] = np.add.reduceat(np.concatenate(moves)[turn], first, axis=0)
            grads[0][-1] = 0
            t += 1
            for p, (m, v), g in zip(params, moment, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            model.out_bias -= 0.05 * float(err.sum())


def thresholds(logit: np.ndarray, y: np.ndarray, language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The cut with the fewest errors, of all and of each language with 8 of each label. times: how often each row is there.

    Labels are not free of errors, so an error less is worth a move of at most two logits away from the middle
    between the labels' medians; beyond 6 logits are as good as certain and count as 6.
    """

    def median(x: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        stop = np.cumsum(n[order])
        return float(x[order][np.searchsorted(stop, [(stop[-1] - 1) // 2, stop[-1] // 2], "right")].mean())

    def best(own: np.ndarray) -> float:
        x, t, n = np.clip(logit[own], -6, 6), y[own], times[own]
        s = np.unique(x)
        middle = (median(x[t == 1], n[t == 1]) + median(x[t == 0], n[t == 0])) / 2
        low, high = np.append(s[0] - 1, s), np.append(s, s[-1] + 1)
        cuts = np.clip(middle, low + 0.25 * (high - low), high - 0.25 * (high - low))
        at = np.searchsorted(s, x)
        ones, zeros = (np.bincount(at[t == k], n[t == k], len(s)) for k in (1, 0))
        wrong = np.append(0, np.cumsum(ones)) + np.append(np.cumsum(zeros[::-1])[::-1], 0)
        return float(cuts[np.argmin(wrong + 0.5 * np.abs(cuts - middle))])

    every = best(np.arange(len(y))) if len(y) and y.min() != y.max() else 0.0
    out = np.full(len(LANGUAGES), every)
    for k in range(len(LANGUAGES)):
        own = np.flatnonzero(language == k)
        if min(times[own][y[own] == 1].sum(), times[own][y[own] == 0].sum()) >= 8:
            out[k] = best(own)
    return out


def _once(rows: dict) -> np.ndarray:
    """Of rows with equal f those with the greatest (id, label)."""
    order = np.lexsort((rows["label"], rows["id"], rows["f"]))
    return order[np.append(rows["f"][order][1:] != rows["f"][order][:-1], True)[: len(order)]]


PACKED = "n int, ones int, train_n int, train_ones int, y binary, language binary, train binary, size binary, words binary, x binary"


def _pack(rows: pa.Table) -> pa.Table:
    """A shard as one row: its texts' labels, languages, part, and words as numbers in its list of words' buckets.

    Each language of each label gives every fifth text to the thresholds.
    """
    rows = rows.combine_chunks()
    got = {c: rows[c].to_numpy() for c in ("f", "id", "label")}
    own = _once(got)
    own = own[np.lexsort((got["label"][own], got["id"][own]))]
    parts, size, language = [], [], []
    for block in wordscan.blocks(rows["text"].take(pa.array(own))):
        buckets, at, spoken = read(block)
        parts.append(buckets)
        size.append(np.diff(at))
        language.append(spoken)
    buckets, size, language, y = np.concatenate(parts, axis=1), np.concatenate(size), np.concatenate(language), got["label"][own]
    number = np.zeros(buckets.shape[1], np.int64)
    for own in buckets:
        key = number << BITS + 1 | (own + 1)
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
    words = buckets[:, first] if len(number) else buckets
    order = np.random.default_rng(3).permutation(len(y))
    order = order[np.lexsort((language[order], y[order]))]
    train = np.arange(len(y)) % 5 != 0
    at = np.concatenate([[0], np.cumsum(size)])
    x = np.concatenate([number[at[i] : at[i + 1]] for i in order]).astype("<i4")
    y, language, size = y[order].astype(np.int8), language[order].astype(np.int8), size[order].astype("<i8")
    out = {"n": len(y), "ones": int(y.sum()), "train_n": int(train.sum()), "train_ones": int(y[train].sum()), "y": y.tobytes(), "language": language.tobytes(), "train": train.tobytes(), "size": size.tobytes(), "words": words.astype("<i4").tobytes(), "x": x.tobytes()}
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for k, v in out.items()})


def _shards(batch: pa.RecordBatch, part: bool | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, where texts begin, labels and languages of each shard: of the rows for training, of the others, or of all."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        y, language, train, size, words, x = (np.frombuffer(batch.column(names.index(c))[i].as_buffer(), t) for c, t in (("y", np.int8), ("language", np.int8), ("train", bool), ("size", "<i8"), ("words", "<i4"), ("x", "<i4")))
        keep = np.ones(len(y), bool) if part is None else train == part
        yield words.reshape(len(_PREFIX), -1)[:, x[np.repeat(keep, size)]], np.concatenate([[0], np.cumsum(size[keep])]), y[keep].astype(np.float64), language[keep].astype(np.int64)


def _seen(buckets: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (hash k's begin at k << BITS), and how many texts with label 1, and in all, have each."""
    owner = np.repeat(np.arange(len(y)), np.diff(at))
    out = []
    for k, own in enumerate(buckets):
        known = own >= 0
        pair = np.unique((own[known].astype(np.int64) << 32) | owner[known])  # a word counts once a text
        found, inverse = np.unique((pair >> 32).astype(np.int32), return_inverse=True)
        out.append((found + np.int32(k << BITS), np.bincount(inverse, y[pair & 0xFFFFFFFF], len(found)), np.bincount(inverse, minlength=len(found))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vocabulary(packed: DataFrame, part: bool | None, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in MIN_DOCS texts or more that tell the labels apart, sorted, and their shrunken log-odds. Counts are over all shards."""

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        for buckets, at, y, _ in _shards(batch, part):
            row, ones, seen = _seen(buckets, at, y)
            yield {"row": row.astype(np.int64), "ones": ones.astype(np.int64), "seen": seen.astype(np.int64)}

    sums = arrow_map(packed, "row long, ones long, seen long", count).groupBy("row").agg(F.sum("ones").alias("ones"), F.sum("seen").alias("seen"))
    odds = (F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("seen") - F.col("ones") + 0.5) / (n0 + 1.0))) * F.col("seen") / (F.col("seen") + 5)
    got = sums.where(F.col("seen") >= MIN_DOCS).select("row", odds.alias("odds")).where(F.abs("odds") > 0.5).orderBy("row").toArrow()
    return got["row"].to_numpy().astype(np.int32), got["odds"].to_numpy()


def _round(packed: DataFrame, model: Model, part: bool | None, n0: int, n1: int, seed: int, epochs: int) -> None:
    """One round: model becomes the mean of the models that each shard makes of it.

    Tasks send differences, in rows of DIM: of embeddings that the shard's texts have, and, with numbers below 0, of all else.
    """
    table = packed.sparkSession.sparkContext.broadcast(model)

    def flat(m: Model) -> np.ndarray:
        v = np.concatenate([*(k.ravel() for k in m.kernels), m.bias, m.out, [m.out_bias]])
        return np.pad(v, (0, -len(v) % DIM)).reshape(-1, DIM)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        whole = table.value
        for buckets, at, y, _ in _shards(batch, part):
            if not len(y):
                continue
            index = whole.index(buckets)
            own = np.unique(np.append(index, len(whole.rows)))[:-1]
            mine = Model(whole.rows[own], whole.embed[np.append(own, len(whole.rows))], [k.copy() for k in whole.kernels], whole.bias.copy(), whole.out.copy(), whole.out_bias)
            descend(mine, buckets, at, y, np.where(y == 1, 0.5 / n1, 0.5 / n0) * (n0 + n1), seed, epochs)
            row, _, seen = _seen(buckets, at, y)
            times = np.append(seen[np.searchsorted(row, mine.rows)], np.full(len(flat(mine)), len(y))).astype(np.float64)
            moved = np.concatenate([(mine.embed - whole.embed[np.append(own, len(whole.rows))])[:-1], flat(mine) - flat(whole)]) * times[:, None]
            yield {"row": np.append(own, -1 - np.arange(len(flat(mine)))), "n": times} | {f"d{k}": moved[:, k] for k in range(DIM)}

    columns = [f"d{k}" for k in range(DIM)]
    sent = arrow_map(packed, "row long, n double, " + ", ".join(f"{c} double" for c in columns), work)
    got = sent.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).toArrow()
    table.destroy()
    row, moved = got["row"].to_numpy(), np.stack([got[c].to_numpy() for c in columns], 1) / got["n"].to_numpy()[:, None]
    model.embed[row[row >= 0]] += moved[row >= 0]
    rest = flat(model)
    rest[-1 - row[row < 0]] += moved[row < 0]
    rest = rest.ravel()
    for p in (*model.kernels, model.bias, model.out):
        p[:] = rest[: p.size].reshape(p.shape)
        rest = rest[p.size :]
    model.out_bias = float(rest[0])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all labelled rows that aren't held out; None if a label is missing.

    Texts' words, 4 bytes each, are written once, a row for each shard; the driver gets embeddings and counts only.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in wordscan.blocks(batch.column(2)):
            buckets, at, _ = read(block)
            n = len(at) - 1
            own = pa.RecordBatch.from_arrays([c.slice(block.first, n) for c in batch.columns], names=["id", "label", "text"])
            got = {"f": np.array([xxhash.xxh64_intdigest(buckets[:, at[i] : at[i + 1]].tobytes()) >> 1 for i in range(n)], np.int64)}
            got |= {c: own[c].to_numpy() for c in ("id", "label")}
            once = _once(got)
            yield {"f": got["f"][once]} | {c: own[c].take(pa.array(once)) for c in own.schema.names}

    chosen = labelled(docs, labels, "toxic", ~held_out(F.col("doc_id")))
    shards = max(1, round(chosen.count() / SHARD))
    each = arrow_map(chosen.select(F.col("doc_id").cast("long"), "label", "text"), "f long, id long, label int, text string", rows)
    packed = written(each.groupBy(F.pmod("f", F.lit(shards)).alias("shard")).applyInArrow(_pack, PACKED), "labelled-toxic")
    n, ones, train_n, train_ones = (x or 0 for x in packed.agg(*[F.sum(c) for c in ("n", "ones", "train_n", "train_ones")]).head())
    model = None
    if 0 < ones < n:
        both = 0 < train_ones < train_n  # else all rows are for both
        part, n, ones = (True, train_n, train_ones) if both else (None, n, ones)
        model = start(*_vocabulary(packed, part, n - ones, ones))
        for r in range(ROUNDS if shards > 1 else 1):
            _round(packed, model, part, n - ones, ones, 11 + r, EPOCHS // ROUNDS if shards > 1 else EPOCHS)
        model.threshold = _calibrated(packed, model, False if both else None)
    drop(packed)
    give_back()
    return model


def _calibrated(packed: DataFrame, model: Model, part: bool | None) -> np.ndarray:
    table = packed.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for buckets, at, y, language in _shards(batch, part):
            if len(y):
                logit = np.clip(table.value.logit(table.value.index(buckets), at), -6, 6)
                yield {"language": language, "label": y.astype(np.int32), "logit": np.rint(logit * GRAIN).astype(np.int64)}

    got = arrow_map(packed, "language long, label int, logit long", work).groupBy("language", "label", "logit").count().toArrow()
    table.destroy()
    return thresholds(got["logit"].to_numpy() / GRAIN, got["label"].to_numpy(), got["language"].to_numpy(), got["count"].to_numpy())


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row; 0 without a model.

    A null text is an empty one; repeated rows and null keys are scored like any others; other columns are not read, so
    their names don't matter; an empty table gives an empty one.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for block, s in scored(batch.column(2), table.value):
            own = [batch.column(i).slice(block.first, len(s)) for i in (0, 1)]
            yield {"key": own[0], "held_out": own[1], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return arrow_map(rows, f"key {kind}, held_out boolean, score double, predicted int", work).withColumnRenamed("key", key)


def scored(column, model: Model | None):
    for block in wordscan.blocks(column):
        yield block, model.score(block) if model else np.zeros(len(block.bounds) - 1)


def keep(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows that score under 0.5, all columns as they were, whatever their names; null texts are empty ones."""
    table, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [s < 0.5 for _, s in scored(batch.column(at), table.value)]
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return in_batches(docs, work, docs.schema)
