"""The models of op1, op4 and the pipeline are made of all labelled rows, not of so many of each label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality, toxicity

PLAIN = [f"word{i}" for i in range(60)]


def late(spark, n, of):
    """n ids that op4 may learn from, and the last of them by hash, which samples of so many rows left out."""
    ids = spark.range(20 * n).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id"))).limit(2 * n)
    ids = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    return ids[:n], ids[n:], ids[of:n]


def tables(spark, marked, clean, last, word, common, label):
    rng = np.random.default_rng(0)
    last = set(last)
    rows = []
    for i in marked + clean:
        words = rng.choice(PLAIN, 24).tolist()
        if i in last:
            words[::4] = [word] * 6
        elif i in set(marked):
            words[::4] = [common] * 6
        rows.append((i, " ".join(words), label if i in set(marked) else 1 - label))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    return docs.select("doc_id", "text"), docs.select("doc_id", F.col("y").alias("quality"), F.col("y").alias("toxic"))


@pytest.mark.parametrize("size", [700, 10_000])
def test_toxicity(spark, monkeypatch, size):
    monkeypatch.setattr(toxicity, "SHARD", size, raising=False)
    marked, clean, last = late(spark, 1700, 1500)
    docs, labels = tables(spark, marked, clean, last, "vile", "nasty", 1)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert np.mean([got[i] for i in last]) > 0.95
    assert np.mean([got[i] for i in marked]) > 0.95 and np.mean([got[i] for i in clean]) < 0.05


def test_quality(spark):
    marked, clean, last = late(spark, 1500, 1200)
    docs, labels = tables(spark, marked, clean, last, "junk", "spam", 0)
    got = {r.doc_id: r.kept for r in quality.score(docs, quality.learn(docs, labels)).where("not base_failed").collect()}
    assert np.mean([got[i] for i in last if i in got]) < 0.05
    assert np.mean([got[i] for i in clean if i in got]) > 0.95


def test_long_texts_are_learnt_from(spark):
    rows = [(i, " ".join((["nasty"] * 20_000 if i % 2 else ["fine"] * 20) + [f"n{i}"])) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert model is not None and {r.doc_id % 2 for r in toxicity.score(docs, model).where("predicted = 1").collect()} == {1}


def test_thresholds_of_counts():
    rng = np.random.default_rng(1)
    y, language = rng.integers(0, 2, 3000), rng.integers(0, 3, 3000)
    x = np.round(np.clip(rng.normal(2 * y - 1, 1.5) + language, -6, 6) * 8) / 8
    keys, times = np.unique(np.stack([x, y, language]), axis=1, return_counts=True)
    counted = toxicity.thresholds(keys[0], keys[1], keys[2].astype(int), times)
    assert np.allclose(counted, toxicity.thresholds(x, y, language, np.ones(3000)))
    for k in range(3):
        own = language == k
        middle = (np.median(x[own & (y == 1)]) + np.median(x[own & (y == 0)])) / 2
        loss = [((x[own] >= c) != (y[own] == 1)).sum() + 0.5 * abs(c - middle) for c in (*np.arange(-6, 6, 0.02), counted[k])]
        assert loss[-1] <= min(loss) + 0.1
