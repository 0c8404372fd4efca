"""Paraphrases that the coverage and answer checks would take are candidates: op8, against brute force over all pairs."""

import re

import numpy as np
import pyarrow as pa

from lodestar.llm import decontamination as D, wordscan

WORDS = re.compile(r"[a-z0-9\u0080-￿]+")


def test_paraphrases(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "benchmark"))
    model = D.fit(docs, bench, "doc_id", "text")
    rows = [(r.item_id, r.text) for r in bench.collect()]
    items = D.prepare(rows, model)
    texts = [t for t in (WORDS.findall(r.text.lower()) for r in docs.collect()) if len(t) > 150]
    rng = np.random.default_rng(1)
    plants = []
    for i, t in rows * 8:
        own = WORDS.findall(t.lower())
        for k in rng.choice(len(own), round(0.45 * len(own)), replace=False):
            other = texts[rng.integers(len(texts))]
            own[k] = other[rng.integers(len(other))]
        host = texts[rng.integers(len(texts))]
        y = rng.integers(60, len(host) - 60)
        plants.append((i, own, " ".join(host[y - 60 : y] + own + host[y : y + 60])))
    number = {x: n for n, x in enumerate(items.ids)}
    want = set()
    for n, (i, own, _) in enumerate(plants):
        h = D.read(next(wordscan.blocks(pa.array([" ".join(own)], pa.large_string()))))[0].tolist()
        j = number[i]
        size = len(items.words[j])
        lcs, found = D.common(items.masks[j], size, h), len(items.keys[j].intersection(h))
        if lcs >= D.PARAPHRASE * size and (lcs >= D.COPY * size or found >= D.ANSWERED):
            want.add((n, i))
    got = {(n + block.first, items.ids[i]) for block in wordscan.blocks(pa.array([p[2] for p in plants], pa.large_string())) for n, i, *_ in D.search(block, model, items)}
    assert len(want) > 50 and len(want & got) >= 0.995 * len(want)


def test_recall_of_rewritten_items(spark):
    """Of items with 35 % of their words replaced, 0.9 and more are found, and hardly any item elsewhere."""
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "benchmark"))
    model = D.fit(docs, bench, "doc_id", "text")
    rows = [(r.item_id, r.text) for r in bench.collect()]
    items = D.prepare(rows, model)
    texts = [t for t in (WORDS.findall(r.text.lower()) for r in docs.collect()) if len(t) > 150]
    rng = np.random.default_rng(8)
    plants = []
    for i, t in rows * 4:
        own = WORDS.findall(t.lower())
        for k in rng.choice(len(own), round(0.35 * len(own)), replace=False):
            other = texts[rng.integers(len(texts))]
            own[k] = other[rng.integers(len(other))]
        host = texts[rng.integers(len(texts))]
        y = rng.integers(60, len(host) - 60)
        plants.append((i, " ".join(host[y - 60 : y] + own + host[y : y + 60])))
    want = {(n, i) for n, (i, _) in enumerate(plants)}
    got = {(n + block.first, items.ids[i]) for block in wordscan.blocks(pa.array([p[1] for p in plants], pa.large_string())) for n, i, *_ in D.search(block, model, items)}
    assert len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.05 * len(want)
