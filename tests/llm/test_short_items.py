"""Short benchmark items, copied word for word into longer texts, are all found: op8."""

import re

import numpy as np

from lodestar.llm import decontamination

WORDS = re.compile(r"[a-z0-9\u0080-￿]+")


def test_short_items(spark, docs):
    texts = [t for t in (WORDS.findall(r.text.lower()) for r in docs.collect()) if len(t) > 100]
    rng = np.random.default_rng(3)
    items, copies = [], []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 19):
        for _ in range(5):
            a, b = (texts[rng.integers(len(texts))] for _ in range(2))
            x, y = rng.integers(len(a) - n), rng.integers(len(b))
            copies.append((-1 - len(items), " ".join(b[:y] + a[x : x + n] + b[y:])))
            items.append((len(items), " ".join(a[x : x + n])))
    items.append((len(items), ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(every, bench).collect()}
    text = {r.doc_id: f" {' '.join(WORDS.findall((r.text or '').lower()))} " for r in every.collect()}
    want = {(i, j) for i, t in text.items() for j, x in items if x and f" {x} " in t}
    assert want <= got and len(items) - 1 not in {j for _, j in got}
    few = {j for j, x in items if len(x.split()) < decontamination.MIN_WORDS}
    assert {(i, j) for i, j in got if j in few} == {(i, j) for i, j in want if j in few}
