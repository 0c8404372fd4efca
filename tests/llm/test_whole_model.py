"""The latent space of op8 is made of all passages of all documents."""

import numpy as np
import pyarrow as pa

from lodestar.llm import decontamination as D, wordscan


def test_every_passage_counts(spark):
    """Of so few words that RANK directions keep them all, each passage is kept whole, of whichever document."""
    docs = spark.createDataFrame([(i, " ".join(f"w{100 * i + k}" for k in range(100)) if i < 9 else None) for i in range(10)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"x{k}" for k in range(20))), (2, None)], "item_id long, text string")
    model = D.fit(docs, items, "doc_id", "text")
    h, at = D.read(next(wordscan.blocks(pa.array([r.text for r in docs.collect()], pa.large_string()))))
    begin, owner = D.passages(at)
    kept = np.linalg.norm(model.latent(h, begin, at[owner + 1])[0], axis=1)
    assert len(kept) == 81 and kept.min() > 0.97
    assert D.fit(docs.where("doc_id < 0"), items.where("item_id < 0"), "doc_id", "text").vectors.shape == (1 << D.BITS, D.RANK)


def test_sums_of_passages(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [None, "", "a", "a a a b c", *(" ".join(f"w{i % m}" for i in range(n)) for n, m in ((25, 7), (20, 70), (11, 3), (700, 50))), ""]
    q, idf = rng.normal(size=(1 << D.BITS, 6)), rng.uniform(0.5, 8, 1 << D.BITS)
    own = np.append(q * idf[:, None], np.zeros((1, 6)), axis=0).astype(np.float32), np.append(idf, 0).astype(np.float32)
    h, at = D.read(next(wordscan.blocks(pa.array(texts, pa.large_string()))))
    begin, runs = D.steps(at)
    want, n = np.zeros(q.shape), 0
    for i in range(len(texts)):
        for s in begin[runs[i] : runs[i + 1]]:
            b, tf = np.unique(D.bucket(h[s : min(s + 2 * D.STEP, at[i + 1])]), return_counts=True)
            a = tf * idf[b] / np.linalg.norm(tf * idf[b])
            want[b] += np.outer(a, a @ q[b])
            n += 1
    for size in (1, 7, 2048):
        monkeypatch.setattr(D, "RUNS", size)
        total, small = np.zeros((len(q) + 1, 6), np.float32), np.zeros((6, 6), np.float32)
        assert D.gram(h, at, *own, total) == D.gram(h, at, *own, small) == n
        assert np.allclose(total[:-1] * idf[:, None], want, atol=1e-4) and np.allclose(small, q.T @ want, atol=1e-3)
