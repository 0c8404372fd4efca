"""The passes of op8's model read buckets that were written once, the same as those of the texts."""

import numpy as np
import pyarrow as pa

from lodestar.llm import decontamination as D, wordscan

TEXTS = [None, "", "One two, two", "é " * 30, None, "x " * 3000]


def test_buckets_of_texts(spark):
    rows = D.bucketed(spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1))
    got, at = D._texts(rows.toArrow().combine_chunks()["words"].chunk(0))
    h, want = D.read(next(wordscan.blocks(pa.array(TEXTS, pa.large_string()))))
    assert got.tolist() == D.bucket(h).tolist() and at.tolist() == want.tolist()
    seen, n = D.frequencies(rows)
    assert n == len(TEXTS) and seen[D.bucket(h)].min() == 1 and seen.sum() == len(set(h.tolist()))
    assert np.count_nonzero(seen) == len(set(D.bucket(h).tolist()))
