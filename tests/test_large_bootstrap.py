"""a24 over runs of many batches, by workers that may take no more than a bounded memory."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd

from lodestar.functions.generators import splitmix64
from lodestar.plans import report_queries as R

CODE = """
import sys
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.executor.pyspark.memory", "1500m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from lodestar.plans import report_queries as R
print("ROWS", [tuple(r) for r in R.a24(s, sys.argv[1]).collect()])
"""


def test_many_batches(tmp_path):
    n = 40_000
    value = np.random.default_rng(4).integers(0, 1 << 20, (n, 2)).astype(float)
    i = np.arange(2 * n)
    pd.DataFrame({"event_id": i // 2 * 64 + i % 2, "user_id": i % 2, "event_type": "click", "value": value.ravel()}).to_parquet(tmp_path / "events.parquet")
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parent.parent)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    taken = R.draws(R.HIERARCHY_DRAWS, 2, 7)
    middles = np.empty(taken.shape)
    for (t, place), run in np.ndenumerate(taken):
        at = splitmix64((2 * t + place) * n + np.arange(n), 8 + int(run)) % np.uint64(n)
        middles[t, place] = R.lower_middle(np.floor(value[:, run] * 1000)[at.astype(np.int64)])
    low, high = R.nearest_rank(middles.min(1), 0.025, 0.975)  # the lower of two
    assert done.stdout.split("ROWS ")[1].strip() == str([("click", low, high, 2)])


def test_rows_of_draws():
    for n, rows in ((1, [0, 1]), (5, [3, 0, 9]), (1000, range(0, 400, 7))):
        x, rows = np.random.default_rng(n).integers(0, 50, n).astype(float), np.array(rows)
        assert (R.drawn_middles(x, rows, 8) == R.lower_middle(x[R.draws(400, n, 8)])[rows]).all()
