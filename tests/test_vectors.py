"""Functions on vectors against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import ivf, search


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    return [rng.normal(size=12).astype(np.float32) * np.float32(10.0**e) for e in (-12, -3, 0, 4, 17)] + [np.zeros(12, np.float32)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<float>")


def test_normalisation(table, rows):
    for name in (V.normalized, V.scaled_normalized):
        for r in table.where("id < 5").select("id", name(F.col("v")).alias("u")).collect():
            want = rows[r.id].astype(np.float64) / np.linalg.norm(rows[r.id].astype(np.float64))
            assert list(r.u) == pytest.approx(want.tolist(), rel=1e-6)
    huge = table.sparkSession.createDataFrame([([3e38, 3e38, 0.0],)], "v array<float>")
    assert list(huge.select(V.scaled_normalized(F.col("v")).alias("u")).first().u) == pytest.approx([0.5**0.5, 0.5**0.5, 0.0])


def test_codes_by_columns_and_by_arrow(table, rows):
    by_column = {r.id: (r.scale, list(r.codes)) for r in table.select("id", V.code_scale(F.col("v")).alias("scale"), V.codes(F.col("v")).alias("codes")).collect()}
    by_arrow = {r.id: (r.scale, list(r.codes)) for r in V.with_codes(table, "id", "v").collect()}
    assert by_column == by_arrow and by_arrow[5] == (0.0, [0] * 12)
    for r in V.with_codes(table, "id", "v").collect():
        assert r.l1 == pytest.approx(np.abs(rows[r.id].astype(float)).sum()) and np.abs(np.array(r.codes) * r.scale - rows[r.id]).max() <= r.scale * 0.5001


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 384)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, true = v[:50], v[:50].astype(np.float64) @ v.astype(np.float64).T
    for strategy in (search.BLOCK, search.INT8):
        product, bound = search.bounded(q, v, strategy)
        assert (np.abs(product - true) <= bound).all()
    assert V.fp32_bound(1 << 24) is None and V.fp32_bound(384) < 1e-3


def test_pruning_keeps_ties_and_equal_vectors():
    v = np.repeat(np.eye(3, dtype=np.float32), 200, axis=0)
    ids = np.random.default_rng(1).permutation(600)
    own = search.few_equals(v, ids, 5)
    assert len(own) == 15 and all(sorted(ids[own][k * 5 : k * 5 + 5]) == sorted(ids[k * 200 : (k + 1) * 200])[:5] for k in range(3))
    best = search.first_k(np.array([1, 0, 0, 1]), np.array([0.5, 0.2, 0.2, 0.1]), np.array([4, 9, 3, 7]), 1)
    assert best.tolist() == [2, 3]


def test_lists(spark):
    c = np.eye(4, dtype=np.float32)
    assert ivf.assign(np.array([[0, 1, 1, 0], [0, 0, 0, 1]], np.float32), c).tolist() == [1, 3]  # ties go to the lowest
    assert ivf.probed(c, c[:2], 1, False).tolist() == [[True, False, False, False], [False, True, False, False]]
    assert ivf.probed(c, c[:2], 1, True).tolist() == [[True, True, False, False]] * 2
