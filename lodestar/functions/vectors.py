"""Scalar functions on vectors as Columns: they stay in the JVM and sum in element order, in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON32 = 2.0**-24
MAX_K = 64


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, where use has it within a lambda, which would compute it for each component."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Each component over the vector's length, rounded to float; no checks (see problem)."""
    return once(norm(v), lambda length: F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def problem(v: Column, dimension: int) -> Column:
    """The first rule that a vector breaks, or null: dimension, then finiteness, then length."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull() | (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull()), "DimensionMismatch")
        .when(bad, "NonFiniteVector")
        .when(norm(v) == 0, "ZeroNormVector")
    )


def is_unit(v: Column) -> Column:
    """Whether a stored vector's squared length is within 1e-5 of 1."""
    return F.abs(dot(v, v) - 1) <= 1e-5


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors as a float, not clamped."""
    return (F.lit(1.0) - dot(a, b)).cast("float")


def oracle_distance(a: Column, b: Column) -> Column:
    """Cosine distance of any vectors in double precision, clamped to 0 .. 2."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def similarity(d: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d))


def scaled_normalized(v: Column) -> Column:
    """Normalisation that can't overflow: by the greatest magnitude first."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return once(F.transform(v, lambda x: x.cast("double")), lambda w: once(top, lambda t: normalized(F.transform(w, lambda x: x / t))))


def code_scale(v: Column) -> Column:
    return (F.array_max(F.transform(v, F.abs)) / F.lit(127.0).cast("float")).cast("float")


def codes(v: Column) -> Column:
    """8-bit codes: components over the scale, rounded half away from zero; all zero for a zero vector."""
    return once(code_scale(v), lambda scale: F.transform(v, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.round((x / scale).cast("float"))).cast("tinyint")))


def quantised(v):
    """Scales, 8-bit codes and sums of magnitudes of the rows of a float matrix: the codes that codes() has, by NumPy."""
    import numpy as np

    scale = (np.abs(v).max(1) / np.float32(127)).astype(np.float32)
    ratio = (v / np.where(scale == 0, np.float32(1), scale)[:, None]).astype(np.float32).astype(np.float64)
    return scale.astype(np.float64), (np.sign(ratio) * np.floor(np.abs(ratio) + 0.5)).astype(np.int8), np.abs(v.astype(np.float64)).sum(1)


def with_codes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, scale, codes, l1 of every row of (key, vector), made in Arrow batches: each scale is sought once."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(1)
                n = len(column.flatten()) // batch.num_rows
                scale, code, total = quantised(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, n, dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "scale": scale.astype(np.float32), "codes": lists, "l1": total})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(work, f"{key} {kind}, scale float, codes array<tinyint>, l1 double")


def code_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def code_bound(scale_q: Column, scale_x: Column, l1_codes_q: Column, l1_x: Column) -> Column:
    """How far the product of codes can be from the product of the vectors."""
    return (scale_q * scale_x / 2 * l1_codes_q + scale_q / 2 * l1_x) * 1.0001 + 1e-7


def fp32_bound(dimension: int) -> float | None:
    """How far a dot product of unit vectors summed in single precision can be off; None where no bound holds."""
    x = dimension * EPSILON32 * 2
    return None if x >= 0.25 else 4 * x / (1 - x) * 1.001


def validate(vector: Sequence[float], dimension: int) -> list[float]:
    """The unit vector on the driver, by the same rules and in the same order as problem; ValueError names the rule."""
    import numpy as np

    if len(vector) != dimension:
        raise ValueError("DimensionMismatch")
    v = np.asarray(vector, np.float32).astype(np.float64)
    if not np.isfinite(v).all():
        raise ValueError("NonFiniteVector")
    length = 0.0
    for x in v.tolist():
        length += x * x
    length = math.sqrt(length)
    if length == 0:
        raise ValueError("ZeroNormVector")
    return (v / length).astype(np.float32).tolist()


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError("InvalidK")
    return k
