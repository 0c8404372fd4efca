"""Aggregates and row functions for judging search results. Percentiles differ by definition; pick by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def recall(truth: Column, actual: Column) -> Column:
    """Share of the distinct true ids that were returned; 1 if there are none."""
    wanted = F.array_distinct(truth)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, actual)) / F.size(wanted))


def lower_median(x: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")


def disc(x: str, p: float) -> Column:
    """Nearest-rank percentile of a column given by name."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def cont(x: str, p: float) -> Column:
    """Linearly interpolated percentile."""
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {x})")


def lab_percentile(x: str, p: float) -> Column:
    """The value at index ceil((n - 1) p) of the sorted values, counted from 0. Groups are runs of samples, which fit a task."""
    return F.expr(f"element_at(sort_array(collect_list({x})), cast(ceil((count({x}) - 1) * {p}) as int) + 1)")


def all_or_missing(value: Column, agg) -> Column:
    """An aggregate that is missing as soon as one value is."""
    return F.when(F.count(value) == F.count("*"), agg(value))


def agreed(value: Column) -> Column:
    """The value that all rows have, or null."""
    return F.when(F.min(value).eqNullSafe(F.max(value)), F.min(value))


def contiguous_runs(rows: DataFrame, slot: str = "slot") -> DataFrame:
    """One row: how many unbroken runs the sorted slots form.

    A run starts where slot - 1 is absent: an anti join on the slot, which deals out over tasks, where a window
    over all rows would not.
    """
    own = rows.select(F.col(slot).alias("s")).distinct()
    before = own.select((F.col("s") + 1).alias("s"))
    return own.join(before, "s", "left_anti").agg(F.count("*").alias("runs"))


def average_rank(df: DataFrame, x: str, out: str, by: list[str]) -> DataFrame:
    """Ranks within groups, ties sharing their mean."""
    order = Window.partitionBy(*by).orderBy(x)
    ties = Window.partitionBy(*by, x)
    return df.withColumn(out, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def tie_compatible(distances: Column, boundary: Column, expected: Column, tolerance: float) -> Column:
    """Whether results differ from the truth only by ties at the boundary: as many, and none farther than boundary + tolerance."""
    return (F.size(distances) == expected) & F.forall(distances, lambda d: d <= boundary + tolerance)


def regret(chosen: Column, *arms: Column) -> Column:
    return chosen / F.least(*arms) - 1


RANGES = 64


def global_rank(df: DataFrame, x: str, key: str, out: str, falling: bool = False) -> DataFrame:
    """Ranks from 0 over all rows by x, then key: ranges of x between fixed cuts are ranked apart, after counting those before.

    The cuts are approximate quantiles of numbers, taken once, so a task that runs again finds the same. Nulls come first, or
    last if falling.
    """
    cuts = df.select(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    at, sign = df.columns.index(x), -1 if falling else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(at).to_numpy(zero_copy_only=False).astype(np.float64)
            part = np.where(np.isnan(value), -1, np.searchsorted(np.array(cuts, np.float64), value)) * sign
            yield batch.append_column("_part", pa.array(part.astype(np.int32)))

    dealt = df.mapInArrow(work, StructType([*df.schema.fields, StructField("_part", IntegerType())]))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    near = Window.partitionBy("_part").orderBy(F.desc(x) if falling else F.asc(x), key)
    ranked = dealt.withColumn("_n", F.row_number().over(near))
    return ranked.join(F.broadcast(sizes), "_part").withColumn(out, (F.col("_base") + F.col("_n") - 1).cast("long")).drop("_part", "_base", "_n")
