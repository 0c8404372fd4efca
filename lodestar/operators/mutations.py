"""Ordered batches of additions and deletions: legality by id, dense slots, current state from a changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADD, DELETE = "add", "delete"


def judged(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch (seq, op, id) with error: null, DuplicateId, UnknownId or AlreadyDeleted.

    stored (id, live) is the state before. Ids live once: add, then at most one delete. An id's mutations are
    judged by those before it in the batch; what follows the first error of a batch has no meaning.
    """
    near = Window.partitionBy("id").orderBy("seq")
    known = batch.join(stored.select("id", F.col("live").alias("_live")), "id", "left")
    adds = F.sum((F.col("op") == ADD).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, -1))
    dels = F.sum((F.col("op") == DELETE).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, -1))
    exists = F.col("_live").isNotNull() | (F.coalesce(adds, F.lit(0)) > 0)
    gone = (F.col("_live") == F.lit(False)) | (F.coalesce(dels, F.lit(0)) > 0)
    error = (
        F.when((F.col("op") == ADD) & exists, "DuplicateId")
        .when((F.col("op") == DELETE) & ~exists, "UnknownId")
        .when((F.col("op") == DELETE) & F.coalesce(gone, F.lit(False)), "AlreadyDeleted")
    )
    return known.withColumn("error", error).drop("_live")


def first_error(batch: DataFrame, stored: DataFrame):
    """(seq, error) of the first illegal mutation, or None: one row reaches the driver."""
    row = judged(batch, stored).where("error is not null").orderBy("seq").select("seq", "error").first()
    return None if row is None else (row[0], row[1])


def current(log: DataFrame) -> DataFrame:
    """id, live, user_id, timestamp, slot from a legal changelog (seq, op, id, user_id, timestamp): a deleted row keeps its data.

    Slots count additions in order of seq over the whole log; the collection stores them at commit instead.
    """
    state = log.groupBy("id").agg(
        F.max_by(F.col("op"), "seq").alias("last"),
        F.min(F.when(F.col("op") == ADD, F.col("seq"))).alias("seq"),
        F.max(F.when(F.col("op") == ADD, F.col("user_id"))).alias("user_id"),
        F.max(F.when(F.col("op") == ADD, F.col("timestamp"))).alias("timestamp"),
    )
    return state.select("id", (F.col("last") == ADD).alias("live"), "user_id", "timestamp", "seq")


def with_slots(added: DataFrame, base: int, parts: int = 64) -> DataFrame:
    """Dense slots base, base + 1, ... in order of seq, by ranges of seq: counts of ranges first, then ranks within."""
    if added.isEmpty():
        return added.withColumn("slot", F.lit(base).cast("long"))
    low, high = added.agg(F.min("seq"), F.max("seq")).first()
    width = max(1, -(-(high - low + 1) // parts))
    cut = added.withColumn("_part", F.floor((F.col("seq") - low) / width))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    near = Window.partitionBy("_part").orderBy("seq")
    out = cut.withColumn("_n", F.row_number().over(near)).join(F.broadcast(sizes), "_part")
    return out.withColumn("slot", (F.col("_base") + F.col("_n") - 1 + base).cast("long")).drop("_part", "_base", "_n")


def next_generation(generation: int, mutations: int) -> int:
    if generation + mutations > 2**63 - 1:
        raise ValueError("GenerationExhausted")
    return generation + mutations
