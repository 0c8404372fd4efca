"""Rendezvous hashing: stable record keys over weighted shards, and few moves when shards are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import gapless, partitions, salt_offsets, unused

N_SHARDS = 40


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard with the greatest score -weight / ln(u), where u in (0, 1) is a hash of key and shard.

    A shard's share is in proportion to its weight. Scores of a shard don't depend on the others, so a new
    shard takes rows only into itself, and a removed one gives away only its own. Ties go to the lower
    number. A null key is a key like any other.
    """
    if shards < 1 or weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("at least one shard, and a positive weight for each")
    own = F.xxhash64(F.lit("rendezvous"), key)
    scores = []
    for s in range(shards):
        h = F.xxhash64(own, F.lit(s))
        if weights is None or len(set(weights)) == 1:
            scores.append(h)  # with equal weights the order of u is the order of scores
        else:
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
            scores.append(F.lit(-float(weights[s])) / F.log(u))
    names = F.array(*scores)
    return (F.array_position(names, F.array_max(names)) - 1).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: int = N_SHARDS, weights: list[float] | None = None) -> DataFrame:
    """Every row with its shard, and its slot there, gapless from 0; all columns stay, clashing ones are replaced.

    Rows with equal keys (repeated rows, nulls) share a shard and have slots of their own. An empty table gives
    an empty one. Rows cross the network once, dealt by shard and a salt of the row, so that a shard, or a key, of any
    size is spread over tasks; the counts behind the offsets are shards x salts. Rows that are equal but for maps may
    swap slots.
    """
    parts = partitions(df.sparkSession)
    name = unused(df, "salt")
    # of rows of one key too: others of its columns, as far as they can be hashed
    rest = F.xxhash64(*[c for c, kind in df.dtypes if c not in (key, "shard", "slot") and "map<" not in kind and "variant" not in kind], F.lit(0))
    salt = F.pmod(F.xxhash64(F.lit("slot"), F.col(key), rest), F.lit(max(1, -(-4 * parts // shards)))).cast("int")
    placed = df.withColumns({"shard": rendezvous(F.col(key), shards, weights), name: salt}).drop("slot")
    counts = placed.groupBy("shard", name).agg(F.count("*").alias("n"))
    return gapless(placed, "shard", name, [key, rest], "slot", salt_offsets(counts, "shard", name)).drop(name)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The assigned rows as Parquet folders shard=0, shard=1, ..."""
    assign(df, **options).write.partitionBy("shard").parquet(path)
