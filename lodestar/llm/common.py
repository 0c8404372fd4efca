"""What the operators share: the shared folder for intermediate tables, Arrow maps, ranks without a hot task."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Only where that is unset, as in tests, a new local one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once and read again: lineage ends here, and a lost executor costs nothing earlier."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that written gave. For those only from which nothing is still to be read."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS = 2000
"""Rows of an Arrow batch at most. The session's spark.sql.execution.arrow.maxRecordsPerBatch is lowered to it."""

CACHES: list[Callable[[], None]] = []
"""Each empties what a worker keeps from task to task for one kind of operator."""


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """mapInArrow with bounded memory of workers, which live on for later tasks of other operators.

    Batches have BATCH_ROWS rows at most. A task begins by emptying CACHES, unless it keeps them to use them, and
    ends by returning free memory to the system.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        if not keeps:
            for clear in CACHES:
                clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


def arrow_map(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]], keeps: bool = False) -> DataFrame:
    """in_batches where work yields dicts of column name to array for each batch; schema as DDL, in the dicts' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield pa.RecordBatch.from_pydict(out)

    return in_batches(df, run, schema, keeps)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with lines behind it: a column that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def gapless(df: DataFrame, group: str, salt: str, order: list, out: str, offsets: DataFrame) -> DataFrame:
    """Numbers each group's rows from 0: by order within (group, salt), and salts one after another.

    offsets (group, salt, base) has how many rows of the group come in earlier salts. A hot group is so dealt
    over many tasks. Needs no row to meet all others of its group.
    """
    near = Window.partitionBy(group, salt).orderBy(*order)
    base = unused(df, "base")
    return (
        df.withColumn(out, F.row_number().over(near).cast("long") - 1)
        .join(F.broadcast(offsets.withColumnRenamed("base", base)), [group, salt], "left")
        .withColumn(out, F.col(out) + F.col(base))
        .drop(base)
    )


def salt_offsets(counts: DataFrame, group: str, salt: str) -> DataFrame:
    """counts (group, salt, n) to (group, salt, base)."""
    before = Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, salt, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))


MARKS = 26
"""Ids are marked in 2^MARKS bits at most; with more ids only more rows meet the join."""


def labelled(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """doc_id, label, text of all rows of docs with a label.

    Labels that are null or not 0 or 1 are left out, and an id labelled twice counts once, with the larger label. Documents
    whose id's hash no labelled one has are left out before the join, which is exact, so that their texts don't move.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    bits = min(MARKS, max(10, (16 * chosen.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_pydict({"slice": [0], "part": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for part in batch.column(1):
                seen |= np.frombuffer(part.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": [0], "part": pa.array([seen.tobytes()], pa.binary())})

    marks = in_batches(in_batches(chosen.select(slot.alias("slot")), mark, "slice long, part binary").coalesce(1), either, "slice long, part binary").head()
    table = docs.sparkSession.sparkContext.broadcast(np.frombuffer(marks["part"] if marks else bytes(1 << bits - 3), np.uint8))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(table.value[at >> 3] >> (7 - (at & 7)) & 1 == 1)

    own = docs.select(F.col("doc_id").cast(chosen.schema["doc_id"].dataType).alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return own.where(marked(slot)).join(chosen.hint("merge"), "doc_id").select("doc_id", "label", "text")


def summed(parts: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """parts (slice long, n double, part binary, of float32) to each slice's sums of n and part, added up by tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = got.setdefault(r["slice"], [0.0, 0.0])
                own[0] += r["n"]
                own[1] = own[1] + np.frombuffer(r["part"], np.float32).astype(np.float64)
        if got:
            yield pa.RecordBatch.from_pydict({"slice": list(got), "n": [x[0] for x in got.values()], "part": pa.array([x[1].tobytes() for x in got.values()], pa.binary())})

    rows = in_batches(parts.repartition(8, "slice"), add, "slice long, n double, part binary").collect()
    return {r["slice"]: (r["n"], np.frombuffer(r["part"])) for r in rows}


def trim() -> None:
    """Returns the free memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def give_back() -> None:
    """Returns freed memory of the driver's Python to the system after a model was learnt; else it would add up over stages."""
    gc.collect()
    trim()
