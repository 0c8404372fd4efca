"""A stream of mutations into a collection: an addition that the batch interfaces make natural.

Files of (seq, op, id, user_id, timestamp, vector) that arrive in a folder become commits, one per micro-batch,
in order of seq. A micro-batch that breaks a rule stops the stream and leaves the collection as it was. A
micro-batch that is delivered again after a failure is recognised by its number, which the commit's own marker holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources.collection import Collection

SCHEMA = "seq long, op string, id long, user_id long, timestamp long, vector array<float>"


def follow(spark: SparkSession, folder: str, target: Collection, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Starts the stream; it takes what is there and ends (availableNow)."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)

    def apply(batch: DataFrame, number: int) -> None:
        target.commit_table(batch, stream=number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mutations per window of event time and kind, with late rows dropped by watermark; events (at timestamp, op)."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")
