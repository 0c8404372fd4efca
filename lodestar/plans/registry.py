"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

UNITS = """units AS (SELECT vec_id, label, list_transform(embedding, lambda x:
  (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT) AS v FROM embeddings)"""
RECORDS = f"""WITH {UNITS}, rec AS (SELECT vec_id AS id, user_id, epoch_us(ts) AS timestamp, v AS vector,
  (vec_id % 7 <> 0) AS live, vec_id AS slot FROM units JOIN events ON vec_id = event_id)"""
META = """WITH rec AS (SELECT event_id AS id, user_id, epoch_us(ts) AS timestamp, (event_id % 7 <> 0) AS live, event_id AS slot FROM events)"""
SAMPLES = """WITH s AS (SELECT event_id AS id, user_id % 5 AS run, event_type AS engine, CAST(floor(value * 1000) AS BIGINT) AS ns, value FROM events)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as records: owner and time are those of the event with the same number; every seventh is deleted."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.normalized(F.col("embedding")).alias("vector"))
    return e.join(meta(spark, sf_dir), "id")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalized(F.col("embedding")).alias("v"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records without vectors."""
    e = table(spark, sf_dir, "events")
    time = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return e.select(F.col("event_id").alias("id"), "user_id", time.alias("timestamp"), (F.col("event_id") % 7 != 0).alias("live"), F.col("event_id").alias("slot"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured samples: run, engine and nanoseconds."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("run"), F.col("event_type").alias("engine"), F.floor(F.col("value") * 1000).cast("long").alias("ns"), "value")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])
