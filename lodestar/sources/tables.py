"""Tables of evaluation runs: readers and writers of CSV, key=value and JSON files, and a store of runs.

An empty CSV field is not reported, not zero: it is read as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = ("metadata", "truth", "tuning", "samples", "runs", "lifecycle")
# The columns of a truth file; its ids are joined by a semicolon.
TRUTH_COLUMNS = "split string, query_index long, ids string"
RUN = "run_id string, received_at timestamp, payload string"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Rows of files with a header whose names and order must be the schema's."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=False, nullValue="", emptyValue="", mode="FAILFAST")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """source, properties (a map) of files of key=value lines; empty lines go, a value may hold =; of a repeated key the last counts."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.split("value", "\r?\n").alias("lines"))
    full = F.filter("lines", lambda x: F.instr(x, "=") > 0)
    pair = F.transform(full, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.aggregate(pair, F.create_map().cast("map<string,string>"), lambda m, p: F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda e: e["key"] != p["k"]), F.array(F.struct(p["k"].alias("key"), p["v"].alias("value"))))))
    return lines.select("source", last.alias("properties"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array or of JSON lines; a field that the schema lacks is ignored, a malformed row stops the read."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_recalls(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank, id, distance from Parquet rows (query_id, embedding, recall), recall being the true neighbours in order."""
    rows = spark.read.schema("query_id long, embedding array<float>, recall array<struct<id: long, distance: float>>").parquet(path)
    return rows.select("query_id", F.posexplode("recall").alias("at", "r")).select("query_id", (F.col("at") + 1).alias("rank"), "r.id", "r.distance")


def write_result(df: DataFrame, folder: str, name: str) -> str:
    """One of RESULTS as CSV files with a header below folder; arrays are joined by semicolons. The folder must not exist yet."""
    if name not in RESULTS:
        raise ValueError("UnknownResult")
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(flat).write.csv(f"{folder}/{name}", header=True, nullValue="", emptyValue="")
    return f"{folder}/{name}"


def write_summary(spark: SparkSession, facts: dict, folder: str) -> str:
    """key=value lines, sorted by key."""
    rows = [(f"{k}={'' if v is None else v}",) for k, v in sorted(facts.items())]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{folder}/summary")
    return f"{folder}/summary"


class RunStore:
    """Runs as they are received, appended as Parquet; a payload is kept as it came, as one JSON string."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def insert(self, runs: DataFrame) -> None:
        """Rows (run_id, received_at, payload); a run that is sent again is a row again, and the latest counts."""
        runs.select([c.split()[0] for c in RUN.split(", ")]).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        every = self.spark.read.schema(RUN).parquet(self.path)
        return every.groupBy("run_id").agg(F.max_by(F.struct("received_at", "payload"), F.struct("received_at", "payload")).alias("r")).select("run_id", "r.received_at", "r.payload")

    def latest(self, limit: int = 500) -> DataFrame:
        return self.rows().orderBy(F.desc("received_at"), F.desc("run_id")).limit(limit)

    def read(self, run_id: str):
        return self.rows().where(F.col("run_id") == run_id).first()
