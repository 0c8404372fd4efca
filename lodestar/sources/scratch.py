"""New folders for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir, which all executors see; only in local mode, without that setting, a local one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
