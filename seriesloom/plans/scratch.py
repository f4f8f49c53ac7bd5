"""Paths for tables that queries write and read again: in the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
