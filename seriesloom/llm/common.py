"""Shared helpers: reading tables, staging intermediate tables, exact distributed selection."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; Python workers learn where this package is."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Put this checkout on the Python path of workers that share it (on a cluster use --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a folder of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Names of the two numbers that tell rows apart.
KEYS = ("__k1", "__k2")


def row_key() -> F.Column:
    """Seeds what is drawn for a document row; equal rows draw alike."""
    return F.xxhash64("doc_id", "text")


def row_keys() -> list[F.Column]:
    """128 bits of doc_id and text. Equal rows share them: they fare alike.

    The first is doc_id itself, which shuffles smaller than a hash; for one that is null or no whole number, a hash.
    """
    number = F.col("doc_id").try_cast("long")
    return [F.coalesce(number, F.xxhash64(F.lit(7), "text", "doc_id")).alias(KEYS[0]), row_key().alias(KEYS[1])]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of text (one row at least), to bound memory."""
    import numpy as np

    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        n = batch.num_rows
        if not n:
            continue
        size = 8 if pa.types.is_large_string(col.type) else 4
        offsets = np.frombuffer(col.buffers()[1], dtype=f"i{size}", count=n + 1, offset=col.offset * size).astype(np.int64)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def split_join(rows: DataFrame, counts: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows joined with counts, which are one row for each value of the keys, by expressions of the keys.

    counts are dealt out by the key itself already; a join by the key would take them as they lie, and the adaptive
    plan splits hot keys only where both sides are shuffled for the join.
    """
    def of(df: DataFrame, k: str) -> F.Column:
        return F.concat(df[k], F.lit("\0")) if df.schema[k].dataType.typeName() == "string" else F.bitwise_not(df[k])

    other = counts.select(*[of(counts, k).alias(f"__{k}") for k in keys], *[c for c in counts.columns if c not in keys])
    on = [of(rows, k) == other[f"__{k}"] for k in keys]
    return rows.join(other, on, how).drop(*[f"__{k}" for k in keys])


def kth_largest(df: DataFrame, column: str, k: int, fan: int = 2048) -> float | None:
    """The k-th largest value of a double column, exactly, by narrowing a histogram of fixed size; k from 1.

    Each round aggregates `fan` counts, whatever the number of rows; no rows reach the driver.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while low < high:
        step = (high - low) / fan
        if step <= 0 or low + step == low:
            # neighbouring doubles: count the values themselves
            for value, c in sorted(df.where(F.col(column).between(low, high)).groupBy(column).count().collect(), reverse=True):
                if k <= c:
                    return value
                k -= c
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(fan - 1)).alias("slot")
        rows = df.where(F.col(column).between(low, high)).groupBy(slot).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["slot"]):
            if k <= r["c"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["c"]
    return low
