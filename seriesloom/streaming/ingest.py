"""Structured Streaming: ingest, tumbling downsample, rate from one sample to the next, expiry by watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.sources.storage import write

SAMPLES = pa.schema([("series_key", pa.string()), ("ts_ms", pa.int64()), ("value", pa.float64())])


def source(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch of samples to a database folder; the checkpoint is the log from which a restart goes on."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: write(df, path)).start()


def downsample(stream: DataFrame, interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, sum, min and max of each series and interval. Rows later than the watermark are dropped and state expires with it."""
    timed = stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    out = timed.groupBy("series_key", F.window("ts", interval).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("series_key", F.unix_millis("w.start").alias("ts_ms"), "n", "total", "low", "high")


def downsample_all(stream: DataFrame, path: str, interval: str = "1 hour") -> DataFrame:
    """The downsample of all that is there, without a bound on lateness: each run upserts the windows it changed.

    The files hold every version of a window, numbered by batch; the last one counts.
    """
    timed = stream.withColumn("ts", F.timestamp_millis("ts_ms"))
    out = timed.groupBy("series_key", F.window("ts", interval).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    out = out.select("series_key", F.unix_millis("w.start").alias("ts_ms"), "n", "total", "low", "high")

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/data")

    out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    versions = stream.sparkSession.read.parquet(f"{path}/data")
    last = versions.groupBy("series_key", "ts_ms").agg(F.max_by(F.struct("n", "total", "low", "high"), "batch").alias("x"))
    return last.select("series_key", "ts_ms", "x.*")


def _pack(samples: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(samples, SAMPLES, preserve_index=False)
    with (sink := pa.BufferOutputStream()), pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _next_rates(known: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rates of rows of many series, given the last sample known of each, and the samples known after them."""
    samples = pd.concat([known, rows], ignore_index=True) if len(known) else rows.reset_index(drop=True)
    code = pd.factorize(samples["series_key"], use_na_sentinel=False)[0]
    ts, value, new = samples["ts_ms"].to_numpy(), samples["value"].to_numpy(), np.arange(len(samples)) >= len(known)
    since = np.full(int(code.max()) + 1, np.iinfo(np.int64).min)
    since[code[~new]] = ts[~new]
    keep = np.flatnonzero(ts >= since[code])
    order = keep[np.lexsort((value[keep], new[keep], ts[keep], code[keep]))]
    same, dt = code[order[1:]] == code[order[:-1]], np.diff(ts[order])
    at = np.flatnonzero(same & (dt > 0))
    with np.errstate(invalid="ignore", over="ignore"):
        change = np.diff(value[order])[at] / (dt[at] / 1000.0)
    out = samples.iloc[order[at + 1]].assign(value=np.where(change > 0, change, 0.0))
    return out, samples.iloc[order[np.append(~same, True)]]


def rate(stream: DataFrame, buckets: int = 1024) -> DataFrame:
    """Change a second from each sample to the next of its series, across micro-batches; falls count as 0.

    State is the last sample of each series, and never expires. A sample not later than it gives no row; one without a
    time counts for nothing. Series are dealt to `buckets` by hash, and a call works on all of a bucket's series at once,
    since a call for each series costs far more than its samples. A task holds one bucket's samples of a micro-batch at a
    time; a checkpoint keeps to the number of buckets it began with.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[SAMPLES.names] for b in batches if len(b)])
        known = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else rows[:0]
        out, known = _next_rates(known, rows)
        state.update((_pack(known),))
        yield out

    dealt = stream.where("ts_ms is not null").select(F.pmod(F.xxhash64("series_key"), F.lit(buckets)).alias("bucket"), *SAMPLES.names)
    return dealt.groupBy("bucket").applyInPandasWithState(step, "series_key string, ts_ms long, value double", "samples binary", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a Parquet folder, and reads that."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
