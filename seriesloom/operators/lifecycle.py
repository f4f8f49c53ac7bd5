"""Retention policies, tiers and downsampling by policy. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.series import downsample

#: Milliseconds of each resolution.
RESOLUTIONS = {"raw": 1, "5m": 300_000, "1h": 3_600_000, "1d": 86_400_000, "1w": 604_800_000}
DAY = 86_400
#: Built-in policies as seconds and resolution.
BUILT_IN = {"default": (15 * DAY, "raw"), "short": (DAY, "raw"), "long": (365 * DAY, "1h"), "15d": (15 * DAY, "raw"), "30d": (30 * DAY, "5m"), "90d": (90 * DAY, "1h"), "1y": (365 * DAY, "1d")}


def policies(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    """(namespace, position, seconds, resolution) from (namespace, seconds, resolution) in order of insertion."""
    for _, seconds, resolution in rows:
        if resolution not in RESOLUTIONS or seconds <= 0:
            raise ValueError("a policy needs a positive duration and a known resolution")
    return spark.createDataFrame([(n, i, s, r) for i, (n, s, r) in enumerate(rows)], "namespace string, position int, seconds long, resolution string")


def policy_of(names: DataFrame, policy: DataFrame, name: str = "name") -> DataFrame:
    """names with namespace, seconds and resolution: the exact policy, else the first inserted whose namespace is a prefix, else the default.

    Distinct names meet the policies, which are few; samples are joined to the result.
    """
    distinct = names.select(name).distinct()
    met = distinct.join(F.broadcast(policy), F.col(name).startswith(F.col("namespace")), "left")
    first = Window.partitionBy(name).orderBy(F.desc(F.col("namespace") == F.col(name)), "position")
    best = met.withColumn("n", F.row_number().over(first)).where("n = 1")
    seconds, resolution = BUILT_IN["default"]
    return best.select(name, F.coalesce("namespace", F.lit("default")).alias("namespace"), F.coalesce("seconds", F.lit(seconds)).alias("seconds"), F.coalesce("resolution", F.lit(resolution)).alias("resolution"))


def expired(now_ms: int, seconds: Column | int) -> Column:
    return F.col("ts_ms") < F.lit(now_ms) - (F.lit(seconds) if isinstance(seconds, int) else seconds) * 1000


def cleanup(samples: DataFrame, policy: DataFrame, now_ms: int) -> DataFrame:
    """The samples that their metric's policy keeps; nothing is changed in place, so counting it is a dry run."""
    rules = policy_of(samples, policy, "metric")
    # a row a metric name: how to join is left to the planner, which knows its size
    return samples.join(rules, "metric").where(~expired(now_ms, F.col("seconds"))).drop("namespace", "seconds", "resolution")


def tiers(samples: DataFrame, now_ms: int, hot_ms: int = 3_600_000, warm_ms: int = 86_400_000, cold: bool = True) -> DataFrame:
    """series_key, end_ms, n and tier by the age of each series' last sample."""
    ends = samples.groupBy("series_key").agg(F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))
    oldest = F.lit("cold" if cold else "warm")
    return ends.withColumn("tier", F.when(F.col("end_ms") >= now_ms - hot_ms, "hot").when(F.col("end_ms") >= now_ms - warm_ms, "warm").otherwise(oldest))


def tier_stats(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("tier").agg(F.count("*").alias("series"), F.sum("n").alias("points"))


def should_downsample(resolution: str, interval_ms: int) -> bool:
    return resolution != "raw" and interval_ms > RESOLUTIONS[resolution]


def at_resolution(samples: DataFrame, resolution: str) -> DataFrame:
    """Averages at a policy's resolution; raw samples stay."""
    if resolution == "raw":
        return samples
    return downsample(samples, RESOLUTIONS[resolution], "avg").withColumnRenamed("avg", "value")
