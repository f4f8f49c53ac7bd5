"""Functions over the samples of each series. Samples at one time are ordered by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_KEYS = ["metric", "labels", "series_key"]


def _in_order() -> WindowSpec:
    return Window.partitionBy("series_key").orderBy("ts_ms", "value")


def _at() -> Column:
    return F.struct("ts_ms", "value")


#: Aggregates of a series' values by name.
OVER_TIME = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"), "stddev": F.stddev_pop}


def _steps(df: DataFrame) -> DataFrame:
    return df.withColumn("dv", F.col("value") - F.lag("value").over(_in_order())).withColumn("dt", F.col("ts_ms") - F.lag("ts_ms").over(_in_order())).where("dt is not null")


def _named(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("value", value).select(*_KEYS, "ts_ms", "value")


def rate(df: DataFrame) -> DataFrame:
    """Change a second between neighbours, at the later one; falls count as 0, steps of no time are left out."""
    steps = _steps(df).where("dt > 0").withColumn("r", F.col("dv") / (F.col("dt") / 1000.0))
    return _named(steps, F.when(F.col("r") > 0, F.col("r")).otherwise(0.0))


def irate(df: DataFrame) -> DataFrame:
    """The rate of a series' last two samples; 0 if they share a time."""
    back = Window.partitionBy("series_key").orderBy(F.desc("ts_ms"), F.desc("value"))
    last = df.withColumn("dv", F.col("value") - F.lead("value").over(back)).withColumn("dt", F.col("ts_ms") - F.lead("ts_ms").over(back)).withColumn("n", F.row_number().over(back)).where("n = 1 and dt is not null")
    r = F.when(F.col("dt") > 0, F.col("dv") / (F.greatest("dt", F.lit(1)) / 1000.0)).otherwise(0.0)
    return _named(last, F.when(r > 0, r).otherwise(0.0))


def increase(df: DataFrame) -> DataFrame:
    """Last minus first sample, at the last; series of one sample are left out."""
    ends = df.groupBy(*_KEYS).agg(F.min(_at()).alias("a"), F.max(_at()).alias("b"), F.count("*").alias("n")).where("n > 1")
    return ends.select(*_KEYS, F.col("b.ts_ms").alias("ts_ms"), (F.col("b.value") - F.col("a.value")).alias("value"))


def increase_points(df: DataFrame, range_ms: int) -> DataFrame:
    """Each step scaled to the range; may fall."""
    return _named(_steps(df).where("dt > 0"), F.col("dv") * (F.lit(range_ms / 1000.0) / (F.col("dt") / 1000.0)))


def delta(df: DataFrame) -> DataFrame:
    """Each later sample minus the first."""
    first = F.first_value("value").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return _named(df.withColumn("first", first).withColumn("n", F.row_number().over(_in_order())).where("n > 1"), F.col("value") - F.col("first"))


def idelta(df: DataFrame) -> DataFrame:
    return _named(_steps(df), F.col("dv"))


def over_time(df: DataFrame, how: str) -> DataFrame:
    """One value for each series, at its last sample; stddev needs two."""
    out = df.groupBy(*_KEYS).agg(F.max("ts_ms").alias("ts_ms"), OVER_TIME[how]("value").alias("value"), F.count("*").alias("n"))
    return out.where("n > 1" if how == "stddev" else "true").select(*_KEYS, "ts_ms", "value")


def over_time_points(df: DataFrame, window_ms: int, *how: str) -> DataFrame:
    """For each sample what lies in [ts - window, ts], one column a function: they share one window.

    stddev is NULL for a single sample.
    """
    w = Window.partitionBy("series_key").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    for h in how:
        df = df.withColumn(h, F.when(F.count("value").over(w) > 1, OVER_TIME[h]("value").over(w)) if h == "stddev" else (F.count("value").over(w).cast("double") if h == "count" else OVER_TIME[h]("value").over(w)))
    return df


def bucket(interval_ms: int, ts: str = "ts_ms") -> Column:
    return F.col(ts) - F.pmod(F.col(ts), F.lit(interval_ms))


def downsample(df: DataFrame, interval_ms: int, *how: str) -> DataFrame:
    """One row for each series and bucket, at the bucket's start, a column a function; unknown functions are averages."""
    of = {"first": F.min(_at())["value"], "last": F.max(_at())["value"], "p50": F.percentile("value", 0.5), "p95": F.percentile("value", 0.95), "p99": F.percentile("value", 0.99)}
    aggs = [(of[h] if h in of else OVER_TIME.get(h, F.avg)("value")).alias(h) for h in how]
    return df.groupBy(*_KEYS, bucket(interval_ms).alias("ts_ms")).agg(*aggs)


def bounds(df: DataFrame) -> DataFrame:
    """Start, end, length and duration (NULL for one sample) of each series."""
    out = df.groupBy("series_key").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))
    return out.withColumn("duration_ms", F.when(F.col("n") > 1, F.col("end_ms") - F.col("start_ms")))


def predict_linear(df: DataFrame, seconds: float, by: list[str] | None = None) -> DataFrame:
    """Least squares over each series, evaluated so many seconds after its last sample; times are taken from the last."""
    by = by or _KEYS
    last = df.groupBy(*by).agg(F.max("ts_ms").alias("__last"))
    keyed = df.join(last, by) if "labels" not in by else df.withColumn("__last", F.max("ts_ms").over(Window.partitionBy("series_key")))
    x = (F.col("ts_ms") - F.col("__last")) / 1000.0
    fit = keyed.groupBy(*by).agg(F.max("ts_ms").alias("ts_ms"), F.count("*").alias("n"), F.min("value").alias("one"), F.regr_slope("value", x).alias("a"), F.regr_intercept("value", x).alias("b"))
    value = F.when(F.col("n") == 1, F.col("one")).otherwise(F.coalesce(F.col("a") * seconds + F.col("b"), F.lit(float("nan"))))
    return fit.select(*by, "ts_ms", value.alias("value"))


def absent(df: DataFrame, now_ms: int) -> DataFrame:
    """One row, 1 if df has no rows; else none."""
    return df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("absent{}").alias("series_key"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(1.0).alias("value"))


def scalar(df: DataFrame) -> DataFrame:
    """The value of series with one sample, NaN at time 0 for others."""
    out = df.groupBy("series_key").agg(F.count("*").alias("n"), F.max(_at()).alias("at"))
    one = F.col("n") == 1
    return out.select("series_key", F.when(one, F.col("at.ts_ms")).otherwise(F.lit(0).cast("long")).alias("ts_ms"), F.when(one, F.col("at.value")).otherwise(float("nan")).alias("value"))


def dod(df: DataFrame) -> DataFrame:
    """Second differences of each series' times: what a delta-of-delta code would store."""
    first = df.withColumn("d1", F.col("ts_ms") - F.lag("ts_ms").over(_in_order()))
    return first.withColumn("dod", F.col("d1") - F.lag("d1").over(_in_order())).select("series_key", "ts_ms", "value", "d1", "dod")


def latest(df: DataFrame) -> DataFrame:
    """The last sample of each series."""
    return df.groupBy(*_KEYS).agg(F.max(_at()).alias("at")).select(*_KEYS, F.col("at.ts_ms").alias("ts_ms"), F.col("at.value").alias("value"))


def offset(df: DataFrame, ms: int) -> DataFrame:
    """What the series were so long before: samples moved to later times."""
    return df.withColumn("ts_ms", F.col("ts_ms") + ms)


def gap_scores(df: DataFrame, last: int = 100) -> DataFrame:
    """How unusual each gap between samples is: (gap - mean) / deviation of the up to `last` gaps before, at least 0.

    A deviation of 0 counts as 1; the first gaps of a series have none to compare with and are left out.
    """
    gaps = _steps(df).select(*_KEYS, "ts_ms", "value", F.col("dt").cast("double").alias("dt"))
    before = _in_order().rowsBetween(-last, -1)
    m, s = F.avg("dt").over(before), F.stddev_pop("dt").over(before)
    scored = gaps.withColumn("m", m).withColumn("s", F.when(s > 0, s).otherwise(1.0)).where("m is not null")
    return _named(scored, F.greatest(F.lit(0.0), (F.col("dt") - F.col("m")) / F.col("s")))


def steps(df: DataFrame, start_ms: int, end_ms: int, step_ms: int, lookback_ms: int) -> DataFrame:
    """A range query: at start, start + step, ... each series' last sample not older than lookback.

    Each sample serves the steps in [ts, ts + lookback]; those are listed from the sample, so no join by range is needed.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("ts_ms") - start_ms) / step_ms))
    last = F.least(F.lit((end_ms - start_ms) // step_ms), F.floor((F.col("ts_ms") + lookback_ms - start_ms) / step_ms))
    served = df.where((F.col("ts_ms") <= end_ms) & (F.col("ts_ms") >= start_ms - lookback_ms)).withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    return served.groupBy(*_KEYS, (F.col("i") * step_ms + start_ms).alias("step_ms")).agg(F.max(_at())["value"].alias("value"))
