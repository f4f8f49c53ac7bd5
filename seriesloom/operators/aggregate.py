"""Aggregation across series at equal times, ranking of series, and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.matchers import drop_labels, keep_labels
from seriesloom.functions.scalar import ARITHMETIC, COMPARISON
from seriesloom.functions.series import latest
from seriesloom.sources.model import series_key

#: What a group shows for a label that a series lacks.
MISSING = "__total"


def function(how: str, q: float | None = None) -> Column:
    one = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "stdvar": F.var_pop}
    if how in one:
        return one[how]("value")
    if how == "count":
        return F.count("value").cast("double")
    if how == "quantile":
        return F.percentile("value", q)
    raise ValueError(f"unknown aggregation {how}")


def aggregate(df: DataFrame, how: str, by: list[str] | None = None, q: float | None = None) -> DataFrame:
    """One row for each time and group, labels in columns of their names; without `by` one group.

    Only these label columns enter the shuffle, not the label map.
    """
    keys = [F.coalesce(F.col("labels")[x], F.lit(MISSING)).alias(x) for x in by or []]
    return df.select("ts_ms", "value", *keys).groupBy("ts_ms", *(by or [])).agg(function(how, q).alias("value"))


def aggregate_without(df: DataFrame, how: str, without: list[str], q: float | None = None) -> DataFrame:
    """Groups by all other labels, written as a series key."""
    group = series_key("metric", drop_labels(*without)).alias("series_key")
    return df.select("ts_ms", "value", group).groupBy("ts_ms", "series_key").agg(function(how, q).alias("value"))


def library_stat(df: DataFrame, how: str, by: list[str]) -> DataFrame:
    """The variant by which stddev and stdvar of one value are NaN."""
    return df.groupBy(*by).agg(F.when(F.count("value") > 1, function(how)).otherwise(float("nan")).alias("value"))


def top(df: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k series with the largest (smallest) last values; ties go to the smaller key."""
    order = F.desc("value") if largest else F.asc("value")
    ranked = latest(df).orderBy(order, "series_key").limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(order, "series_key"))).select("rank", "series_key", "ts_ms", "value")


def top_by(df: DataFrame, k: int, by: str, largest: bool = True) -> DataFrame:
    """The k series in each group of a label."""
    order = F.desc("value") if largest else F.asc("value")
    last = latest(df).withColumn(by, F.coalesce(F.col("labels")[by], F.lit(MISSING)))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, "series_key"))).where(F.col("rank") <= k).select(by, "rank", "series_key", "ts_ms", "value")


def count_values(df: DataFrame, by: list[str]) -> DataFrame:
    """How many samples of a group have each value."""
    keys = [F.coalesce(F.col("labels")[x], F.lit(MISSING)).alias(x) for x in by]
    return df.select("value", *keys).groupBy(*by, "value").agg(F.count("*").alias("n"))


def with_number(df: DataFrame, op: str, number: float, flip: bool = False) -> DataFrame:
    a, b = F.col("value"), F.lit(float(number))
    return df.withColumn("value", ARITHMETIC[op](*((b, a) if flip else (a, b))))


def compare_number(df: DataFrame, op: str, number: float, as_bool: bool = False) -> DataFrame:
    """Keeps the samples that compare, or with as_bool says so by 1 and 0."""
    c = COMPARISON[op](F.col("value"), F.lit(float(number)))
    return df.withColumn("value", c.cast("double")) if as_bool else df.where(c)


def signature(on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """What two series must share to match: the labels in `on`, or all but `ignoring`."""
    labels = keep_labels(*on) if on is not None else drop_labels(*ignoring) if ignoring else F.col("labels")
    return series_key(F.lit(""), labels)


def match(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, many: bool = False) -> DataFrame:
    """left op right for equal signatures and times; `many` lets several left series share one right series.

    A signature with several right samples (or, without `many`, left ones) at a time yields an error when it is run.
    """
    a = left.select("ts_ms", signature(on, ignoring).alias("sig"), "series_key", F.col("value").alias("l"))
    b = right.select("ts_ms", signature(on, ignoring).alias("sig"), F.col("value").alias("r"))

    def single(df: DataFrame, value: str, *more: Column) -> DataFrame:
        n = df.groupBy("ts_ms", "sig").agg(F.first(value).alias(value), F.count("*").alias("n"), *more)
        checked = F.when(F.col("n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("several series match")).cast("double"))
        return n.withColumn(value, checked).drop("n")

    a = a if many else single(a, "l", F.first("series_key").alias("series_key"))
    joined = a.join(single(b, "r"), ["ts_ms", "sig"])
    if op in COMPARISON:
        return joined.where(COMPARISON[op](F.col("l"), F.col("r"))).select("sig", "series_key", "ts_ms", F.col("l").alias("value"))
    return joined.select("sig", "series_key", "ts_ms", ARITHMETIC[op](F.col("l"), F.col("r")).alias("value"))


def set_operation(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """and, unless, or: by signature and time."""
    a, b = (df.withColumn("sig", signature(on, ignoring)) for df in (left, right))
    if op == "and":
        return a.join(b.select("sig", "ts_ms").distinct(), ["sig", "ts_ms"], "left_semi")
    rest = a.join(b.select("sig", "ts_ms").distinct(), ["sig", "ts_ms"], "left_anti")
    if op == "unless":
        return rest
    return a.unionByName(b.join(a.select("sig", "ts_ms").distinct(), ["sig", "ts_ms"], "left_anti"))
