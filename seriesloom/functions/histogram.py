"""Quantiles and fractions of cumulative histograms: rows of groups, le and cumulative."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of value up to each bound: one row a group and bound."""
    counts = df.groupBy(*by).agg(*[F.sum((F.col(value) <= b).cast("long")).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(*by, F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)])))


def quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Linear within the first bucket that reaches q of the total; NaN for no counts; 0 is below the first bound."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)))
    rows = rows.withColumn("total", F.max("cumulative").over(Window.partitionBy(*by)))
    step = F.col("cumulative") - F.col("before")
    inside = F.when(step == 0, F.col("le")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.lit(q) * F.col("total") - F.col("before")) / F.when(step == 0, 1.0).otherwise(step))
    found = rows.withColumn("inside", inside).groupBy(*by).agg(F.max("total").alias("total"), F.min(F.when((F.col("cumulative") >= F.lit(q) * F.col("total")) & (F.col("total") > 0), F.struct("le", "inside")))["inside"].alias("x"))
    return found.select(*by, F.when(F.col("total") > 0, F.col("x")).otherwise(float("nan")).alias("value"))


def fraction(buckets: DataFrame, by: list[str], lower: float, upper: float) -> DataFrame:
    """The share in (lower, upper], by the bounds at or below them."""
    below = [F.coalesce(F.max(F.when(F.col("le") <= x, F.col("cumulative"))), F.lit(0.0)) for x in (lower, upper)]
    out = buckets.groupBy(*by).agg(below[0].alias("a"), below[1].alias("b"), F.max("cumulative").alias("total"))
    return out.select(*by, F.when(F.col("total") > 0, (F.col("b") - F.col("a")) / F.when(F.col("total") > 0, F.col("total"))).otherwise(float("nan")).alias("value"))
