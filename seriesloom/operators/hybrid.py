"""Search by time and by vector, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.matchers import metric_starts, selector
from seriesloom.operators.vector import nearest


def time_range(samples: DataFrame, metric: str, labels: dict[str, str], start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Samples of a name prefix and labels in an inclusive range; the first `limit` by series and time."""
    rows = samples.where(metric_starts(metric) & selector(labels) & F.col("ts_ms").between(start_ms, end_ms)).select("series_key", "ts_ms", "value")
    return rows.orderBy("series_key", "ts_ms", "value").limit(limit) if limit else rows


def time_score(start_ms: int, end_ms: int) -> Column:
    """1 in the middle of the range, one half at its ends."""
    length = end_ms - start_ms if end_ms > start_ms else 1
    return 1 - F.abs(0.5 - (F.col("ts_ms") - start_ms) / float(length))


def search(vectors: DataFrame, query: list[float], start_ms: int, end_ms: int, k: int = 10, limit: int = 100, time_weight: float = 0.5, vector_weight: float = 0.5, metric: str = "l2", strict_time: bool = False) -> DataFrame:
    """id, distance, score: candidates by time joined in full with the nearest 2 * limit by vector, the k best scores.

    An id's time score is that of its first sample in the range. strict_time keeps only vectors in the range.
    """
    inside = F.col("ts_ms").between(start_ms, end_ms)
    by_time = vectors.where(inside).groupBy("id").agg(F.min_by(time_score(start_ms, end_ms), "ts_ms").alias("time_score"), F.max("ts_ms").alias("ts_ms"))
    by_vector = nearest(vectors, query, 2 * limit, metric, inside if strict_time else None).select("id", "distance", F.col("score").alias("vector_score"))
    both = by_time.join(by_vector, "id", "full_outer")
    total = time_weight * F.coalesce("time_score", F.lit(0.0)) + vector_weight * F.coalesce("vector_score", F.lit(0.0))
    return both.select("id", "ts_ms", "distance", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def aggregate(samples: DataFrame, metric: str, labels: dict[str, str], start_ms: int, end_ms: int, how: str) -> DataFrame:
    """One value over the samples in a range: avg, sum, min, max, count, or else the last; NULL for none."""
    of = {"avg": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double")}
    return time_range(samples, metric, labels, start_ms, end_ms).agg(of.get(how, F.max(F.struct("ts_ms", "value"))["value"]).alias("value"))


def series_limit(samples: DataFrame, n: int) -> DataFrame:
    """All samples of the first n series by key."""
    first = samples.select("series_key").distinct().orderBy("series_key").limit(n)
    return samples.join(F.broadcast(first), "series_key", "left_semi")


def rank_in_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("rank", F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("ts_ms"), F.desc("value"))))
