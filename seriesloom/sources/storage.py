"""Samples as Parquet by day: write, read, list, drop, export. A folder is the database; Spark's writer commits it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.matchers import metric_is, metric_starts, selector
from seriesloom.sources.model import series_key, valid

SCHEMA = "metric string, labels map<string,string>, series_key string, ts_ms long, value double"


def write(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Appends valid samples, partitioned by day; any age is accepted."""
    rows = valid(samples.withColumn("series_key", series_key("metric", "labels"))).select("metric", "labels", "series_key", "ts_ms", "value")
    by_day = rows.withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))
    # a day's rows to a few tasks by series, so files are neither many nor one
    by_day.repartition("day", F.pmod(F.xxhash64("series_key"), F.lit(8))).sortWithinPartitions("day", "metric", "series_key", "ts_ms").write.mode(mode).partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read(samples: DataFrame, metric: str, labels: dict[str, str] | None = None, start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None, exact: bool = False) -> DataFrame:
    """By name prefix (or the exact name), labels and an inclusive range; of the first `limit` series by key.

    Days are pruned where the table has them.
    """
    rows = samples.where((metric_is if exact else metric_starts)(metric) & selector(labels or {}))
    for bound, op in ((start_ms, ">="), (end_ms, "<=")):
        if bound is not None:
            rows = rows.where(f"ts_ms {op} {int(bound)}L")
            if "day" in samples.columns:
                rows = rows.where(F.expr(f"day {op} date(timestamp_millis({int(bound)}L))"))
    if limit:
        # `limit` keys at most, so small enough to send to every task
        first = rows.select("series_key").distinct().orderBy("series_key").limit(limit)
        rows = rows.join(F.broadcast(first), "series_key", "left_semi")
    return rows


def series(samples: DataFrame, match: str | None = None) -> DataFrame:
    keys = samples.select("series_key").distinct()
    return keys.where(F.col("series_key").contains(match)) if match else keys


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(F.col("labels")[label].alias("label_value")).where("label_value is not null").distinct()


def without(samples: DataFrame, metric: str, labels: dict[str, str] | None = None) -> DataFrame:
    """What stays when the series of a name prefix and labels are dropped."""
    return samples.where(~(metric_starts(metric) & selector(labels or {})))


def drop_metric(spark: SparkSession, path: str, metric: str, labels: dict[str, str] | None = None, into: str | None = None) -> int:
    """Writes the survivors to `into` (path.next by default) and gives the number of series dropped; the caller swaps folders."""
    rows = load(spark, path)
    n = rows.where(metric_starts(metric) & selector(labels or {})).select(F.count_distinct("series_key")).first()[0]
    write(without(rows, metric, labels), into or f"{path}.next", "overwrite")
    return n


def stats(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count_distinct("series_key").alias("num_series"), F.count_distinct("metric").alias("num_metrics"), F.count("*").alias("total_points"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def high_cardinality(samples: DataFrame, threshold: int) -> DataFrame:
    """Metrics with more series than the threshold."""
    return samples.groupBy("metric").agg(F.count_distinct("series_key").alias("num_series")).where(F.col("num_series") > threshold)


def label_cardinality(samples: DataFrame) -> DataFrame:
    """Distinct values of each label of each metric."""
    return samples.select("metric", F.explode("labels").alias("label", "v")).groupBy("metric", "label").agg(F.count_distinct("v").alias("n"))


def exposition(samples: DataFrame) -> DataFrame:
    """name{a="x"} value ts lines, with \\ and quotes escaped in label values."""
    escaped = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    named = F.when(F.size("labels") > 0, F.concat("metric", F.lit("{"), F.array_join(escaped, ","), F.lit("}"))).otherwise(F.col("metric"))
    return samples.select(F.concat_ws(" ", named, F.format_string("%.6f", "value"), F.col("ts_ms").cast("string")).alias("line"))


def export_lines(samples: DataFrame, path: str) -> None:
    exposition(samples).write.mode("overwrite").text(path)


def export_json(samples: DataFrame, path: str) -> None:
    """One JSON object a series: metric, labels and points in order of time."""
    rows = samples.groupBy("metric", "labels", "series_key").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "value"))).alias("points"))
    rows.select("metric", "labels", "points").write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("metric string, labels map<string,string>, points array<struct<ts_ms:bigint,value:double>>").json(path)
    return rows.select("metric", "labels", series_key("metric", "labels").alias("series_key"), F.inline("points"))
