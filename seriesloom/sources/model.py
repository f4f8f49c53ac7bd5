"""Samples: metric, labels MAP<STRING,STRING>, series_key, ts_ms BIGINT, value DOUBLE; and adapters to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_key(metric: Column | str, labels: Column | str) -> Column:
    """name{a="x",b="y"}, labels by name, nothing escaped; no labels leave the name alone."""
    metric, labels = (F.col(x) if isinstance(x, str) else x for x in (metric, labels))
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(metric, F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(metric)


def samples(df: DataFrame, metric: str, labels: dict[str, Column], ts_ms: Column, value: Column) -> DataFrame:
    """Rows of any table as samples; rows without a time, a value or any of the labels are left out.

    The names of the labels are known here, so the key is a plain concatenation that stays in generated code.
    """
    names = sorted(labels)
    pairs = [x for name, c in labels.items() for x in (F.lit(name), c.cast("string"))]
    parts = [x for i, n in enumerate(names) for x in (F.lit(("," if i else f"{metric}{{") + f'{n}="'), labels[n].cast("string"), F.lit('"'))]
    key = F.concat(*parts, F.lit("}")) if names else F.lit(metric)
    some = df.where(ts_ms.isNotNull() & value.isNotNull())
    for c in labels.values():
        some = some.where(c.isNotNull())
    return some.select(F.lit(metric).alias("metric"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"), key.alias("series_key"), ts_ms.cast("long").alias("ts_ms"), value.cast("double").alias("value"))


def millis(c: Column | str) -> Column:
    """Milliseconds of a timestamp with or without zone, floored; the session's zone is UTC."""
    return F.unix_millis((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table: metric events, labels event_type and user_id."""
    df = table(spark, sf_dir, "events")
    return samples(df, "events", {"event_type": F.col("event_type"), "user_id": F.col("user_id")}, millis("ts"), F.col("value"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals: metric orders, labels status and priority."""
    df = table(spark, sf_dir, "orders")
    return samples(df, "orders", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, millis("o_orderdate"), F.col("o_totalprice"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a time of a minute for each id: id, metric, labels, ts_ms, value, embedding DOUBLE[]."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").cast("string").alias("id"), F.lit("embedding").alias("metric"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("labels"), (F.lit(1704067200000) + F.col("vec_id") * 60000).alias("ts_ms"), F.col("label").cast("double").alias("value"), F.col("embedding").cast("array<double>").alias("embedding"))


def valid(df: DataFrame) -> DataFrame:
    """Samples that may be stored: a name, non-empty label names and values, a time from 0 on."""
    named = F.forall(F.map_entries("labels"), lambda e: (e["key"] != "") & F.coalesce(e["value"] != "", F.lit(False)))
    return df.where((F.col("metric") != "") & named & (F.col("ts_ms") >= 0))


def relabel(df: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Sets labels; a label of the same name is replaced."""
    given = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
    kept = F.map_filter("labels", lambda k, _: ~k.isin(*extra))
    return df.withColumn("labels", F.map_concat(kept, given)).withColumn("series_key", series_key("metric", "labels"))
