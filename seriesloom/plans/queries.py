"""The registered queries over the provided tables, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import histogram, matchers, scalar, series
from seriesloom.operators import aggregate, hybrid, lifecycle, placement, vector
from seriesloom.plans.scratch import scratch
from seriesloom.sources import model, storage
from seriesloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

HOUR, DAY = 3_600_000, 86_400_000
NOW = 1_706_745_600_000  # the present of retention and tier queries
KEY = "'events{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}'"
COMMON = f"""WITH ev AS (SELECT 'events' AS metric, event_type, CAST(user_id AS VARCHAR) AS user_id, {KEY} AS series_key, epoch_us(ts) // 1000 AS ts_ms, value FROM events),
od AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value FROM orders),
vec AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, 1704067200000 + vec_id * 60000 AS ts_ms, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"""
ORDERED = "PARTITION BY series_key ORDER BY ts_ms, value"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"{COMMON}\n{sql}" if not sql.startswith("WITH") else COMMON + ",\n" + sql.removeprefix("WITH ")
        return f

    return put


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


def points(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("series_key", "ts_ms", r("value", digits).alias("value"))


# Scans, catalog, formats


@query("sum_by_rate", f"""WITH down AS (SELECT event_type, series_key, ts_ms // {HOUR} * {HOUR} AS ts_ms, avg(value) AS value FROM ev GROUP BY ALL),
rates AS (SELECT event_type, ts_ms, (value - lag(value) OVER w) / ((ts_ms - lag(ts_ms) OVER w) / 1000.0) AS r FROM down WINDOW w AS (PARTITION BY series_key ORDER BY ts_ms))
SELECT event_type, ts_ms, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END), 6) AS value FROM rates WHERE r IS NOT NULL GROUP BY ALL""")
def sum_by_rate(spark: SparkSession, d: str) -> DataFrame:
    down = series.downsample(model.events(spark, d), HOUR, "avg").withColumnRenamed("avg", "value")
    return aggregate.aggregate(series.rate(down), "sum", ["event_type"]).select("event_type", "ts_ms", r("value").alias("value"))


@query("scan_read_range", "SELECT series_key, ts_ms, value FROM ev WHERE event_type = 'click' AND ts_ms BETWEEN 1704067200000 AND 1711929600000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.read(model.events(spark, d), "event", {"event_type": "click", "user_id": "*"}, 1704067200000, 1711929600000).select("series_key", "ts_ms", "value")


@query("read_series_limit", "SELECT series_key, ts_ms, value FROM ev WHERE series_key IN (SELECT DISTINCT series_key FROM ev ORDER BY 1 LIMIT 20)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.series_limit(model.events(spark, d), 20).select("series_key", "ts_ms", "value")


@query("series_list", "SELECT DISTINCT series_key FROM ev WHERE contains(series_key, 'view')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.series(model.events(spark, d), "view")


@query("label_values", "SELECT DISTINCT event_type AS label_value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.label_values(model.events(spark, d), "event_type")


@query("drop_survivors", "SELECT event_type, count(*) AS n FROM ev WHERE event_type <> 'click' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = storage.without(model.events(spark, d), "events", {"event_type": "click"})
    return kept.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


@query("db_stats", "SELECT count(DISTINCT series_key) AS num_series, count(DISTINCT metric) AS num_metrics, count(*) AS total_points, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.stats(model.events(spark, d))


@query("high_cardinality", "SELECT metric, count(DISTINCT series_key) AS num_series FROM ev GROUP BY ALL HAVING count(DISTINCT series_key) > 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.high_cardinality(model.events(spark, d), 100)


@query("label_cardinality", "SELECT metric, 'event_type' AS label, count(DISTINCT event_type) AS n FROM ev GROUP BY ALL UNION ALL SELECT metric, 'user_id', count(DISTINCT user_id) FROM ev GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.label_cardinality(model.events(spark, d))


@query("exposition_format", "SELECT series_key || ' ' || printf('%.6f', value) || ' ' || ts_ms AS line FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return storage.exposition(model.events(spark, d))


@query("write_read_round_trip", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE ts_ms >= 1705276800000 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "db")
    storage.write(model.events(spark, d), path)
    back = storage.read(storage.load(spark, path), "events", start_ms=1705276800000)
    return back.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("export_json_round_trip", "SELECT series_key, ts_ms, value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    storage.export_json(model.events(spark, d), path)
    return storage.import_json(spark, path).select("series_key", "ts_ms", "value")


# Matchers


def _match(name: str, where: Callable[[], Column], sql: str) -> None:
    @query(name, f"SELECT priority, ts_ms, value FROM od WHERE {sql}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        orders = model.orders(spark, d)
        # urgent orders lack their status, for matchers on a missing label
        urgent = orders.withColumn("labels", F.when(F.col("labels")["priority"] == "1-URGENT", matchers.drop_labels("status")).otherwise(F.col("labels")))
        return urgent.where(where()).select(F.col("labels")["priority"].alias("priority"), "ts_ms", "value")


_LACKS = "priority = '1-URGENT'"
_match("match_eq", lambda: matchers.matcher("status", "=", "O"), f"status = 'O' AND NOT {_LACKS}")
_match("match_ne_missing", lambda: matchers.matcher("status", "!=", "O"), f"status <> 'O' OR {_LACKS}")
_match("match_re_prefix", lambda: matchers.matcher("priority", "=~", "[23]-"), "regexp_matches(priority, '^[23]-')")
_match("match_nre", lambda: matchers.matcher("status", "!~", "O|P"), f"NOT regexp_matches(status, '^(O|P)') AND NOT {_LACKS}")
_match("match_all", lambda: matchers.all_of(("status", "=", "F"), ("priority", "!=", "2-HIGH")), f"status = 'F' AND priority <> '2-HIGH' AND NOT {_LACKS}")
_match("dict_wildcard", lambda: matchers.selector({"status": "*", "priority": "5-LOW"}), "priority = '5-LOW'")
_match("metric_name_and_label", lambda: matchers.metric_with_label("ord", "status", "P"), f"status = 'P' AND NOT {_LACKS}")


@query("label_projection", "SELECT event_type, count(*) AS n FROM ev GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = model.events(spark, d).select(matchers.keep_labels("event_type").alias("labels"))
    return kept.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


# Series functions

_STEP = f"SELECT series_key, ts_ms, value, value - lag(value) OVER w AS dv, ts_ms - lag(ts_ms) OVER w AS dt, first_value(value) OVER w AS v0, row_number() OVER w AS n FROM ev WINDOW w AS ({ORDERED})"


def _series(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    @query(name, sql)
    def _(spark: SparkSession, d: str) -> DataFrame:
        return points(f(model.events(spark, d)))


_series("rate", series.rate, f"WITH s AS ({_STEP}) SELECT series_key, ts_ms, round(greatest(dv / (dt / 1000.0), 0), 6) AS value FROM s WHERE dt > 0")
_series("increase_pairs", lambda x: series.increase_points(x, HOUR), f"WITH s AS ({_STEP}) SELECT series_key, ts_ms, round(dv * (3600.0 / (dt / 1000.0)), 6) AS value FROM s WHERE dt > 0")
_series("delta_first", series.delta, f"WITH s AS ({_STEP}) SELECT series_key, ts_ms, round(value - v0, 6) AS value FROM s WHERE n > 1")
_series("idelta", series.idelta, f"WITH s AS ({_STEP}) SELECT series_key, ts_ms, round(dv, 6) AS value FROM s WHERE dt IS NOT NULL")
_series("increase_total", series.increase, f"WITH s AS (SELECT series_key, first_value(value) OVER w AS a, last_value(value) OVER w AS b, last_value(ts_ms) OVER w AS ts_ms, count(*) OVER w AS c FROM ev WINDOW w AS ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT DISTINCT series_key, ts_ms, round(b - a, 6) AS value FROM s WHERE c > 1")
_series("irate", series.irate, f"WITH s AS ({_STEP}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY n DESC) = 1) SELECT series_key, ts_ms, round(CASE WHEN dt > 0 THEN greatest(dv / (dt / 1000.0), 0) ELSE 0 END, 6) AS value FROM l WHERE dt IS NOT NULL")

_SQL_AGG = {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(value) AS DOUBLE)", "stddev": "stddev_pop(value)"}
for _how, _agg in _SQL_AGG.items():
    _series(f"{_how}_over_time", lambda x, h=_how: series.over_time(x, h), f"SELECT series_key, max(ts_ms) AS ts_ms, round({_agg}, 6) AS value FROM ev GROUP BY series_key" + (" HAVING count(*) > 1" if _how == "stddev" else ""))


@query("sliding_over_time", f"""SELECT series_key, ts_ms, round(avg(value) OVER w, 6) AS avg, round(sum(value) OVER w, 6) AS sum, min(value) OVER w AS min, max(value) OVER w AS max,
CAST(count(*) OVER w AS DOUBLE) AS count, CASE WHEN count(*) OVER w > 1 THEN round(stddev_pop(value) OVER w, 5) END AS stddev
FROM ev WINDOW w AS (PARTITION BY series_key ORDER BY ts_ms RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = series.over_time_points(model.events(spark, d), 30 * DAY, *_SQL_AGG)
    return out.select("series_key", "ts_ms", r("avg").alias("avg"), r("sum").alias("sum"), "min", "max", "count", r("stddev", 5).alias("stddev"))


_DOWN = {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, (ts_ms, value))", "last": "arg_max(value, (ts_ms, value))", "p50": "quantile_cont(value, 0.5)", "p95": "quantile_cont(value, 0.95)", "p99": "quantile_cont(value, 0.99)", "count": "CAST(count(*) AS DOUBLE)"}
for _how, _agg in _DOWN.items():

    @query(f"downsample_{_how}", f"SELECT status, priority, ts_ms - ts_ms % {30 * DAY} AS ts_ms, round({_agg}, 7) AS value FROM od GROUP BY ALL")
    def _(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        down = series.downsample(model.orders(spark, d), 30 * DAY, how)
        return down.select(F.col("labels")["status"].alias("status"), F.col("labels")["priority"].alias("priority"), "ts_ms", r(how, 7).alias("value"))


@query("series_bounds", "SELECT series_key, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n, CASE WHEN count(*) > 1 THEN max(ts_ms) - min(ts_ms) END AS duration_ms FROM ev GROUP BY series_key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.bounds(model.events(spark, d))


@query("predict_linear", "WITH m AS (SELECT event_type, max(ts_ms) AS mt FROM ev GROUP BY ALL) SELECT event_type, mt AS ts_ms, round(regr_slope(value, (ts_ms - mt) / 1e3) * 3600 + regr_intercept(value, (ts_ms - mt) / 1e3), 4) AS value FROM ev JOIN m USING (event_type) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = model.events(spark, d).select(F.col("labels")["event_type"].alias("event_type"), "ts_ms", "value")
    return series.predict_linear(rows, 3600, ["event_type"]).withColumn("value", r("value", 4))


@query("absent", f"SELECT 'absent{{}}' AS series_key, {NOW} AS ts_ms, CAST(1 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM ev WHERE event_type = 'none such') WHERE n = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.absent(model.events(spark, d).where(matchers.matcher("event_type", "=", "none such")), NOW)


@query("scalar_fn", "SELECT series_key, CASE WHEN count(*) = 1 THEN max(ts_ms) ELSE 0 END AS ts_ms, CASE WHEN count(*) = 1 THEN max(value) ELSE CAST('nan' AS DOUBLE) END AS value FROM ev GROUP BY series_key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.scalar(model.events(spark, d))


@query("dod_transform", f"WITH s AS (SELECT series_key, ts_ms, value, ts_ms - lag(ts_ms) OVER ({ORDERED}) AS d1 FROM ev) SELECT series_key, ts_ms, value, d1, d1 - lag(d1) OVER ({ORDERED}) AS dod FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.dod(model.events(spark, d))


@query("offset", f"SELECT series_key, ts_ms + {DAY} AS ts_ms, value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.offset(model.events(spark, d), DAY).select("series_key", "ts_ms", "value")


@query("gap_scores", f"""WITH g AS (SELECT event_type, ts_ms, value, CAST(ts_ms - lag(ts_ms) OVER w AS DOUBLE) AS dt FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms, value)),
s AS (SELECT *, avg(dt) OVER p AS m, stddev_pop(dt) OVER p AS s FROM g WHERE dt IS NOT NULL WINDOW p AS (PARTITION BY event_type ORDER BY ts_ms, value ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT event_type, ts_ms, round(greatest(0, (dt - m) / CASE WHEN s > 0 THEN s ELSE 1 END), 5) AS value FROM s WHERE m IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    by_type = model.samples(model.table(spark, d, "events"), "events", {"event_type": F.col("event_type")}, model.millis("ts"), F.col("value"))
    return series.gap_scores(by_type).select(F.col("labels")["event_type"].alias("event_type"), "ts_ms", r("value", 5).alias("value"))


@query("ivf_recall")
def _(spark: SparkSession, d: str) -> DataFrame:
    vectors, target = model.vectors(spark, d), _query_vector(spark, d)
    centroids = vector.train_lists(vectors, 16)
    indexed = vector.assign_lists(vectors, centroids)
    one = F.lit(7).alias("query_id")
    return vector.recall(vector.probe(indexed, centroids, target, 10, 8).select(one, "id"), vector.nearest(vectors, target, 10).select(one, "id"))


@query("range_query_steps", f"""WITH t AS (SELECT 1704067200000 + unnest(range(0, 60)) * {DAY} AS step_ms)
SELECT series_key, step_ms, arg_max(value, (ts_ms, value)) AS value FROM ev JOIN t ON ts_ms <= step_ms AND ts_ms >= step_ms - {3 * DAY} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return series.steps(model.events(spark, d), 1704067200000, 1704067200000 + 59 * DAY, DAY, 3 * DAY).select("series_key", "step_ms", "value")


# Element-wise functions, over account balances (some below zero)

_SCALAR: dict[str, tuple[Callable[[Column], Column], str]] = {
    "abs": (F.abs, "abs(x)"),
    "ceil": (scalar.ceil, "CAST(ceil(x) AS DOUBLE)"),
    "floor": (scalar.floor, "CAST(floor(x) AS DOUBLE)"),
    "round_even": (lambda x: scalar.round_even(x, 1), "round_even(x / 10, 0) * 10"),
    "sqrt": (scalar.sqrt, "round(sqrt(greatest(x, 0)), 6)"),
    "exp": (lambda x: F.exp(x / 100), "round(exp(x / 100), 6)"),
    "ln": (scalar.ln, "CASE WHEN x > 0 THEN round(ln(x), 6) ELSE CAST('nan' AS DOUBLE) END"),
    "log2": (scalar.log2, "CASE WHEN x > 0 THEN round(log2(x), 6) ELSE CAST('nan' AS DOUBLE) END"),
    "log10": (scalar.log10, "CASE WHEN x > 0 THEN round(log10(x), 6) ELSE CAST('nan' AS DOUBLE) END"),
    "clamp_max": (lambda x: scalar.clamp_max(x, 5000), "least(x, 5000)"),
    "clamp_min": (lambda x: scalar.clamp_min(x, 0), "greatest(x, 0)"),
}
for _name, (_f, _expr) in _SCALAR.items():

    @query(f"value_{_name}", f"SELECT c_custkey, {_expr} AS value FROM (SELECT c_custkey, c_acctbal AS x FROM customer)")
    def _(spark: SparkSession, d: str, name: str = _name, f: Callable[[Column], Column] = _f) -> DataFrame:
        out = f(F.col("c_acctbal"))
        return model.table(spark, d, "customer").select("c_custkey", (r(out) if name in ("sqrt", "exp", "ln", "log2", "log10") else out).alias("value"))


# Aggregation across series

for _how, _agg in {**_SQL_AGG, "stdvar": "var_pop(value)", "quantile": "quantile_cont(value, 0.9)"}.items():

    _digits = 6 if _how == "stddev" else 9

    @query(f"{_how}_by", f"WITH h AS (SELECT event_type, ts_ms // {DAY} * {DAY} AS ts_ms, value FROM ev) SELECT event_type, ts_ms, round({_agg}, {_digits}) AS value FROM h GROUP BY ALL")
    def _(spark: SparkSession, d: str, how: str = _how, digits: int = _digits) -> DataFrame:
        aligned = model.events(spark, d).withColumn("ts_ms", series.bucket(DAY))
        return aggregate.aggregate(aligned, how, ["event_type"], 0.9).select("event_type", "ts_ms", r("value", digits).alias("value"))


@query("sum_by_missing_label", f"WITH h AS (SELECT ts_ms // {DAY} * {DAY} AS ts_ms, value FROM ev) SELECT '__total' AS region, ts_ms, round(sum(value), 4) AS value FROM h GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    aligned = model.events(spark, d).withColumn("ts_ms", series.bucket(DAY))
    return aggregate.aggregate(aligned, "sum", ["region"]).select("region", "ts_ms", r("value", 4).alias("value"))


@query("sum_without", f"""WITH h AS (SELECT event_type, ts_ms // {DAY} * {DAY} AS ts_ms, value FROM ev)
SELECT 'events{{event_type="' || event_type || '"}}' AS series_key, ts_ms, round(sum(value), 4) AS value FROM h GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    aligned = model.events(spark, d).withColumn("ts_ms", series.bucket(DAY))
    return points(aggregate.aggregate_without(aligned, "sum", ["user_id"]), 4)


@query("library_stddev", "SELECT series_key, CASE WHEN count(*) > 1 THEN round(stddev_pop(value), 6) ELSE CAST('nan' AS DOUBLE) END AS value FROM ev GROUP BY series_key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.library_stat(model.events(spark, d), "stddev", ["series_key"]).select("series_key", r("value").alias("value"))


_LAST = "SELECT series_key, event_type, max(ts_ms) AS ts_ms, arg_max(value, (ts_ms, value)) AS value FROM ev GROUP BY ALL"
for _name, _order in (("topk", "DESC"), ("bottomk", "ASC")):

    @query(_name, f"WITH l AS ({_LAST}) SELECT CAST(row_number() OVER (ORDER BY value {_order}, series_key) AS INT) AS rank, series_key, ts_ms, value FROM l QUALIFY rank <= 5")
    def _(spark: SparkSession, d: str, largest: bool = _name == "topk") -> DataFrame:
        return aggregate.top(model.events(spark, d), 5, largest)

    @query(f"{_name}_by", f"WITH l AS ({_LAST}) SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value {_order}, series_key) AS INT) AS rank, series_key, ts_ms, value FROM l QUALIFY rank <= 3")
    def _(spark: SparkSession, d: str, largest: bool = _name == "topk") -> DataFrame:
        return aggregate.top_by(model.events(spark, d), 3, "event_type", largest)


@query("count_values", "SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = model.table(spark, d, "lineitem")
    items = rows.select(F.create_map(F.lit("l_returnflag"), F.col("l_returnflag")).alias("labels"), F.col("l_quantity").alias("value"))
    return aggregate.count_values(items, ["l_returnflag"])


# Arithmetic


@query("binop_vector_scalar", "SELECT series_key, ts_ms, round(value * 2 / 3 - 1, 6) AS value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.with_number(aggregate.with_number(model.events(spark, d), "*", 2), "/", 3)
    return points(aggregate.with_number(out, "-", 1))


_DAILY = f"WITH h AS (SELECT event_type, user_id, ts_ms // {DAY} * {DAY} AS ts_ms, sum(value) AS value FROM ev GROUP BY ALL)"


def _daily(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    aligned = model.events(spark, d).withColumn("ts_ms", series.bucket(DAY))
    out = aggregate.aggregate(aligned, "sum", list(labels))
    pairs = [x for n in labels for x in (F.lit(n), F.col(n))]
    return out.select(F.lit("daily").alias("metric"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"), "ts_ms", "value").withColumn("series_key", model.series_key("metric", "labels"))


@query("binop_vector_vector", _DAILY + """, a AS (SELECT * FROM h WHERE event_type = 'click'), b AS (SELECT * FROM h WHERE event_type = 'view')
SELECT '{user_id="' || a.user_id || '"}' AS sig, a.ts_ms AS ts_ms, round(CASE WHEN b.value <> 0 THEN a.value / b.value ELSE CAST('nan' AS DOUBLE) END, 10) AS value FROM a JOIN b ON a.user_id = b.user_id AND a.ts_ms = b.ts_ms""")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = _daily(spark, d, "event_type", "user_id")
    a, b = (h.where(matchers.matcher("event_type", "=", x)) for x in ("click", "view"))
    return aggregate.match(a, b, "/", on=["user_id"]).select("sig", "ts_ms", r("value", 10).alias("value"))


@query("binop_group_left", _DAILY + """, t AS (SELECT ts_ms, event_type, sum(value) AS total FROM h GROUP BY ALL)
SELECT 'daily{event_type="' || event_type || '",user_id="' || user_id || '"}' AS series_key, ts_ms, round(CASE WHEN total <> 0 THEN value / total ELSE CAST('nan' AS DOUBLE) END / 7, 10) AS value FROM h JOIN t USING (ts_ms, event_type)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    shares = aggregate.match(_daily(spark, d, "event_type", "user_id"), _daily(spark, d, "event_type"), "/", on=["event_type"], many=True)
    return points(aggregate.with_number(shares, "/", 7), 10)


@query("comparison_filter", "SELECT series_key, ts_ms, value FROM ev WHERE value > 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.compare_number(model.events(spark, d), ">", 50).select("series_key", "ts_ms", "value")


@query("comparison_bool", "SELECT series_key, ts_ms, CAST(CAST(value <= 10 AS INT) AS DOUBLE) AS value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.compare_number(model.events(spark, d), "<=", 10, True).select("series_key", "ts_ms", "value")


for _op, _sql in (("and", "IN"), ("unless", "NOT IN")):

    @query(f"set_{_op}", _DAILY + f" SELECT user_id, ts_ms, round(value, 4) AS value FROM h WHERE event_type = 'click' AND (user_id, ts_ms) {_sql} (SELECT (user_id, ts_ms) FROM h WHERE event_type = 'view')")
    def _(spark: SparkSession, d: str, op: str = _op) -> DataFrame:
        h = _daily(spark, d, "event_type", "user_id")
        a, b = (h.where(matchers.matcher("event_type", "=", x)) for x in ("click", "view"))
        return aggregate.set_operation(a, b, op, on=["user_id"]).select(F.col("labels")["user_id"].alias("user_id"), "ts_ms", r("value", 4).alias("value"))


@query("error_ratio_pct", f"""WITH h AS (SELECT event_type, ts_ms // {DAY} * {DAY} AS ts_ms, value FROM ev), t AS (SELECT ts_ms, sum(value) AS v FROM h GROUP BY ALL), e AS (SELECT ts_ms, sum(value) AS v FROM h WHERE event_type = 'error' GROUP BY ALL)
SELECT ts_ms, round(CASE WHEN t.v <> 0 THEN e.v / t.v ELSE CAST('nan' AS DOUBLE) END * 100, 6) AS value FROM e JOIN t USING (ts_ms)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    errors = _daily(spark, d, "event_type").where(matchers.matcher("event_type", "=", "error"))
    ratio = aggregate.match(errors, _daily(spark, d), "/", on=[])
    return aggregate.with_number(ratio, "*", 100).select("ts_ms", r("value").alias("value"))


# Histograms

_BOUNDS = [1000.0, 5000.0, 10000.0, 20000.0, 30000.0, 40000.0, 60000.0, 80000.0, 120000.0]
_BUCKETS = f"WITH b AS (SELECT l_returnflag, le, CAST(sum(CASE WHEN l_extendedprice <= le THEN 1 ELSE 0 END) AS DOUBLE) AS c FROM lineitem, (SELECT unnest({_BOUNDS}) AS le) GROUP BY ALL)"


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return histogram.histogram(model.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", _BOUNDS)


@query("histogram_buckets", _BUCKETS + " SELECT l_returnflag, CAST(le AS DOUBLE) AS le, c AS cumulative FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(spark, d)


@query("histogram_quantile", _BUCKETS + """, p AS (SELECT *, coalesce(lag(c) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0) AS lo, max(c) OVER (PARTITION BY l_returnflag) AS total FROM b WINDOW w AS (PARTITION BY l_returnflag ORDER BY le))
SELECT l_returnflag, CAST(round(lo + (le - lo) * (0.9 * total - before) / (c - before), 6) AS DOUBLE) AS value FROM p WHERE c >= 0.9 * total QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY le) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return histogram.quantile(_buckets(spark, d), ["l_returnflag"], 0.9).withColumn("value", r("value"))


@query("histogram_fraction", _BUCKETS + " SELECT l_returnflag, round((max(CASE WHEN le <= 40000 THEN c END) - max(CASE WHEN le <= 10000 THEN c END)) / max(c), 6) AS value FROM b GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return histogram.fraction(_buckets(spark, d), ["l_returnflag"], 10000, 40000).withColumn("value", r("value"))


# Retention, tiers

_POLICIES = [("ev", 40 * 86400, "raw"), ("events", 20 * 86400, "1h"), ("orders", 9000 * 86400, "1d"), ("Customer", 86400, "raw"), ("Customer#0000001", 2 * 86400, "5m")]


@query("retention_cleanup", f"SELECT series_key, ts_ms, value FROM ev WHERE ts_ms >= {NOW - 20 * DAY}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cleanup(model.events(spark, d), lifecycle.policies(spark, _POLICIES), NOW).select("series_key", "ts_ms", "value")


@query("policy_lookup", "SELECT DISTINCT c_name AS name, CASE WHEN starts_with(c_name, 'Customer') THEN 'Customer' ELSE 'default' END AS namespace, CAST(CASE WHEN starts_with(c_name, 'Customer') THEN 86400 ELSE 1296000 END AS BIGINT) AS seconds, 'raw' AS resolution FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.policy_of(model.table(spark, d, "customer").select(F.col("c_name").alias("name")), lifecycle.policies(spark, _POLICIES))


_TIER = f"SELECT series_key, max(ts_ms) AS end_ms, count(*) AS n, CASE WHEN max(ts_ms) >= {NOW - 3 * DAY} THEN 'hot' WHEN max(ts_ms) >= {NOW - 10 * DAY} THEN 'warm' ELSE 'cold' END AS tier FROM ev GROUP BY series_key"


@query("tiering", _TIER)
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.tiers(model.events(spark, d), NOW, 3 * DAY, 10 * DAY)


@query("tier_stats", f"WITH t AS ({_TIER}) SELECT tier, count(*) AS series, CAST(sum(n) AS BIGINT) AS points FROM t GROUP BY tier")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.tier_stats(lifecycle.tiers(model.events(spark, d), NOW, 3 * DAY, 10 * DAY))


@query("downsample_by_policy", f"SELECT status, priority, ts_ms - ts_ms % {7 * DAY} AS ts_ms, round(avg(value), 7) AS value FROM od GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    down = lifecycle.at_resolution(model.orders(spark, d), "1w")
    return down.select(F.col("labels")["status"].alias("status"), F.col("labels")["priority"].alias("priority"), "ts_ms", r("value", 7).alias("value"))


# Vectors


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return model.table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


_DISTANCE = {"l2": "list_distance(vec.v, q.v)", "cosine": "list_cosine_distance(vec.v, q.v)", "dot": "-list_inner_product(vec.v, q.v)"}
for _metric, _expr in _DISTANCE.items():

    @query(f"knn_{_metric}", f"SELECT id, round({_expr}, 6) AS distance FROM vec, q ORDER BY {_expr}, id LIMIT 10")
    def _(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        return vector.nearest(model.vectors(spark, d), _query_vector(spark, d), 10, metric).select("id", r("distance").alias("distance"))


@query("knn_filtered", "SELECT id, round(list_distance(vec.v, q.v), 6) AS distance, round(1 / (1 + list_distance(vec.v, q.v)), 6) AS score FROM vec, q WHERE label = 3 ORDER BY list_distance(vec.v, q.v), id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = vector.nearest(model.vectors(spark, d), _query_vector(spark, d), 10, where=matchers.matcher("label", "=", "3"))
    return found.select("id", r("distance").alias("distance"), r("score").alias("score"))


@query("vector_math", "SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: abs(x / sqrt(list_inner_product(v, v))))), 5) AS l1 FROM vec")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    l1 = F.aggregate(vector.normalize(v), F.lit(0.0), lambda s, x: s + F.abs(x))
    return model.vectors(spark, d).select("id", r(vector.norm(v)).alias("norm"), r(l1, 5).alias("l1"))


_T0, _T1 = 1704067200000, 1704067200000 + 300 * 60000
_HYBRID = f"""WITH t AS (SELECT id, ts_ms, 1 - abs(0.5 - (ts_ms - {_T0}) / CAST({_T1 - _T0} AS DOUBLE)) AS s FROM vec WHERE ts_ms BETWEEN {_T0} AND {_T1}),
n AS (SELECT id, list_distance(vec.v, q.v) AS distance FROM vec, q ORDER BY 2, 1 LIMIT 200)
SELECT coalesce(t.id, n.id) AS id, t.ts_ms AS ts_ms, round(distance, 6) AS distance, round(0.5 * coalesce(s, 0) + 0.5 * coalesce(1 / (1 + distance), 0), 6) AS score
FROM t FULL JOIN n ON t.id = n.id ORDER BY 0.5 * coalesce(s, 0) + 0.5 * coalesce(1 / (1 + distance), 0) DESC, 1 LIMIT 25"""


@query("hybrid_search", _HYBRID)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.search(model.vectors(spark, d), _query_vector(spark, d), _T0, _T1, k=25)
    return found.select("id", "ts_ms", r("distance").alias("distance"), r("score").alias("score"))


@query("time_range_query", "SELECT series_key, ts_ms, value FROM ev WHERE event_type = 'view' AND ts_ms BETWEEN 1704067200000 AND 1709251200000 ORDER BY ALL LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.time_range(model.events(spark, d), "events", {"event_type": "view"}, 1704067200000, 1709251200000, 50)


for _how, _agg in {**{k: v for k, v in _SQL_AGG.items() if k != "stddev"}, "last": "arg_max(value, (ts_ms, value))"}.items():

    @query(f"hybrid_{_how}", f"SELECT round({_agg}, 8) AS value FROM ev WHERE event_type = 'view' AND ts_ms BETWEEN 1704067200000 AND 1709251200000")
    def _(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return hybrid.aggregate(model.events(spark, d), "events", {"event_type": "view"}, 1704067200000, 1709251200000, how).select(r("value", 8).alias("value"))


_CENTRES = "WITH c AS (SELECT CAST(vec_id AS INT) AS list_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id < 16)"
_ASSIGN = _CENTRES + ", a AS (SELECT id, vec.v AS v, list_id FROM vec, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(vec.v, c.c), list_id) = 1)"


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "embeddings").where("vec_id < 16").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").cast("array<double>").alias("centroid"))


@query("ivf_assign_fixed", _ASSIGN + " SELECT id, list_id FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return vector.assign_lists(model.vectors(spark, d), _centroids(spark, d)).select("id", "list_id")


@query("ivf_list_sizes", _ASSIGN + " SELECT list_id, count(*) AS n FROM a GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return vector.list_sizes(vector.assign_lists(model.vectors(spark, d), _centroids(spark, d)))


@query("ivf_probe_fixed", _ASSIGN + ", l AS (SELECT list_id FROM c, q ORDER BY list_distance(c.c, q.v), list_id LIMIT 4) SELECT id, round(list_distance(a.v, q.v), 6) AS distance FROM a, q WHERE list_id IN (SELECT list_id FROM l) ORDER BY list_distance(a.v, q.v), id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    centroids = _centroids(spark, d)
    found = vector.probe(vector.assign_lists(model.vectors(spark, d), centroids), centroids, _query_vector(spark, d), 10, 4)
    return found.select("id", r("distance").alias("distance"))


@query("pq_encode_fixed", """WITH w AS (SELECT s AS sub, CAST(vec_id AS INT) AS code, CAST(embedding AS DOUBLE[])[s * 16 + 1:s * 16 + 16] AS w FROM embeddings, (SELECT unnest(range(4)) AS s) WHERE vec_id < 8),
n AS (SELECT id, sub, code FROM vec, w QUALIFY row_number() OVER (PARTITION BY id, sub ORDER BY list_distance(vec.v[sub * 16 + 1:sub * 16 + 16], w), code) = 1)
SELECT id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY sub) AS codes FROM n GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = model.table(spark, d, "embeddings").where("vec_id < 8").select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = F.array(*[F.struct(F.lit(i).alias("sub"), p.alias("word")) for i, p in enumerate(vector.subvectors(4, 64))])
    book = words.select("code", F.inline(parts)).select("sub", "code", "word")
    return vector.encode(model.vectors(spark, d), book, 4, 64).select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("ivf_trained")
def _(spark: SparkSession, d: str) -> DataFrame:
    vectors, target = model.vectors(spark, d), _query_vector(spark, d)
    centroids = vector.train_lists(vectors, 16)
    return vector.probe(vector.assign_lists(vectors, centroids), centroids, target, 10, 8).select("id", "distance")


@query("pq_trained")
def _(spark: SparkSession, d: str) -> DataFrame:
    vectors = model.vectors(spark, d)
    book = vector.train_codebook(vectors, 4, 16, 64)
    decoded = vector.decode(vector.encode(vectors, book, 4, 64), book, 4)
    return decoded.agg(F.avg(vector.distance(F.col("embedding"), F.col("decoded"))).alias("error"), F.avg(vector.norm(F.col("embedding"))).alias("norm"))


@query("anomaly_interval_join", f"""WITH s AS (SELECT event_type, ts_ms, value, avg(value) OVER w + 2 * stddev_pop(value) OVER w AS l FROM ev WINDOW w AS (PARTITION BY event_type)), p AS (SELECT * FROM s WHERE value > l)
SELECT event_type, p.ts_ms AS ts_ms, p.value AS value, id, vec.ts_ms AS vector_ms FROM p JOIN vec ON vec.ts_ms BETWEEN p.ts_ms - {HOUR} AND p.ts_ms + {HOUR}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    by_type = model.events(spark, d).select(F.col("labels")["event_type"].alias("series_key"), "ts_ms", "value")
    return vector.nearest_in_time(vector.peaks(by_type, 2), model.vectors(spark, d), HOUR).select(F.col("series_key").alias("event_type"), "ts_ms", "value", "id", "vector_ms")


# Placement

_HASH = "CAST(concat('0x', substr(md5(c_name), 1, 8)) AS BIGINT)"
_NODES = ["node1", "node2", "node3", "node4", "node5"]
_RING = f"WITH n AS (SELECT unnest({_NODES}) AS node), ring AS (SELECT CAST(concat('0x', substr(md5(node || ':' || i), 1, 8)) AS BIGINT) AS h, node FROM n, (SELECT unnest(range(150)) AS i)), k AS (SELECT c_name, {_HASH} AS kh FROM customer)"


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "customer").select("c_name", placement.key_hash(F.col("c_name")).alias("h"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Each name once, as the rings' SQL groups by it; the shuffle also deals a table of few row groups to all tasks."""
    return model.table(spark, d, "customer").select("c_name").distinct().select("c_name", placement.key_hash(F.col("c_name")).alias("h"))


@query("shard_mod", f"SELECT c_name, 'shard_' || lpad(CAST({_HASH} % 256 AS VARCHAR), 4, '0') AS shard FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("c_name", placement.shard_by_hash(F.col("h")).alias("shard"))


@query("shard_range", f"SELECT c_name, 'shard_' || lpad(CAST({_HASH} // (4294967296 // 10) % 10 AS VARCHAR), 4, '0') AS shard FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("c_name", placement.shard_by_range(F.col("h"), 10).alias("shard"))


@query("shard_key", "SELECT DISTINCT 'events|event_type=' || event_type || '|user_id=' || user_id AS shard_key FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return model.events(spark, d).select(placement.shard_key().alias("shard_key")).distinct()


@query("round_robin", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) % 7 AS INT) AS shard FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.round_robin(model.table(spark, d, "customer").select("c_custkey"), 7, "c_custkey")


@query("ring_owner", _RING + " SELECT c_name, coalesce(arg_min(node, (h, node)) FILTER (h > kh), arg_min(node, (h, node))) AS node FROM k, ring GROUP BY c_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("c_name", placement.owner(F.col("h"), placement.ring(_NODES)).alias("node"))


@query("ring_replicas", _RING + ", o AS (SELECT c_name, node, min(CASE WHEN h > kh THEN h ELSE h + 4294967296 END) AS p FROM k, ring GROUP BY ALL) SELECT c_name, string_agg(node, ',' ORDER BY p) AS nodes FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY p) <= 3) GROUP BY c_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("c_name", F.array_join(placement.owners(F.col("h"), placement.ring(_NODES), 3), ",").alias("nodes"))


@query("ring_positions", _RING + ", p AS (SELECT c_name, i AS replica, (kh + i * 1000) % 4294967296 AS kh FROM k, (SELECT CAST(unnest(range(3)) AS INT) AS i)) SELECT c_name, replica, coalesce(arg_min(node, (h, node)) FILTER (h > kh), arg_min(node, (h, node))) AS node FROM p, ring GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.replica_positions(_keys(spark, d), F.col("h"), placement.ring(_NODES), 3).select("c_name", "replica", "node")


@query("ring_balance", _RING + ", o AS (SELECT c_name, coalesce(arg_min(node, (h, node)) FILTER (h >= kh), arg_min(node, (h, node))) AS node FROM k, ring GROUP BY c_name) SELECT node, count(*) AS n FROM o GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.balance(_keys(spark, d).withColumn("node", placement.owner(F.col("h"), placement.ring(_NODES), inclusive=True)))


# Streams, over the events written as files of samples


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = scratch(spark, "samples")
    model.events(spark, d).select("metric", "labels", "series_key", "ts_ms", "value").repartitionByRange(4, "ts_ms").sortWithinPartitions("ts_ms").write.parquet(path)
    return ingest.source(spark, path, storage.SCHEMA, files=4), path


@query("stream_downsample", f"SELECT series_key, ts_ms // {HOUR} * {HOUR} AS ts_ms, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM ev GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    stream, _ = _stream(spark, d)
    return ingest.downsample_all(stream, scratch(spark, "down")).withColumn("total", r("total", 4))


@query("stream_rate", f"WITH s AS ({_STEP}) SELECT series_key, ts_ms, round(greatest(dv / (dt / 1000.0), 0), 6) AS value FROM s WHERE dt > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    stream, _ = _stream(spark, d)
    return points(ingest.drain(ingest.rate(stream), scratch(spark, "rate"), scratch(spark, "checkpoint")))


@query("stream_ingest", "SELECT series_key, ts_ms, value FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    stream, _ = _stream(spark, d)
    path = scratch(spark, "ingested")
    ingest.ingest(stream, path, scratch(spark, "checkpoint")).awaitTermination()
    return storage.load(spark, path).select("series_key", "ts_ms", "value")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
