"""Hand-computed cases: counter resets, repeated times, missing labels, NaN, bounds."""

import math

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import histogram, matchers, scalar, series
from seriesloom.operators import aggregate, hybrid, lifecycle, placement, vector
from seriesloom.sources import model, storage

P = [(0, 0.0), (1000, 10.0), (3000, 5.0), (3000, 7.0)]


def frame(spark, points, labels=None):
    rows = [("m", labels or {"a": "x"}, t, v) for t, v in points]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    return df.withColumn("series_key", model.series_key("metric", "labels"))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("ts_ms", "value"))).collect())


@pytest.mark.parametrize(
    "f, expected",
    [
        (series.rate, [(1000, 10.0), (3000, 0.0)]),
        (series.irate, [(3000, 0.0)]),
        (series.increase, [(3000, 7.0)]),
        (lambda x: series.increase_points(x, 60_000), [(1000, 600.0), (3000, -150.0)]),
        (series.delta, [(1000, 10.0), (3000, 5.0), (3000, 7.0)]),
        (series.idelta, [(1000, 10.0), (3000, -5.0), (3000, 2.0)]),
    ],
)
def test_rate_family(spark, f, expected):
    assert got(f(frame(spark, P))) == expected


def test_sliding(spark):
    out = series.over_time_points(frame(spark, P), 2000, "avg", "count", "stddev")
    assert [(r["avg"], r["count"], r["stddev"]) for r in out.orderBy("ts_ms", "value").collect()][:2] == [(0.0, 1.0, None), (5.0, 2.0, 5.0)]


def test_downsample(spark):
    out = series.downsample(frame(spark, P), 2000, "avg", "first", "last")
    assert got(out, "ts_ms", "avg", "first", "last") == [(0, 5.0, 0.0, 10.0), (2000, 6.0, 5.0, 7.0)]


def test_predict(spark):
    assert got(series.predict_linear(frame(spark, [(0, 1.0), (1000, 3.0)]), 2)) == [(1000, 7.0)]
    assert got(series.predict_linear(frame(spark, [(5, 4.0)]), 2)) == [(5, 4.0)]
    assert got(series.predict_linear(frame(spark, []), 2)) == []


def test_histogram(spark):
    b = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 20.0), ("g", 5.0, 30.0), ("z", 1.0, 0.0)], "g string, le double, cumulative double")
    for q, expected in ((0.5, 1.5), (0.9, 4.1), (0.1, 0.3)):
        values = dict(got(histogram.quantile(b, ["g"], q), "g", "value"))
        assert values["g"] == pytest.approx(expected) and math.isnan(values["z"])
    values = dict(got(histogram.fraction(b, ["g"], 1, 5), "g", "value"))
    assert values["g"] == pytest.approx(2 / 3) and math.isnan(values["z"])


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-4.0,), (0.0,), (float("nan"),)], "x double")
    x = F.col("x")
    out = df.select(scalar.round_even(x), scalar.sqrt(x), scalar.ln(x), scalar.clamp_min(x, 0), scalar.divide(x, F.lit(0.0)), scalar.modulo(x, F.lit(0.0))).collect()
    assert [r[0] for r in out[:2]] == [2.0, 4.0]
    assert out[2][1] == 0.0 and math.isnan(out[2][2]) and out[2][3] == 0.0 and out[2][4] == -math.inf
    assert math.isnan(out[3][2]) and math.isnan(out[3][4]) and math.isnan(out[4][1]) and math.isnan(out[0][5])
    assert spark.range(1).select(scalar.round_even(F.lit(25.0), 1)).first()[0] == 20.0


def test_matchers(spark):
    df = spark.createDataFrame([({"status": "200"},), ({"status": "404"},), ({"other": "x"},)], "labels map<string,string>")
    for op, value, expected in (("=~", "2", [True, False, False]), ("!=", "200", [False, True, True]), ("!~", "2", [False, True, False]), ("=", "404", [False, True, False])):
        assert [r[0] for r in df.select(matchers.matcher("status", op, value)).collect()] == expected
    assert [r[0] for r in df.select(matchers.selector({"status": "*"})).collect()] == [True, True, False]
    with pytest.raises(Exception):
        matchers.matcher("a", "=~", "(")


def test_groups(spark):
    df = frame(spark, [(0, 1.0)]).unionByName(frame(spark, [(0, 2.0)], {"b": "y"}))
    assert got(aggregate.aggregate(df, "sum", ["a"]), "a", "value") == [("__total", 2.0), ("x", 1.0)]
    assert got(aggregate.aggregate(df, "stddev"), "value") == [(0.5,)]
    assert math.isnan(aggregate.library_stat(df.limit(1), "stddev", ["series_key"]).first()["value"])


def test_match_refuses_several(spark):
    one = frame(spark, [(0, 1.0)])
    two = one.unionByName(frame(spark, [(0, 2.0)], {"a": "x", "b": "y"}))
    with pytest.raises(Exception, match="several series"):
        aggregate.match(one, two, "+", on=["a"]).collect()
    assert got(aggregate.match(two, one, "+", on=["a"], many=True)) == [(0, 2.0), (0, 3.0)]
    assert got(aggregate.set_operation(two, one, "or", on=["b"])) == [(0, 1.0), (0, 2.0)]


def test_vectors(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(vector.distance(z, a, "cosine"), vector.distance(z, a), vector.distance(a, a, "dot"), vector.score(F.lit(0.0)), vector.score(F.lit(1.0)), vector.normalize(z)).first()
    assert list(row) == [1.0, 1.0, -1.0, 1.0, 0.5, [0.0, 0.0]]
    times = spark.createDataFrame([(0,), (50,), (100,)], "ts_ms long").select(hybrid.time_score(0, 100))
    assert [r[0] for r in times.collect()] == [0.5, 1.0, 0.5]
    assert (vector.choose_index(10, 64, 0), vector.choose_index(10**6, 64, 10**9), vector.choose_index(10**9, 64, 10**9)) == ("exact", "lists", "quantized")


def test_placement(spark):
    row = spark.range(1).select(placement.key_hash(F.lit("node1:0")), placement.shard_by_hash(placement.key_hash(F.lit("node1:0")))).first()
    assert list(row) == [1604196320, "shard_0224"]
    assert placement.shards_in(0, 2**32 // 4, 4) == [0, 1]


def test_ring_lookup_is_a_search(spark):
    """Every place and both sides of it, nulls, nodes with quotes; the plan holds no filter over all places."""
    places = placement.ring(["a", 'b"c', "d"], 20)
    keys = sorted({k for p, _ in places for k in (p - 1, p, p + 1)} | {0, 2**32 - 1}) + [None]
    df = spark.createDataFrame([(k,) for k in keys], "h long")
    columns = [placement.owner(F.col("h"), places), placement.owner(F.col("h"), places, inclusive=True), placement.owners(F.col("h"), places, 2), placement.owners(F.col("h"), places, 9)]
    out = df.select("h", *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "from_json" not in plan

    def by_hand(k, n, inclusive=False):
        later = [x for p, x in places if p > k or (inclusive and p == k)] if k is not None else []
        return list(dict.fromkeys(later + [x for _, x in places]))[:n]

    for k, after, at, two, all_ in out.collect():
        assert (after, at, two, all_) == (by_hand(k, 1)[0], by_hand(k, 1, True)[0], by_hand(k, 2), by_hand(k, 9))


@pytest.mark.parametrize("name", ["ring_owner", "ring_replicas", "ring_positions", "ring_balance"])
def test_rings_group_names(spark, tmp_path, name):
    """Names that repeat, as in the SQL."""
    import duckdb

    from seriesloom.plans import queries
    from tests.duck import rows, spark_rows

    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "c_name string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    sql = queries.oracle_sql()[name].removeprefix(queries.COMMON + ",")  # which reads other tables
    found = con.sql(f"WITH {sql}")
    assert spark_rows(queries.queries()[name](spark, str(tmp_path))) == (sorted(found.columns), rows(found.columns, found.fetchall()))


def test_policies(spark):
    rules = lifecycle.policies(spark, [("http", 10, "raw"), ("http_req", 20, "raw"), ("exact", 30, "1h")])
    names = spark.createDataFrame([("http_requests",), ("http_req",), ("other",)], "name string")
    assert got(lifecycle.policy_of(names, rules), "name", "namespace") == [("http_req", "http_req"), ("http_requests", "http"), ("other", "default")]
    kept = lifecycle.cleanup(frame(spark, [(89_999, 1.0), (90_000, 2.0)]), lifecycle.policies(spark, [("m", 10, "raw")]), 100_000)
    assert got(kept) == [(90_000, 2.0)]
    assert not lifecycle.should_downsample("raw", 10**9) and lifecycle.should_downsample("5m", 300_001)
    with pytest.raises(ValueError):
        lifecycle.policies(spark, [("a", 1, "2h")])


def test_tiers(spark):
    now = 3 * 86_400_000
    ages = {"hot": 1_800_000, "warm": 7_200_000, "cold": 2 * 86_400_000}
    df = frame(spark, [(now - ages["hot"], 1.0)], {"t": "hot"})
    for t in ("warm", "cold"):
        df = df.unionByName(frame(spark, [(now - ages[t], 1.0)], {"t": t}))
    assert got(lifecycle.tiers(df, now), "series_key", "tier") == [(f'm{{t="{t}"}}', t) for t in ("cold", "hot", "warm")]


def test_storage(spark, tmp_path):
    df = frame(spark, P).unionByName(frame(spark, [(-1, 1.0)])).unionByName(frame(spark, [(5, 1.0)], {"a": ""}))
    path = str(tmp_path / "db")
    storage.write(df, path)
    storage.write(frame(spark, [(86_400_000, 3.0)], {"a": "y"}), path)
    back = storage.load(spark, path)
    assert got(storage.read(back, "m", end_ms=86_399_999)) == P
    assert got(storage.read(back, "m", limit=1)) == P
    assert storage.drop_metric(spark, path, "m", {"a": "y"}, str(tmp_path / "next")) == 1
    assert got(storage.load(spark, str(tmp_path / "next"))) == P
    line = storage.exposition(frame(spark, [(1, 2.0)], {"a": 'q"\\'})).first()[0]
    assert line == 'm{a="q\\"\\\\"} 2.000000 1'
    assert model.relabel(frame(spark, [(1, 2.0)]), {"a": "z"}).first()["series_key"] == 'm{a="z"}'


def test_streaming_watermark(spark, tmp_path):
    from seriesloom.streaming import ingest

    hour = 3_600_000
    for i, points in enumerate([[(0, 1.0), (10, 2.0)], [(5 * hour, 3.0)], [(1, 9.0), (9 * hour, 4.0)]]):
        frame(spark, points).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), storage.SCHEMA)
    out = ingest.drain(ingest.downsample(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    first = out.where("ts_ms = 0").collect()
    assert len(first) == 1 and first[0]["n"] in (2, 3)
    rates = ingest.drain(ingest.rate(stream), str(tmp_path / "rates"), str(tmp_path / "log2"))
    assert rates.where("value < 0").count() == 0 and rates.count() >= 2


def test_streaming_rate_in_buckets(spark, tmp_path):
    """Three micro-batches of 300 series against the rule by hand: late, repeated and falling samples; NaN counts as no change."""
    import random

    from seriesloom.streaming import ingest

    draw, last, expected = random.Random(5), {}, []
    for _ in range(3):
        rows = [(f"s{draw.randrange(300)}", draw.randrange(40) * 500, draw.choice([1.0, 2.5, 9.0, float("nan")])) for _ in range(700)]
        for key, ts, value in sorted(rows, key=lambda r: (r[1], math.isnan(r[2]), r[2])):
            before = last.get(key)
            if before and ts > before[0]:
                expected.append((key, ts, max(0.0, (value - before[1]) / ((ts - before[0]) / 1000.0))))
            if not before or ts >= before[0]:
                last[key] = ts, value
        spark.createDataFrame([("m", {}, *r) for r in rows], storage.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), storage.SCHEMA)
    run = ingest.rate(stream, 16).writeStream.option("checkpointLocation", str(tmp_path / "log")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out")), "series_key", "ts_ms", "value") == sorted(expected)
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16 and len(run.recentProgress) >= 3


def test_gap_scores(spark):
    out = got(series.gap_scores(frame(spark, [(0, 1.0), (10, 1.0), (20, 1.0), (50, 1.0)])))
    assert out == [(20, 0.0), (50, 20.0)]


def test_offset(spark):
    assert got(series.offset(frame(spark, [(0, 1.0)]), 5)) == [(5, 1.0)]
