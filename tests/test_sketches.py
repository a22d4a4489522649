"""Stored sketches against exact figures, within their stated bounds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sketches as S

START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def readings(spark):
    """Thirty days of gauge readings; one gauge has a third of them."""
    draw = random.Random(5)
    rows = []
    for i in range(30_000):
        gauge = "harbour" if i % 3 == 0 else f"gauge {draw.randrange(20)}"
        level = None if i % 50 == 7 else draw.gauss(4 + i % 3, 2)
        rows.append((START + datetime.timedelta(minutes=draw.randrange(30 * 24 * 60)), gauge, level, draw.randrange(6000), i % 11 == 0))
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, gauge string, level double, serial int, manual boolean")
    return frame.withColumn("day", F.to_date("ts"))


def ranks(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def near(values, x, p):
    low, high = ranks(values, x)
    return low - S.RANK_ERROR <= p <= high + S.RANK_ERROR


def test_days_merge_into_a_month(spark, readings, tmp_path):
    path = str(tmp_path / "profiles")
    for half in ("day < '2024-03-16'", "day >= '2024-03-16'"):  # profiles are appended as days arrive
        S.profile_sketches(readings.filter(half), ["gauge", "level", "serial", "manual"], ["day"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 30 * 4
    month = {r["column_name"]: r for r in S.profile_estimates(S.merged_profiles(stored)).collect()}
    data = readings.collect()
    for c in ("gauge", "level", "serial", "manual"):
        values = [r[c] for r in data if r[c] is not None]
        got = month[c]
        assert (got["row_count"], got["null_count"]) == (len(data), len(data) - len(values))
        assert abs(got["unique_estimate"] - len(set(values))) <= S.DISTINCT_ERROR * len(set(values)) + 1
        if c in ("level", "serial"):
            assert got["minimum"] == min(values) and got["maximum"] == max(values) and got["mean"] == pytest.approx(sum(values) / len(values))
            assert all(near(values, got[name], p) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
        else:
            assert got["p50"] is None and got["minimum"] is None and got["mean"] is None


def test_one_scan_and_weeks_by_key(spark, readings):
    sketches = S.profile_sketches(readings, ["level"], ["gauge", "day"])
    plan = sketches._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    merged = S.merged_profiles(sketches.withColumn("week", F.weekofyear("day")), ["gauge", "week", "column_name"])
    exact = readings.groupBy("gauge", F.weekofyear("day").alias("week")).agg(F.count("level").alias("n"), F.countDistinct("level").alias("d"))
    for row in S.profile_estimates(merged).join(exact, ["gauge", "week"]).collect():
        assert row["value_count"] == row["n"] and abs(row["unique_estimate"] - row["d"]) <= S.DISTINCT_ERROR * row["d"] + 1


def test_windows_from_hourly_sketches(spark, readings):
    hours = S.value_sketches(readings, ["gauge"], "ts", "level")
    start, end = (F.lit(f"2024-03-{d} 00:00:00").cast("timestamp_ntz") for d in ("05", "12"))
    values = {}
    for r in readings.collect():
        if r["level"] is not None and datetime.datetime(2024, 3, 5) <= r["ts"] < datetime.datetime(2024, 3, 12):
            values.setdefault(r["gauge"], []).append(r["level"])
    got = S.window_percentiles(hours, ["gauge"], start, end).collect()
    assert {r["gauge"] for r in got} == set(values)
    for r in got:
        own = values[r["gauge"]]
        assert (r["value_count"], r["minimum"], r["maximum"]) == (len(own), min(own), max(own))
        assert all(near(own, r[name], p) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def test_sliding_windows(spark):
    rows = [("a", START + datetime.timedelta(hours=h), float(v)) for h, some in ((0, (1, 2)), (1, (10,)), (5, (100, 200, 300))) for v in some]
    frame = spark.createDataFrame([*rows, ("a", None, 5.0), ("b", START, None)], "k string, ts timestamp_ntz, v double")
    got = S.sliding_percentiles(S.value_sketches(frame, ["k"], "ts", "v"), ["k"], 3, [0.5]).orderBy("period").collect()
    assert [(r["period"].hour, r["value_count"], r["p50"]) for r in got] == [(0, 2, 1.0), (1, 3, 2.0), (5, 3, 200.0)]


def test_nulls_nan_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, float("nan")), (None, None), (None, -0.0), (None, 0.0)], "t string, v double")
    got = {r["column_name"]: r for r in S.profile_estimates(S.merged_profiles(S.profile_sketches(frame))).collect()}
    assert got["t"]["null_count"] == 4 and got["t"]["unique_estimate"] == 0
    assert got["v"]["value_count"] == 2 and got["v"]["p50"] == 0.0 and got["v"]["unique_estimate"] == 2  # 0.0 and NaN
    none = S.profile_estimates(S.merged_profiles(S.profile_sketches(frame.limit(0)))).collect()
    assert all(r["row_count"] == 0 and r["p50"] is None for r in none)
    assert S.window_percentiles(S.value_sketches(frame.limit(0).withColumn("ts", F.lit(START)), ["t"], "ts", "v"), ["t"]).collect() == []
