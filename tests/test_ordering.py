"""The ordered helpers against plain Python, on groups that hold a large share of the rows."""

import random
import statistics
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import ordering
from tidewatch.operators import profile


def skewed(seed, n=3000):
    """A third of the rows in one key, another third at one moment; NULL keys included."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", None])
        moment = 500 if rng.random() < 0.33 else rng.randrange(1000)
        rows.append((key, moment, i, rng.choice("xxxxy")))
    rng.shuffle(rows)
    return rows


SCHEMA = "k string, ts bigint, id bigint, v string"


@pytest.mark.parametrize("seed", [1, 2])
def test_row_numbers(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {
        r.id: r.n for r in ordering.ordered_row_number(df, ["k"], F.col("ts"), F.col("id"), "n").collect()
    }
    want = {}
    ordered = sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2]))
    for _, group in groupby(ordered, key=lambda r: r[0]):
        want.update({r[2]: n for n, r in enumerate(group, 1)})
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_changes(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = ordering.ordered_changes(df, ["k"], F.col("ts"), F.col("id"), "v").collect()
    got = {(r.k, r.version_number): (r.id, r.v, r.previous_value) for r in found}
    want = {}
    ordered = sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2]))
    for key, group in groupby(ordered, key=lambda r: r[0]):
        version, previous = 0, None
        for _, _, i, v in group:
            if v != previous:
                version += 1
                want[(key, version)] = (i, v, previous)
                previous = v
    assert got == want


def test_slices_split_a_hot_moment(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(5).cast("bigint").alias("ts"), F.col("id"))
    sliced = ordering.with_slices(df, ["k"], F.col("ts"), F.col("id"), slices=8)
    sizes = [r["count"] for r in sliced.groupBy(ordering.SLICE).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 4000 / 4


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordering.ordered_row_number(df, ["k"], F.col("ts"), F.col("id")).count() == 0
    assert ordering.ordered_changes(df, ["k"], F.col("ts"), F.col("id"), "v").count() == 0


def test_first_n_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(5), SCHEMA)
    top = ordering.first_n_per_key(df, ["k"], 2, F.col("ts"), F.col("id"))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().filter("count <> 2").count() == 0


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [1.0, 2.0],
        [5.0] * 1000 + [1.0, 9.0],
        [float(x) for x in range(1001)],
        [random.Random(7).gauss(0, 100) for _ in range(5000)],
        [random.Random(8).choice([0.1, 0.2, 0.3]) for _ in range(3000)],
    ],
)
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v, None) for v in values], "x double, y double").repartition(3)
    found = {r.column_name: r for r in profile.profile_columns(df).collect()}
    assert found["x"].median == pytest.approx(statistics.median(values))
    assert found["y"].median is None and found["y"].null_count == len(values)


def test_profile_of_one_row_and_booleans(spark):
    df = spark.createDataFrame([(3, True, "a")], "n int, b boolean, s string")
    found = {r.column_name: r for r in profile.profile_columns(df).collect()}
    assert (found["n"].std, found["n"].median, found["b"].mean, found["s"].mean) == (0.0, 3.0, 1.0, None)


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    rows = profile.top_values(df, n=2).collect()
    assert sorted((r["rank"], r.value, r["count"], r.percentage) for r in rows) == [(1, "c", 2, 40.0), (2, "a", 1, 20.0)]


def test_distinct_counts(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None)], "v string, w string")
    assert {r.column_name: r.unique_count for r in profile.distinct_counts(df).collect()} == {"v": 2, "w": 0}
    assert {r.column_name: r.unique_count for r in profile.distinct_counts(df, approximate=True).collect()} == {"v": 2, "w": 0}


def test_rows_are_computed_once(spark, tmp_path):
    """The input is read by the one job that writes it; slices, offsets and ranks read what was written."""
    path = str(tmp_path / "rows")
    spark.range(0, 2000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").alias("o")).write.parquet(path)
    ranked = ordering.ordered_row_number(spark.read.parquet(path), ["k"], F.col("o"), F.col("o"))
    assert not [f for f in ranked.inputFiles() if "/rows/" in f] and ranked.inputFiles()
    assert sorted(r["row_number"] for r in ranked.filter("k = 1").collect()) == list(range(1, 668))
