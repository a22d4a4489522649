"""Column profiles, distributions, quality and health scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidewatch.functions.ordering import exact_quantiles, first_n_per_key, latest_per_key
from tidewatch.functions.scalars import (
    grade, health_band, named, quoted, round_exact, safe_rate, sql_array, text_array,
)

TOP = 10


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans count as 0 and 1."""
    kinds = (NumericType, BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _number(df: DataFrame, column: str) -> str:
    """SQL text of a numeric column as a double; a boolean counts as 0 or 1."""
    inner = quoted(column)
    if isinstance(df.schema[column].dataType, BooleanType):
        inner = f"CAST({inner} AS INT)"
    return f"CAST({inner} AS DOUBLE)"


def _counted_cells(cells: DataFrame) -> DataFrame:
    """(column_name, value, n): cells unpivoted, NULLs left out, counted before the shuffle."""
    rows = cells.unpivot([], [named(c) for c in cells.columns], "column_name", "value")
    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def value_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over the text form of any column."""
    return _counted_cells(
        df.selectExpr(*[f"CAST({quoted(c)} AS STRING) AS {quoted(c)}" for c in columns])
    )


def middle_histogram(df: DataFrame, columns: Sequence[str], p: float = 0.5) -> DataFrame:
    """(column_name, value, n) of numeric columns with both tails collapsed to -inf and inf.

    Approximate quantiles with a rank error below 0.1 % bracket the wanted rank
    by 1 % on both sides. Values outside the bracket only matter by their
    number, so about 2 % of the cells are shuffled, and the rank stays exact.
    """
    low, high = max(0.0, p - 0.01), min(1.0, p + 0.01)
    numbers = df.selectExpr(*[f"{_number(df, c)} AS _x{i}" for i, c in enumerate(columns)])
    bounds = numbers.selectExpr(
        *[f"percentile_approx(_x{i}, array({low}D, {high}D), 1000) AS b{i}" for i in range(len(columns))]
    ).select(F.struct("*").alias("b"))
    cells = numbers.withColumn("_b", bounds.scalar()).selectExpr(
        *[
            f"CASE WHEN _x{i} < _b.b{i}[0] THEN double('-Infinity') "
            f"WHEN _x{i} > _b.b{i}[1] THEN double('Infinity') ELSE _x{i} END AS {quoted(c)}"
            for i, c in enumerate(columns)
        ]
    )
    return _counted_cells(cells)


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, median: str = "exact"
) -> DataFrame:
    """NULLs of every column; min, max, mean, median and deviation of numeric ones.

    One scan gives everything but the exact median, which ranks the values
    around the middle in two more passes over the numeric columns.
    ``median="approximate"`` stays within the first scan.
    """
    columns = list(columns or df.columns)
    numbers = [c for c in numeric_columns(df) if c in columns]
    aggregates, rows = ["count(1) AS total"], []
    for i, c in enumerate(columns):
        aggregates.append(f"count_if({quoted(c)} IS NULL) AS n{i}")
        fields = {k: "CAST(NULL AS DOUBLE)" for k in ("min", "max", "mean", "std", "median")}
        if c in numbers:
            x = _number(df, c)
            aggregates += [
                f"min({x}) AS lo{i}", f"max({x}) AS hi{i}", f"avg({x}) AS avg{i}",
                f"stddev_samp({x}) AS sd{i}", f"count({x}) AS c{i}",
            ]
            # The deviation of a single value is zero.
            fields |= {
                "min": f"lo{i}", "max": f"hi{i}", "mean": f"avg{i}",
                "std": f"CASE WHEN c{i} = 1 THEN 0D ELSE sd{i} END",
            }
            if median == "approximate":
                aggregates.append(f"percentile_approx({x}, 0.5) AS med{i}")
                fields["median"] = f"med{i}"
        values = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        kind = df.schema[c].dataType.simpleString().replace("\\", "\\\\").replace("'", "\\'")
        rows.append(f"named_struct('data_type', '{kind}', 'null_count', n{i}, {values})")
    profile = (
        df.selectExpr(*aggregates)
        .select("total", F.posexplode(sql_array(rows)).alias("i", "r"))
        .select(
            "total", F.element_at(text_array(columns), F.col("i") + 1).alias("column_name"), "r.*"
        )
        .withColumn("null_percentage", safe_rate(F.col("null_count"), F.col("total")))
    )
    if median == "approximate" or not numbers:
        return profile
    medians = exact_quantiles(
        middle_histogram(df, numbers), "column_name", "value", "n", 0.5, "_median"
    )
    return (
        profile.drop("median").join(medians, "column_name", "left")
        .withColumnRenamed("_median", "median")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column."""
    columns = list(columns or df.columns)
    if approximate:
        counts = df.select(sql_array(f"approx_count_distinct({quoted(c)})" for c in columns).alias("n"))
        return counts.select(F.posexplode("n").alias("i", "unique_count")).select(
            F.element_at(text_array(columns), F.col("i") + 1).alias("column_name"), "unique_count"
        )
    found = value_histogram(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    names = df.sparkSession.range(1).select(F.explode(text_array(columns)).alias("column_name"))
    return names.join(found, "column_name", "left").fillna(0, ["unique_count"])


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = TOP) -> DataFrame:
    """The most frequent values per column; equal counts by value."""
    columns = list(columns or df.columns)
    totals = df.agg(F.count(F.lit(1)).alias("total"))
    ranked = first_n_per_key(
        value_histogram(df, columns), ["column_name"], n, F.col("n").desc(), F.col("value")
    )
    return ranked.select(
        "column_name",
        F.col("row_number").alias("rank"),
        "value",
        F.col("n").alias("count"),
        totals.scalar().alias("total"),
    ).select(
        "column_name", "rank", "value", "count",
        safe_rate(F.col("count"), F.col("total")).alias("percentage"),
    )


def profile_dataset(df: DataFrame, dataset_name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics and distinct counts per column with the size of the table."""
    columns = list(columns or df.columns)
    return (
        profile_columns(df, columns)
        .join(distinct_counts(df, columns), "column_name")
        .select(
            F.lit(dataset_name).alias("dataset_name"),
            F.col("total").alias("row_count"),
            F.lit(len(columns)).cast("bigint").alias("column_count"),
            "column_name", "data_type", "null_count", "null_percentage",
            "min", "max", "mean", "median", "std", "unique_count",
        )
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """Mean NULL share over the columns and the number of numeric columns."""
    return profile.agg(
        F.avg("null_percentage").alias("average_null_percentage"),
        F.count_if(F.col("mean").isNotNull()).alias("numeric_columns"),
        F.count(F.lit(1)).alias("column_count"),
    )


def quality_score(profile: DataFrame, rule_summary: DataFrame) -> DataFrame:
    """40 points for rules, 30 for non-NULL cells, 30 for distinct values, and a grade.

    ``profile``: :func:`profile_dataset`; ``rule_summary``: one row with
    ``total_rules`` and ``passed_rules``.
    """
    non_null = F.when(F.col("row_count") > 0, 100.0 - F.col("null_percentage")).otherwise(0.0)
    distinct = safe_rate(F.col("unique_count"), F.col("row_count"))
    scores = profile.groupBy("dataset_name").agg(
        (F.avg(non_null) * 0.3).alias("completeness_score"),
        (F.least(F.avg(distinct), F.lit(100.0)) * 0.3).alias("uniqueness_score"),
    )
    rule_points = rule_summary.select(
        F.when(F.col("total_rules") > 0, F.col("passed_rules") / F.col("total_rules") * 40.0)
        .otherwise(0.0).alias("p")
    )
    return (
        scores.withColumn("validation_score", rule_points.scalar())
        .withColumn("_total", F.col("validation_score") + F.col("completeness_score") + F.col("uniqueness_score"))
        .select(
            "dataset_name",
            round_exact(F.col("_total")).alias("quality_score"),
            round_exact(F.col("validation_score")).alias("validation_score"),
            round_exact(F.col("completeness_score")).alias("completeness_score"),
            round_exact(F.col("uniqueness_score")).alias("uniqueness_score"),
            grade(F.col("_total")).alias("grade"),
        )
    )


def health_score(
    validations: DataFrame, freshness: DataFrame, key: str = "pipeline_name"
) -> DataFrame:
    """Scores per pipeline: passed validations, non-critical freshness, latency within SLA.

    ``validations``: (key, status); ``freshness``: (key, freshness_status,
    sla_status, total_latency_seconds). The overall score is their mean.
    """
    checks = validations.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("status") == "passed").alias("_passed"),
    )
    ages = freshness.groupBy(key).agg(
        F.count(F.lit(1)).alias("_ops"),
        F.count_if(F.col("freshness_status") == "critical").alias("freshness_violations"),
        F.count_if(F.col("sla_status") == "compliant").alias("_compliant"),
        F.avg("total_latency_seconds").alias("average_latency_seconds"),
    )
    scored = checks.join(ages, key, "full_outer").select(
        key,
        F.coalesce("total_validations", F.lit(0)).alias("total_validations"),
        F.coalesce("freshness_violations", F.lit(0)).alias("freshness_violations"),
        "average_latency_seconds",
        safe_rate(F.col("_passed"), F.col("total_validations")).alias("validation_score"),
        safe_rate(F.col("_ops") - F.col("freshness_violations"), F.col("_ops")).alias("freshness_score"),
        safe_rate(F.col("_compliant"), F.col("_ops")).alias("latency_score"),
    )
    overall = (F.col("validation_score") + F.col("freshness_score") + F.col("latency_score")) / 3
    return scored.withColumn("overall_score", overall).withColumn("status", health_band(overall))


def health_rollup(scores: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """Counts per health band and the mean score over the latest score of every pipeline."""
    latest = latest_per_key(scores, [key], *newest_first)
    return latest.agg(
        F.count(F.lit(1)).alias("total_pipelines"),
        F.count_if(F.col("status") == "healthy").alias("healthy_count"),
        F.count_if(F.col("status") == "degraded").alias("degraded_count"),
        F.count_if(F.col("status") == "unhealthy").alias("unhealthy_count"),
        round_exact(F.coalesce(F.avg("overall_score"), F.lit(0.0))).alias("average_overall_score"),
    )
