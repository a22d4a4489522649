"""Shape of validation results: one row per validator."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import pass_rate

RESULT_COLUMNS = [
    "validator_name",
    "status",
    "passed",
    "total_records",
    "failed_records",
    "pass_rate",
    "message",
    "details",
    "errors",
]


def error_list(*errors: Column) -> Column:
    """The errors that apply, as one array; each is NULL when it does not."""
    if not errors:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*errors)).cast("array<string>")


def result_struct(
    name: str | Column,
    status: Column,
    total: Column,
    failed: Column,
    message: Column,
    errors: Column,
    details: Column | None = None,
    rate: Column | None = None,
) -> Column:
    """The result columns as one struct, built from a row of measurements."""
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("validator_name"),
        status.alias("status"),
        (status == "passed").alias("passed"),
        total.cast("bigint").alias("total_records"),
        failed.cast("bigint").alias("failed_records"),
        (pass_rate(total, failed) if rate is None else rate).cast("double").alias("pass_rate"),
        message.cast("string").alias("message"),
        (F.lit("{}") if details is None else details).alias("details"),
        errors.alias("errors"),
    )


def result_rows(measured: DataFrame, *structs: Column) -> DataFrame:
    """Several verdicts over the same row of measurements, one row each."""
    return measured.select(F.inline(F.array(*structs)))


class Check(NamedTuple):
    """A validator in three parts, so that several validators share one scan.

    ``measures`` are aggregations of the table. ``steps`` name values computed
    from them, each step seeing the ones before; naming a value used several
    times keeps the plan small however many columns a table has. ``verdict`` is
    the result struct.
    """

    measures: Sequence[Column]
    steps: Sequence[dict[str, Column]]
    verdict: Column


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(position, result columns) of all checks from one aggregation of the table."""
    measures = [m for check in checks for m in check.measures]
    row = df.agg(F.count(F.lit(1)).alias("total"), *measures)
    for level in range(max((len(check.steps) for check in checks), default=0)):
        named = [check.steps[level] for check in checks if len(check.steps) > level]
        row = row.withColumns({name: value for step in named for name, value in step.items()})
    verdicts = F.array(*[check.verdict for check in checks])
    return row.select(F.posexplode(verdicts).alias("position", "r")).select("position", "r.*")


def error_struct(name: str, message: str, errors: list[str] | None = None) -> Column:
    return result_struct(
        name, F.lit("error"), F.lit(0), F.lit(0), F.lit(message),
        error_list(*[F.lit(e) for e in (errors or [message])]),
    )


def error_row(spark, name: str, message: str, errors: list[str] | None = None) -> DataFrame:
    """The row of a validator that could not run."""
    return result_rows(spark.range(1), error_struct(name, message, errors))


def aggregate_results(
    results: DataFrame, keys: list[str], order: str = "position", *extra: Column
) -> DataFrame:
    """Overall status per key: error over failed over warning over passed.

    ``order`` numbers the validators of a key; the first one with records
    supplies ``total_records``. ``extra`` adds aggregations to the same pass.
    """
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    first_total = F.min_by(
        F.when(F.col("total_records") > 0, F.col("total_records")),
        F.when(F.col("total_records") > 0, F.col(order)),
    )
    overall = (
        F.when(F.col("error_validators") > 0, "error")
        .when(F.col("failed_validators") > 0, "failed")
        .when(F.col("warning_validators") > 0, "warning")
        .otherwise("passed")
    )
    return (
        results.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_validators"),
            count("passed").alias("passed_validators"),
            count("failed").alias("failed_validators"),
            count("warning").alias("warning_validators"),
            count("error").alias("error_validators"),
            F.coalesce(first_total, F.lit(0)).alias("total_records"),
            F.coalesce(F.sum("execution_time_ms"), F.lit(0.0)).alias("total_execution_time_ms"),
            *extra,
        )
        .withColumn("overall_status", overall)
        .withColumn("overall_passed", F.col("overall_status") == "passed")
    )
