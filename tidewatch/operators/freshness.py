"""Dataset age, service levels and latencies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import fixed
from tidewatch.functions.scalars import fixed_text, hours_between, lookup, round_exact, seconds_between

EVENTS = ("ingestion_start", "ingestion_end", "validation_start", "validation_end")


def freshness_limits(dataset: Column, custom: Mapping[str, tuple] | None = None) -> tuple[Column, Column]:
    """(healthy hours, warning hours) of a dataset; custom limits win over the fixed ones."""
    limits = {**fixed.FRESHNESS_BY_DATASET, **{k.lower(): v for k, v in (custom or {}).items()}}
    key = F.lower(dataset)
    return tuple(
        lookup(key, {k: v[i] for k, v in limits.items()}, F.lit(fixed.FRESHNESS_DEFAULT[i]))
        for i in (0, 1)
    )


def sla_limit(dataset: Column, custom: Mapping[str, float] | None = None) -> Column:
    limits = {**fixed.SLA_BY_DATASET, **{k.lower(): v for k, v in (custom or {}).items()}}
    return lookup(F.lower(dataset), limits, F.lit(fixed.SLA_DEFAULT))


def threshold_lookup(datasets: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds from a table instead of constants, with the defaults for unknown datasets.

    ``thresholds``: (dataset, healthy_hours, warning_hours, sla_hours), one row
    per dataset. AQE broadcasts it while it is small and shuffles it otherwise.
    """
    limits = thresholds.withColumnRenamed("dataset", "_dataset")
    return datasets.join(limits, F.lower("dataset_name") == F.col("_dataset"), "left").select(
        datasets["*"],
        F.coalesce("healthy_hours", F.lit(fixed.FRESHNESS_DEFAULT[0])).alias("healthy_hours"),
        F.coalesce("warning_hours", F.lit(fixed.FRESHNESS_DEFAULT[1])).alias("warning_hours"),
        F.coalesce("sla_hours", F.lit(fixed.SLA_DEFAULT)).alias("sla_hours"),
    )


def freshness_status(age_hours: Column, healthy: Column, warning: Column) -> Column:
    return (
        F.when(age_hours <= healthy, "healthy").when(age_hours <= warning, "warning").otherwise("critical")
    )


def freshness_message(dataset: Column, age: Column, status: Column, threshold: Column) -> Column:
    hours = F.concat(fixed_text(age, 1), F.lit(" hours"))
    limit = F.concat(threshold.cast("string"), F.lit("h"))
    state = F.when(status == "healthy", " is fresh. Age: ").when(
        status == "warning", " is aging. Age: "
    ).otherwise(" is stale! Age: ")
    what = F.when(status == "healthy", ", Threshold: ").otherwise(", Expected threshold: ")
    return F.concat(F.lit("Dataset '"), dataset, F.lit("'"), state, hours, what, limit)


def freshness_validate(
    df: DataFrame, ingested_at: str, as_of: Column, custom: Mapping[str, tuple] | None = None
) -> DataFrame:
    """Adds age, status, threshold and message to rows of (dataset_name, ingestion time)."""
    healthy, warning = freshness_limits(F.col("dataset_name"), custom)
    age = hours_between(F.col(ingested_at), as_of)
    status = freshness_status(age, healthy, warning)
    return df.withColumns(
        {
            "dataset_age_hours": round_exact(age),
            "freshness_status": status,
            "freshness_threshold_hours": healthy,
            "is_fresh": status == "healthy",
            "message": freshness_message(F.col("dataset_name"), age, status, healthy),
        }
    )


def sla_eval(df: DataFrame, start: str, end: str, custom: Mapping[str, float] | None = None) -> DataFrame:
    """Adds latency, status, breach and compliance to operations with a start and an end."""
    limit = sla_limit(F.col("dataset_name"), custom)
    latency = hours_between(F.col(start), F.col(end))
    breached = latency > limit
    compliance = F.when(
        limit > 0,
        F.when(breached, F.greatest(F.lit(0.0), limit / latency * 100.0)).otherwise(100.0),
    )
    return df.withColumns(
        {
            "sla_threshold_hours": limit,
            "actual_latency_hours": round_exact(latency),
            "sla_status": F.when(latency.isNotNull(), F.when(breached, "breached").otherwise("compliant")),
            "compliance_percentage": F.when(latency.isNotNull(), round_exact(compliance)),
            "breach_duration_hours": F.when(breached, round_exact(latency - limit)),
        }
    )


def pivot_operations(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per operation from its start and end events; the last event of a kind counts."""
    return events.groupBy(*keys).agg(
        *[F.max(F.when(F.col("event") == e, F.col("event_time"))).alias(e) for e in EVENTS]
    )


def with_latencies(operations: DataFrame) -> DataFrame:
    """Ingestion, validation and total seconds; open operations give NULL."""
    last = F.coalesce("validation_end", "ingestion_end")
    return operations.withColumns(
        {
            "ingestion_latency_seconds": seconds_between(F.col("ingestion_start"), F.col("ingestion_end")),
            "validation_latency_seconds": seconds_between(F.col("validation_start"), F.col("validation_end")),
            "total_latency_seconds": seconds_between(F.col("ingestion_start"), last),
        }
    )


def freshness_rows(operations: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the freshness table: age, service level and latencies of every operation."""
    timed = with_latencies(operations).withColumn(
        "_done", F.coalesce("validation_end", "ingestion_end")
    )
    aged = freshness_validate(timed, "ingestion_start", as_of)
    return sla_eval(aged, "ingestion_start", "_done").drop("_done")
