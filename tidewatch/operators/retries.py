"""Retry queue of failed validations: enqueue, advance, cancel, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordering import ordered_row_number
from tidewatch.functions.scalars import is_retryable, micros

OPEN = ("pending", "in_progress")
FAILED = ("failed", "error")


def failed_validations(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("status").isin(*FAILED))


def retry_history(retries: DataFrame, logs: DataFrame) -> DataFrame:
    """Retries with the validation they belong to and whether they may run again."""
    known = logs.select(
        F.col("id").alias("validation_log_id"), "dataset_name", "validation_type", F.col("status").alias("log_status")
    )
    return retries.join(known, "validation_log_id").withColumn(
        "is_retryable", is_retryable(F.col("retry_status"), F.col("retry_count"), F.col("max_retries"))
    )


def most_retried(history: DataFrame, top: int | None = 10) -> DataFrame:
    counts = history.groupBy("dataset_name", "validation_type").agg(F.count(F.lit(1)).alias("retry_count"))
    if top is None:
        return counts
    return counts.orderBy(F.col("retry_count").desc(), "dataset_name", "validation_type").limit(top)


def failures_with_retries(logs: DataFrame, retries: DataFrame) -> DataFrame:
    """Failed validations that were retried, each once."""
    # One row per validation before the shuffle, however often it was retried.
    tried = retries.select(F.col("validation_log_id").alias("id")).distinct()
    return failed_validations(logs).join(tried, "id", "left_semi")


def retry_timeline(retries: DataFrame) -> DataFrame:
    """Attempts of each validation in creation order, numbered."""
    return ordered_row_number(
        retries, ["validation_log_id"], micros(F.col("created_at")), F.col("id"), "attempt_order"
    )


def enqueue(logs: DataFrame, retries: DataFrame, max_retries: int = 3) -> DataFrame:
    """New pending entries for failed validations without an open retry."""
    open_ = retries.filter(F.col("retry_status").isin(*OPEN))
    open_ = open_.select(F.col("validation_log_id").alias("id")).distinct()
    return failed_validations(logs).join(open_, "id", "left_anti").select(
        F.col("id").alias("validation_log_id"),
        F.lit("pending").alias("retry_status"),
        F.lit(0).alias("retry_count"),
        F.lit(max_retries).alias("max_retries"),
    )


def advance(queue: DataFrame, attempts: DataFrame) -> DataFrame:
    """Queue entries after their attempts: passed or warning completes, anything else fails.

    ``queue``: (retry_id, retry_status, retry_count, max_retries); ``attempts``:
    (retry_id, attempt_at, attempt_id, status). Entries without attempts stay.
    """
    made = attempts.groupBy("retry_id").agg(
        F.count(F.lit(1)).alias("_made"),
        F.max_by("status", F.struct("attempt_at", "attempt_id")).alias("_last"),
        F.max("attempt_at").alias("_at"),
    )
    joined = queue.join(made, "retry_id", "left")
    tried = F.col("_made").isNotNull()
    count = F.col("retry_count") + F.coalesce("_made", F.lit(0))
    success = F.col("_last").isin("passed", "warning")
    used_up = count >= F.col("max_retries")
    return joined.select(
        "retry_id",
        F.when(~tried, F.col("retry_status")).when(success, "completed").otherwise("failed").alias("retry_status"),
        count.alias("retry_count"),
        "max_retries",
        F.col("_at").alias("last_retry_at"),
        F.when(tried & (success | used_up), F.col("_at")).alias("completed_at"),
        F.when(
            tried & success,
            F.concat(F.lit("Validation passed on retry attempt "), count.cast("string")),
        ).when(
            tried & used_up,
            F.concat(F.lit("Max retries reached ("), F.col("max_retries").cast("string"), F.lit(")")),
        ).alias("error_message"),
    )


def cancel(queue: DataFrame, cancelled_by: Column, at: Column) -> DataFrame:
    """Open entries cancelled; entries in any other state stay as they are."""
    open_ = F.col("retry_status").isin(*OPEN)
    return (
        queue.withColumn("completed_at", F.when(open_, at).otherwise(F.col("completed_at")))
        .withColumn(
            "error_message",
            F.when(open_, F.concat(F.lit("Cancelled by "), cancelled_by)).otherwise(F.col("error_message")),
        )
        .withColumn("retry_status", F.when(open_, "cancelled").otherwise(F.col("retry_status")))
    )
