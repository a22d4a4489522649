"""Deduplicating batch loads, their verification, history and retry decisions.

Parquet tables are not updated in place: a load appends, a rollback rewrites
without a batch, and the state of a load is the latest of its events.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import fixed
from tidewatch.functions.ordering import latest_per_key
from tidewatch.functions.scalars import (
    fixed_text, hours_between, named, reason_is_retryable, safe_rate, seconds_between,
)
from tidewatch.functions.skew import join_per_key

BATCH = ["batch_id", "dataset_name"]


# --- loading -------------------------------------------------------------------


def staging_rows(
    df: DataFrame, dataset: Column, batch: Column, source: Column, payload: Column, hash_value: Column | None = None
) -> DataFrame:
    """Envelope of arriving records: not processed yet, no error; the hash is that of the payload unless given."""
    return df.select(
        dataset.alias("dataset_name"),
        batch.alias("batch_id"),
        source.alias("source_system"),
        payload.alias("raw_data"),
        (F.sha2(payload.cast("binary"), 256) if hash_value is None else hash_value).alias("record_hash"),
        F.lit(False).alias("is_processed"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("error_message"),
    )


def processed_rows(
    df: DataFrame,
    dataset: Column,
    batch: Column,
    source: Column,
    payload: Column,
    loaded_at: Column,
    record_id: Column | None = None,
    hash_value: Column | None = None,
    quality: Column | None = None,
    status: Column | None = None,
    partition: Column | None = None,
) -> DataFrame:
    """Envelope of loaded records; a record without a status has passed."""
    text = F.lit(None).cast("string")
    return df.select(
        dataset.alias("dataset_name"),
        batch.alias("batch_id"),
        source.alias("source_system"),
        (text if record_id is None else record_id.cast("string")).alias("source_record_id"),
        payload.alias("data"),
        (text if hash_value is None else hash_value).alias("record_hash"),
        (F.lit(None) if quality is None else quality).cast("double").alias("data_quality_score"),
        F.coalesce(text if status is None else status, F.lit("passed")).alias("validation_status"),
        loaded_at.alias("load_timestamp"),
        (text if partition is None else partition).alias("partition_key"),
    )


def load_outcomes(incoming: DataFrame, loaded: DataFrame, index: str) -> DataFrame:
    """Marks each incoming record ``loaded`` or ``duplicate``.

    A record is a duplicate if its hash is stored already, in any dataset, or
    came earlier in the same load. The first index per hash is aggregated on
    the map side, so a record copied a million times is one row in the shuffle.
    Stored hashes are reduced to those that arrive, which Spark does by broadcast
    or a Bloom filter where that is smaller; records are joined only with
    hashes that have a duplicate. A record without a hash is compared with none
    and is loaded.
    """
    hashed = incoming.filter(F.col("record_hash").isNotNull())
    first = hashed.groupBy("record_hash").agg(F.min(named(index)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    stored = _stored_among(loaded, hashed).withColumn("_stored", F.lit(True))
    known = first.join(stored, "record_hash", "left").filter((F.col("_n") > 1) | F.col("_stored"))
    again = F.coalesce("_stored", named(index) != F.col("_first"))
    return (
        join_per_key(incoming, known, ["record_hash"], "_n", "left")
        .withColumn("outcome", F.when(again, "duplicate").otherwise("loaded"))
        .drop("_first", "_n", "_stored")
    )


def load_dedup(incoming: DataFrame, loaded: DataFrame, index: str) -> DataFrame:
    """New records only: the first of each hash that is not stored yet, and all without a hash.

    Copies are reduced to one per task before the shuffle; the anti join then
    reuses the same partitioning, against stored hashes among those that arrive.
    """
    hashed = incoming.filter(F.col("record_hash").isNotNull())
    single = latest_per_key(hashed, ["record_hash"], named(index).asc())
    fresh = single.join(_stored_among(loaded, hashed), "record_hash", "left_anti")
    return fresh.unionByName(incoming.filter(F.col("record_hash").isNull()))


def _stored_among(loaded: DataFrame, incoming: DataFrame) -> DataFrame:
    """Distinct stored hashes that arrive again."""
    return loaded.select("record_hash").join(incoming.select("record_hash"), "record_hash", "left_semi").distinct()


def load_summary(outcomes: DataFrame, keys: Sequence[str], skip_duplicates: bool = True) -> DataFrame:
    """Counts of a load; refused duplicates count as failed when they may not be skipped."""
    duplicate = F.count_if(F.col("outcome") == "duplicate")
    return (
        outcomes.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("records_attempted"),
            F.count_if(F.col("outcome") == "loaded").alias("records_loaded"),
            duplicate.alias("records_duplicate"),
            (F.lit(0).cast("bigint") if skip_duplicates else duplicate).alias("records_failed"),
        )
        .withColumn("success_rate", safe_rate(F.col("records_loaded"), F.col("records_attempted")))
        .withColumn("status", F.lit("completed"))
    )


def without_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """The table without one batch, for the rewrite of a rollback; rows without a batch stay."""
    return df.filter(~F.col("batch_id").eqNullSafe(batch_id))


def rollback_counts(processed: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """Deleted rows per batch of ``rolled_back`` (batch_id); 0 for an empty batch."""
    deleted = processed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records_deleted"))
    return (
        rolled_back.join(deleted, "batch_id", "left").fillna(0, ["records_deleted"])
        .withColumn("status", F.lit("rolled_back"))
        .withColumn("error_message", F.lit("Batch manually rolled back"))
    )


def without_batches(df: DataFrame, batches: DataFrame) -> DataFrame:
    """The table without any of the batches."""
    return df.join(batches.select("batch_id"), "batch_id", "left_anti")


# --- history ----------------------------------------------------------------------


def upsert_history(history: DataFrame, updates: DataFrame) -> DataFrame:
    """History rows patched with the non-NULL fields of their updates, applied in the order of ``updated_at``.

    ``updates``: (batch_id, updated_at, any history columns). The last non-NULL value of a
    field wins, of two at one time the larger. A final status sets ``completed_at``
    to the time of the last update with one.
    """
    patched = [c for c in updates.columns if c in history.columns and c != "batch_id"]

    def last(c: str) -> Column:
        return F.max(F.when(named(c).isNotNull(), F.struct(F.col("updated_at"), named(c).alias("value"))))["value"]

    final = F.col("status").isin(*fixed.TERMINAL_LOAD_STATES) if "status" in patched else F.lit(False)
    new = updates.groupBy("batch_id").agg(
        *[last(c).alias(f"_new_{c}") for c in patched], F.max(F.when(final, F.col("updated_at"))).alias("_ended")
    )
    joined = history.join(new, "batch_id", "left")
    values = {c: F.coalesce(F.col(f"_new_{c}"), named(c)) for c in patched}
    if "completed_at" in history.columns:
        values["completed_at"] = F.coalesce("_ended", values.get("completed_at", F.col("completed_at")))
    return joined.select(*[values.get(c, named(c)).alias(c) for c in history.columns])


def load_lifecycle(events: DataFrame) -> DataFrame:
    """State of each load from its events: started, then completed, failed or retrying.

    ``events``: (batch_id, dataset_name, event, event_time, records, reason). Elapsed
    whole seconds run from the last start before the latest event.
    """
    when_ = lambda *names: F.when(F.col("event").isin(*names), F.col("event_time"))
    position = F.struct("event_time", "event")
    states = events.groupBy("batch_id").agg(
        F.max_by("dataset_name", position).alias("dataset_name"),
        F.max_by("event", position).alias("load_status"),
        F.max(when_("started", "retrying")).alias("load_started_at"),
        F.max(when_("completed", "failed")).alias("_ended"),
        F.max_by("records", position).alias("warehouse_record_count"),
        F.max_by("reason", position).alias("failure_reason"),
        F.count_if(F.col("event") == "retrying").alias("retry_count"),
    )
    done = F.col("load_status").isin("completed", "failed")
    return states.select(
        "batch_id", "dataset_name", "load_status", "load_started_at",
        F.when(done, F.col("_ended")).alias("load_completed_at"),
        F.when(
            done, F.floor(seconds_between(F.col("load_started_at"), F.col("_ended")))
        ).cast("bigint").alias("execution_time_seconds"),
        "warehouse_record_count", "failure_reason", "retry_count",
    )


def failed_load_rows(lifecycle: DataFrame) -> DataFrame:
    """A failed load asks for a manual check before it may be retried."""
    return lifecycle.filter(F.col("load_status") == "failed").select(
        "batch_id", "dataset_name", "load_started_at", F.col("load_completed_at").alias("load_failed_at"),
        "failure_reason", "warehouse_record_count", "retry_count", F.lit(False).alias("can_retry"),
    )


# --- verification --------------------------------------------------------------------


def batch_counts(staging: DataFrame, processed: DataFrame) -> DataFrame:
    """Staged, failed and loaded rows per batch and dataset."""
    failed = ~F.col("is_processed") & F.col("error_message").isNotNull()
    staged = staging.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("staging_count"), F.count_if(failed).alias("failed_count")
    )
    loaded = processed.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("warehouse_count"))
    counts = ["staging_count", "failed_count", "warehouse_count"]
    return staged.join(loaded, BATCH, "full_outer").fillna(0, counts)


def verify_batches(counts: DataFrame, source: str = "staging_count") -> DataFrame:
    """Verdict per batch: nothing missing, nothing failed, something loaded. Surplus rows pass."""
    expected, loaded, failed = named(source), F.col("warehouse_count"), F.col("failed_count")
    missing = expected - loaded
    issues = F.array_compact(
        F.array(
            F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" records missing from warehouse"))),
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" records failed during processing"))),
            F.when((loaded == 0) & (expected > 0), "No records loaded to warehouse despite source data"),
        )
    )
    valid = F.size("issues") == 0
    return (
        counts.withColumn("source_count", expected)
        .withColumn("discrepancy", missing)
        .withColumn("issues", issues)
        .withColumn("is_valid", valid)
        .withColumn("verification_status", F.when(valid, "PASSED").otherwise("FAILED"))
    )


def failed_records(staging: DataFrame, preview: int = 200) -> DataFrame:
    """Staged rows that could not be processed, with the start of their payload."""
    return staging.filter(~F.col("is_processed") & F.col("error_message").isNotNull()).select(
        *BATCH, "record_hash", "error_message", F.substring("raw_data", 1, preview).alias("raw_data_preview")
    )


# --- retry decisions --------------------------------------------------------------------


def _filled(text: str, values: dict[str, Column]) -> Column:
    """A message with its ``{names}`` replaced by columns."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def retry_eligibility(
    failed: DataFrame, staging: DataFrame, processed: DataFrame, as_of: Column
) -> DataFrame:
    """Five checks per failed load; it is ready only if all of them pass."""
    staged = staging.groupBy("batch_id").agg(F.count(F.lit(1)).alias("staging_count"))
    loaded = processed.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("warehouse_count"))
    joined = (
        failed.join(staged, "batch_id", "left").join(loaded, BATCH, "left")
        .fillna(0, ["staging_count", "warehouse_count"])
    )
    hours = hours_between(F.col("load_failed_at"), as_of)
    retries = F.col("retry_count").cast("string")
    values = {
        "staged": F.col("staging_count").cast("string"), "retries": retries, "loaded": F.col("warehouse_count").cast("string"),
        "hours": fixed_text(hours, 1), "reason": F.col("failure_reason"),
    }
    holds = {
        "staging": F.col("staging_count") > 0, "reason": reason_is_retryable(F.col("failure_reason")), "retries": F.col("retry_count") < 3,
        "warehouse": F.col("warehouse_count") == 0, "elapsed": hours >= 1,
    }
    checks = [(holds[name], *[_filled(text, values) for text in texts]) for name, texts in fixed.RETRY_CHECKS.items()]
    ready = F.size("checks_failed") == 0
    return (
        joined.withColumns(
            {
                "checks_passed": F.array_compact(F.array(*[F.when(ok, good) for ok, good, _, _ in checks])),
                "checks_failed": F.array_compact(F.array(*[F.when(~ok, bad) for ok, _, bad, _ in checks])),
                "recommendations": F.array_compact(F.array(*[F.when(~ok, tip) for ok, _, _, tip in checks])),
            }
        )
        .withColumn("ready", ready)
        .withColumn("validation_status", F.when(ready, "READY_FOR_RETRY").otherwise("NOT_READY"))
    )


def retry_approvals(events: DataFrame) -> DataFrame:
    """Approval state per batch; the latest approval or revocation wins.

    ``events``: (batch_id, action, event_time, actor) with action "approve" or "revoke".
    """
    latest = latest_per_key(events, ["batch_id"], F.col("event_time").desc(), F.col("action").desc())
    approved = F.col("action") == "approve"
    return latest.select(
        "batch_id",
        approved.alias("can_retry"),
        F.when(approved, F.col("event_time")).alias("retry_validated_at"),
        F.when(approved, F.col("actor")).alias("retry_validated_by"),
        F.when(~approved, F.col("event_time")).alias("revoked_at"),
        F.when(~approved, F.col("actor")).alias("revoked_by"),
    )
