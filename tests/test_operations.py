"""Freshness, loads, retries and run bookkeeping on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import filters, freshness, loads, records, retries, rollups, runs
from tidewatch.plans.common import at


def now():
    return at("2024-01-10 00:00:00")



def stamped(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def test_freshness_and_sla(spark):
    df = stamped(
        spark,
        [("Customers", "2024-01-09 06:00:00"), ("orders", "2024-01-09 22:00:00"), ("other", "2024-01-01 00:00:00")],
        "dataset_name string, t string", "t",
    )
    rows = {r.dataset_name: r for r in freshness.freshness_validate(df, "t", now()).collect()}
    assert (rows["Customers"].freshness_status, rows["Customers"].dataset_age_hours) == ("warning", 18.0)
    assert rows["Customers"].message == "Dataset 'Customers' is aging. Age: 18.0 hours, Expected threshold: 12.0h"
    assert rows["orders"].message == "Dataset 'orders' is fresh. Age: 2.0 hours, Threshold: 6.0h"
    assert rows["other"].message == "Dataset 'other' is stale! Age: 216.0 hours, Expected threshold: 24.0h"
    sla = {r.dataset_name: r for r in freshness.sla_eval(df.withColumn("done", now()), "t", "done").collect()}
    assert (sla["orders"].sla_status, sla["orders"].compliance_percentage) == ("compliant", 100.0)
    eight = stamped(spark, [("orders", "2024-01-09 16:00:00")], "dataset_name string, t string", "t")
    (row,) = freshness.sla_eval(eight.withColumn("done", now()), "t", "done").collect()
    assert (row.sla_status, row.breach_duration_hours, row.compliance_percentage) == ("breached", 2.0, 75.0)


def test_open_operations_have_no_latency(spark):
    events = stamped(
        spark,
        [(1, "ingestion_start", "2024-01-01 00:00:00"), (1, "ingestion_end", "2024-01-01 00:00:30"),
         (1, "validation_start", "2024-01-01 00:01:00"), (2, "ingestion_start", "2024-01-01 00:00:00")],
        "id int, event string, event_time string", "event_time",
    )
    rows = {r.id: r for r in freshness.with_latencies(freshness.pivot_operations(events, ["id"])).collect()}
    assert (rows[1].ingestion_latency_seconds, rows[1].validation_latency_seconds, rows[1].total_latency_seconds) == (30.0, None, 30.0)
    assert rows[2].total_latency_seconds is None


def test_empty_roll_ups_have_defaults(spark):
    none = spark.createDataFrame([], "sla_status string, actual_latency_hours double, breach_duration_hours double")
    (row,) = rollups.sla_batch(none).collect()
    assert tuple(row) == (0, 0, 0, 100.0, 0.0, 0.0)
    (row,) = rollups.retry_statistics(spark.createDataFrame([], "retry_status string")).collect()
    assert row.success_rate == 0.0


@pytest.mark.parametrize("value, want", [(0.575, 0.57), (100.505, 100.5), (2.675, 2.67), (0.125, 0.12), (0.375, 0.38), (1234567.891, 1234567.89)])
def test_rounding_follows_the_binary_value(spark, value, want):
    assert round(value, 2) == want
    (row,) = spark.range(1).select(scalars.round_exact(F.lit(value)).alias("v")).collect()
    assert row.v == want


def test_tag_key_and_metadata(spark):
    df = spark.sql("SELECT 'n' AS n, map('b', '1', 'a', '2') AS t, map('a', 'x') AS u, CAST(map() AS map<string,string>) AS e")
    (row,) = df.select(
        scalars.tag_key(F.col("n"), F.col("t")).alias("k"), scalars.tag_key(F.col("n"), F.col("e")).alias("p"),
        scalars.merge_metadata(F.col("t"), F.col("u")).alias("m"),
    ).collect()
    assert (row.k, row.p, row.m) == ("n{a=2,b=1}", "n", {"b": "1", "a": "x"})


def test_failure_patterns_show_few_examples(spark):
    df = spark.createDataFrame(
        [(1, "m" * 120, "t1", ["a"]), (2, "m" * 110, "t2", ["b", "c", "d", "e"]), (3, "m" * 100, "t3", ["f"]), (4, "", "t", ["g"]), (5, "k", "t", [])],
        "id int, message string, validation_type string, errors array<string>",
    )
    rows = rollups.failure_patterns(df).collect()
    assert [(r["count"], r.validation_type, r.example_errors) for r in rows] == [
        (3, "t1", ["a", "b", "c", "d"]), (1, "t", []),
    ]


def test_histogram_keeps_the_last_values(spark):
    df = spark.range(1500).select(F.lit("m").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    (row,) = rollups.histogram_stats(df, ["k"], "v", F.col("i").desc()).collect()
    assert (row["count"], row.min, row.max, row.p50, row.p95, row.p99) == (1000, 500.0, 1499.0, 1000.0, 1450.0, 1490.0)


def test_loads_deduplicate_inside_and_against_the_store(spark):
    incoming = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1"), (4, "h3")], "i int, record_hash string")
    stored = spark.createDataFrame([("h3",), ("h3",)], "record_hash string")
    outcomes = loads.load_outcomes(incoming, stored, "i")
    assert {r.i: r.outcome for r in outcomes.collect()} == {1: "loaded", 2: "loaded", 3: "duplicate", 4: "duplicate"}
    assert sorted(r.i for r in loads.load_dedup(incoming, stored, "i").collect()) == [1, 2]
    keyed = outcomes.withColumn("b", F.lit("x"))
    (skipped,) = loads.load_summary(keyed, ["b"]).collect()
    (refused,) = loads.load_summary(keyed, ["b"], skip_duplicates=False).collect()
    assert (skipped.records_loaded, skipped.records_duplicate, skipped.records_failed, skipped.success_rate) == (2, 2, 0, 50.0)
    assert refused.records_failed == 2


def test_verification(spark):
    counts = spark.createDataFrame(
        [("full", 2, 0, 2), ("short", 3, 1, 2), ("none", 2, 0, 0), ("surplus", 1, 0, 4)],
        "batch_id string, staging_count int, failed_count int, warehouse_count int",
    )
    rows = {r.batch_id: r for r in loads.verify_batches(counts).collect()}
    assert {k: r.verification_status for k, r in rows.items()} == {"full": "PASSED", "short": "FAILED", "none": "FAILED", "surplus": "PASSED"}
    assert rows["short"].issues == ["1 records missing from warehouse", "1 records failed during processing"]
    assert rows["none"].issues[1] == "No records loaded to warehouse despite source data"
    assert rows["surplus"].discrepancy == -3


def test_history_patches_and_completion(spark):
    history = stamped(
        spark, [("a", "running", 0, None), ("b", "running", 0, None), ("c", "running", 5, None)],
        "batch_id string, status string, records_loaded int, completed_at string", "completed_at",
    )
    updates = stamped(
        spark, [("a", "2024-01-02 00:00:00", "completed", 9), ("b", "2024-01-03 00:00:00", None, 4)],
        "batch_id string, updated_at string, status string, records_loaded int", "updated_at",
    )
    rows = {r.batch_id: (r.status, r.records_loaded, r.completed_at) for r in loads.upsert_history(history, updates).collect()}
    assert rows == {"a": ("completed", 9, dt.datetime(2024, 1, 2)), "b": ("running", 4, None), "c": ("running", 5, None)}


def test_retry_eligibility(spark):
    failed = stamped(
        spark, [("ok", "d", "Read TIMEOUT", 0, "2024-01-09 00:00:00"), ("bad", "d", "disk full", 3, "2024-01-09 23:30:00")],
        "batch_id string, dataset_name string, failure_reason string, retry_count int, load_failed_at string", "load_failed_at",
    )
    staging = spark.createDataFrame([("ok",)], "batch_id string")
    processed = spark.createDataFrame([("bad", "d")], "batch_id string, dataset_name string")
    rows = {r.batch_id: r for r in loads.retry_eligibility(failed, staging, processed, now()).collect()}
    assert (rows["ok"].validation_status, len(rows["ok"].checks_passed), rows["ok"].recommendations) == ("READY_FOR_RETRY", 5, [])
    assert (rows["bad"].validation_status, len(rows["bad"].checks_failed)) == ("NOT_READY", 5)


def test_retry_queue(spark):
    logs = spark.createDataFrame([(1, "failed"), (2, "passed"), (3, "error"), (4, "failed")], "id int, status string")
    open_ = spark.createDataFrame([(4, "in_progress"), (1, "completed")], "validation_log_id int, retry_status string")
    assert sorted(r.validation_log_id for r in retries.enqueue(logs, open_).collect()) == [1, 3]
    queue = spark.createDataFrame(
        [(1, "pending", 0, 3), (2, "pending", 0, 3), (3, "pending", 2, 3), (4, "pending", 0, 3)],
        "retry_id int, retry_status string, retry_count int, max_retries int",
    )
    attempts = spark.createDataFrame(
        [(1, 1, 1, "failed"), (1, 2, 2, "warning"), (2, 1, 3, "failed"), (3, 1, 4, "failed")],
        "retry_id int, attempt_at int, attempt_id int, status string",
    )
    rows = {r.retry_id: (r.retry_status, r.retry_count, r.completed_at, r.error_message) for r in retries.advance(queue, attempts).collect()}
    assert rows == {
        1: ("completed", 2, 2, "Validation passed on retry attempt 2"),
        2: ("failed", 1, None, None),
        3: ("failed", 3, 1, "Max retries reached (3)"),
        4: ("pending", 0, None, None),
    }


def test_records(spark):
    df = spark.createDataFrame(
        [(0, '{"id": 1, "n": "a"}'), (1, '{"id": 1, "n": 5}'), (2, '{"n": null}'), (3, '{"id": true, "n": "b"}'), (4, "broken"), (5, '{"id": 1.5, "n": []}')],
        "i int, p string",
    )
    missing = {r.record_index: r.missing_columns for r in records.record_required_columns(df, "i", "p", ["id", "n"]).collect()}
    assert missing == {2: "id", 4: "id,n"}
    assert sorted(r.record_index for r in records.record_duplicates(df, "i", "p", ["id"]).collect()) == [1, 4]
    wrong = {(r.record_index, r.field): (r.actual_type, r.value) for r in records.record_types(df, "i", "p", {"id": "int", "n": "str"}).collect()}
    assert wrong == {(1, "n"): ("int", "5"), (5, "id"): ("float", "1.5"), (5, "n"): ("list", "[]")}
    checks = records.validate_batch(df, "i", "p", ["id"], ["id"], {"id": "int"})
    (verdict,) = records.batch_verdict(checks).collect()
    assert tuple(verdict) == (False, 3, 0, 3)


def test_run_events_merge(spark):
    events = stamped(
        spark,
        [("r", "2024-01-01 00:00:00", "d", "running", "2024-01-01 00:00:00", None, 0),
         ("r", "2024-01-01 00:01:30", None, "success", None, "2024-01-01 00:01:30", None)],
        "dag_run_id string, event_time string, dag_id string, state string, start_date string, end_date string, total_tasks int",
        "event_time", "start_date", "end_date",
    ).withColumn("completed_tasks", F.lit(1)).withColumn("failed_tasks", F.lit(None).cast("int"))
    (row,) = runs.run_upsert(events).collect()
    assert (row.dag_id, row.state, row.duration_seconds, row.total_tasks, row.failed_tasks) == ("d", "success", 90.0, 0, None)


def test_pages_and_filters(spark):
    df = spark.range(10).withColumn("created_at", F.col("id") % 3)
    page = filters.sort_page(df, "nothing", ["id"], True, 3, 2)
    assert [r.id for r in page.collect()] == [2, 7, 4]
    (info,) = filters.page_info(df, limit=3, offset=6).collect()
    assert tuple(info) == (10, True)
    assert filters.apply_filters(df, ("id", "ge", 4), ("id", "le", None), ("created_at", "in", [0, 1])).count() == 4
    with pytest.raises(ValueError):
        filters.condition("id", "like", 1)
