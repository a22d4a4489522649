"""Roll-ups over monitoring tables: metrics, audits, loads, retries, runs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordering import first_n_per_key, latest_per_key
from tidewatch.functions.scalars import day_of, hour_of, metric_unit, named, round_exact, safe_rate, tag_key
from tidewatch.operators.filters import apply_filters

HISTOGRAM_SIZE = 1000


def _count(column: str, value: str, name: str) -> Column:
    return F.count_if(F.col(column) == value).alias(name)


def _rate(part: str, whole: str, name: str) -> Column:
    return safe_rate(F.col(part), F.col(whole)).alias(name)


# --- metrics --------------------------------------------------------------------


def metrics_window(df: DataFrame, start, end, **equals) -> DataFrame:
    """Metric rows between two times, both included, with optional equalities."""
    conditions = [(column, "eq", value) for column, value in equals.items()]
    return apply_filters(df, ("timestamp", "ge", start), ("timestamp", "le", end), *conditions)


def _values(*extra: Column) -> list[Column]:
    value = F.col("metric_value")
    return [
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average"),
        *extra,
    ]


def metrics_daily(df: DataFrame) -> DataFrame:
    value = F.col("metric_value")
    return df.groupBy("metric_name", day_of(F.col("timestamp")).alias("date")).agg(
        *_values(F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    )


def metrics_hourly(df: DataFrame) -> DataFrame:
    return df.groupBy("metric_name", hour_of(F.col("timestamp")).alias("hour")).agg(*_values())


def metrics_by(df: DataFrame, column: str) -> DataFrame:
    """Totals per value of ``column``; rows without one are left out."""
    return df.filter(named(column).isNotNull()).groupBy("metric_name", column).agg(*_values())


def metrics_summary(df: DataFrame) -> DataFrame:
    """Counts, success rates and mean durations of a window in one aggregation."""
    names = (
        "validation_success", "validation_failure", "validation_warning",
        "ingestion_execution", "ingestion_success", "ingestion_failure",
    )
    durations = {
        "validation_duration": "avg_validation_duration_ms",
        "ingestion_duration": "avg_ingestion_duration_ms",
        "api_request_duration": "avg_api_duration_ms",
    }
    name = F.col("metric_name")
    totals = df.agg(
        *[F.count_if(name == n).alias(n) for n in names],
        *[
            round_exact(F.coalesce(F.avg(F.when(name == n, F.col("execution_time"))), F.lit(0.0))).alias(alias)
            for n, alias in durations.items()
        ],
    )
    return (
        totals.withColumn(
            "validation_total",
            F.col("validation_success") + F.col("validation_failure") + F.col("validation_warning"),
        )
        .withColumn("_ingestions", F.col("ingestion_success") + F.col("ingestion_failure"))
        .withColumn("validation_success_rate", round_exact(_rate("validation_success", "validation_total", "r")))
        .withColumn("ingestion_success_rate", round_exact(_rate("ingestion_success", "_ingestions", "r")))
        .drop("_ingestions")
    )


def histogram_stats(
    df: DataFrame, keys: list[str], value: str, *newest_first: Column, size: int = HISTOGRAM_SIZE
) -> DataFrame:
    """Statistics over the last ``size`` values per key; percentiles pick the value at int(n*p).

    Up to 1 000 values Spark limits each key before the shuffle, so no key is hot; a larger ``size`` is refused.
    """
    if not 0 < size <= HISTOGRAM_SIZE:
        raise ValueError(f"size must be at most {HISTOGRAM_SIZE}")
    last = first_n_per_key(df, keys, size, *newest_first)
    # At most ``size`` values per key remain, so the list is bounded.
    lists = last.groupBy(*keys).agg(F.sort_array(F.collect_list(named(value))).alias("v"))
    n = F.size("v")

    def at(p: float) -> Column:
        return F.element_at("v", F.floor(n * p).cast("int") + 1)

    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return lists.select(
        *keys,
        n.cast("bigint").alias("count"),
        total.alias("sum"),
        F.element_at("v", 1).alias("min"),
        F.element_at("v", -1).alias("max"),
        (total / n).alias("avg"),
        at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
    )


def counter_totals(
    df: DataFrame, name: str, tags: str, value: str, updated_at: str | None = None
) -> DataFrame:
    """Sum per counter, keyed by the name and its sorted tags, and its last update."""
    totals = [F.sum(named(value)).alias("total")]
    if updated_at:
        totals.append(F.max(named(updated_at)).alias("last_updated"))
    return (
        df.withColumn("counter_key", tag_key(named(name), named(tags))).groupBy("counter_key").agg(*totals)
    )


def request_counters(requests: DataFrame) -> DataFrame:
    """(name, tags, increment) rows of API requests; a status from 400 on counts as an error.

    ``requests``: (method, path, status_code), the path already normalised.
    """
    tags = F.create_map(
        F.lit("method"), F.col("method"), F.lit("path"), F.col("path"),
        F.lit("status"), F.col("status_code").cast("string"),
    )
    names = F.array_compact(
        F.array(F.lit("api_requests_total"), F.when(F.col("status_code") >= 400, "api_requests_errors_total"))
    )
    return requests.select(F.explode(names).alias("name"), tags.alias("tags"), F.lit(1).alias("increment"))


def execution_counters(runs: DataFrame, kind: str, tag: str) -> DataFrame:
    """(name, tags, increment) rows of validations or ingestions.

    ``runs``: (label, success, records); ``kind`` is "validation" or "ingestion".
    """
    status = F.when(F.col("success"), "success").otherwise("failure")
    plain = F.create_map(F.lit(tag), F.col("label"))
    entries = [
        F.struct(
            F.lit(f"{kind}_executions_total").alias("name"),
            F.create_map(F.lit(tag), F.col("label"), F.lit("status"), status).alias("tags"),
            F.lit(1).cast("bigint").alias("increment"),
        ),
        F.struct(
            F.concat(F.lit(f"{kind}_"), status, F.lit("_total")).alias("name"),
            plain.alias("tags"),
            F.lit(1).cast("bigint").alias("increment"),
        ),
    ]
    if kind == "ingestion":
        entries.append(
            F.struct(
                F.lit("ingestion_records_processed_total").alias("name"),
                plain.alias("tags"),
                F.col("records").cast("bigint").alias("increment"),
            )
        )
    return runs.select(F.inline(F.array(*entries)))


def validation_metric_rows(summaries: DataFrame, environment: str) -> DataFrame:
    """Four metric rows per validation: checks passed and failed, duration, success rate.

    ``summaries``: (dataset_name, validation_type, passed, failed, duration_seconds).
    """
    passed, failed = F.col("passed").cast("double"), F.col("failed").cast("double")

    def row(name: str, value: Column, unit: str) -> Column:
        return F.struct(
            F.lit(name).alias("metric_name"), value.cast("double").alias("metric_value"),
            F.lit(unit).alias("unit"),
        )

    rows = F.array(
        row("ValidationChecksPassed", passed, "Count"),
        row("ValidationChecksFailed", failed, "Count"),
        row("ValidationDuration", F.col("duration_seconds"), "Seconds"),
        row("ValidationSuccessRate", safe_rate(passed, passed + failed), "Percent"),
    )
    return summaries.select(
        F.col("validation_type").alias("validation"), F.col("dataset_name").alias("dataset"),
        F.lit(environment).alias("environment"), F.inline(rows),
    )


def pipeline_metric_rows(values: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One metric row per named column, with the unit its name suggests."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric_name"), named(n).cast("double").alias("metric_value"))
            for n in names
        ]
    )
    return values.select(*keys, F.inline(rows)).withColumn("unit", metric_unit(F.col("metric_name")))


def quality_metric_rows(scores: DataFrame, score: str, categories: list[str], keys: list[str]) -> DataFrame:
    """The overall quality score of a dataset and one row per category score."""
    names = {score: "DataQualityScore", **{c: f"QualityScore_{c}" for c in categories}}
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("metric_name"), named(c).cast("double").alias("metric_value"))
            for c, label in names.items()
        ]
    )
    return scores.select(*keys, F.inline(rows)).withColumn("unit", F.lit("None"))


# --- validations and audits -------------------------------------------------------


def validation_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_validations"),
        _count("status", "passed", "passed_validations"),
        _count("status", "failed", "failed_validations"),
        _count("status", "warning", "warning_validations"),
        round_exact(F.coalesce(F.avg("pass_rate"), F.lit(0.0))).alias("average_pass_rate"),
    )


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Latest row count and time, and the mean pass rate per dataset."""
    newest = F.struct("created_at", "id")
    return df.groupBy("dataset_name").agg(
        F.max_by("total_records", newest).alias("row_count"),
        F.max_by("columns_checked", newest).alias("column_count"),
        round_exact(F.avg("pass_rate")).alias("validation_score"),
        F.max("created_at").alias("last_validated"),
    )


def audit_statistics(df: DataFrame) -> DataFrame:
    """(grouping, value, count, average time): by status, by type, and overall, in one pass."""
    label = (
        F.when((F.grouping("status") == 0), "status")
        .when((F.grouping("validation_type") == 0), "validation_type")
        .otherwise("all")
    )
    return (
        df.groupingSets(
            [["status"], ["validation_type"], []], "status", "validation_type"
        )
        .agg(
            label.alias("grouping"),
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)).alias("average_execution_time_ms"),
        )
        .select(
            "grouping",
            F.when(F.col("grouping") == "status", F.col("status"))
            .when(F.col("grouping") == "validation_type", F.col("validation_type"))
            .otherwise("all").alias("value"),
            "count",
            "average_execution_time_ms",
        )
    )


def failure_patterns(df: DataFrame, length: int = 100, top: int | None = 10) -> DataFrame:
    """Failures grouped by the start of their message, most frequent first.

    Up to 3 errors of each failure are shown until a pattern has 3 or more;
    three failures with errors are therefore always enough.
    """
    messages = df.filter(F.length("message") > 0).withColumn(
        "pattern", F.substring("message", 1, length)
    )
    counts = messages.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("validation_type", "id").alias("validation_type")
    )
    with_errors = messages.filter(F.size("errors") > 0)
    shown = first_n_per_key(with_errors, ["pattern"], 3, F.col("id")).groupBy("pattern").agg(
        F.sort_array(F.collect_list(F.struct("row_number", F.slice("errors", 1, 3).alias("e")))).alias("s")
    )
    none = F.array().cast("array<string>")

    def more(held: Column, i: int) -> Column:
        extra = F.when(F.size("s") >= i, F.element_at(F.col("s"), i)["e"]).otherwise(none)
        return F.when(F.size(held) < 3, F.concat(held, extra)).otherwise(held)

    examples = more(more(F.element_at(F.col("s"), 1)["e"], 2), 3)
    found = counts.join(shown.select("pattern", examples.alias("example_errors")), "pattern", "left")
    found = found.withColumn("example_errors", F.coalesce("example_errors", none))
    return found if top is None else found.orderBy(F.col("count").desc(), "pattern").limit(top)


# --- freshness and latency ----------------------------------------------------------


def freshness_summary(df: DataFrame) -> DataFrame:
    def average(column: str) -> Column:
        mean = F.avg(column)
        # An average of exactly zero is reported as absent.
        return F.when(mean != 0, round_exact(mean))

    return df.agg(
        F.count_distinct("dataset_name").alias("total_datasets"),
        _count("freshness_status", "healthy", "healthy_count"),
        _count("freshness_status", "warning", "warning_count"),
        _count("freshness_status", "critical", "critical_count"),
        _count("sla_status", "compliant", "sla_compliant_count"),
        _count("sla_status", "breached", "sla_breached_count"),
        average("ingestion_latency_seconds").alias("avg_ingestion_latency_seconds"),
        average("validation_latency_seconds").alias("avg_validation_latency_seconds"),
        round_exact(F.avg("dataset_age_hours")).alias("avg_dataset_age_hours"),
    )


def sla_batch(evaluations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Compliance over many SLA evaluations; 100 % when there are none."""
    grouped = evaluations.groupBy(*keys) if keys else evaluations.groupBy()
    compliant = F.count_if(F.col("sla_status") == "compliant")
    total = F.count(F.lit(1))
    return grouped.agg(
        total.alias("total_operations"),
        compliant.alias("compliant_count"),
        (total - compliant).alias("breached_count"),
        round_exact(safe_rate(compliant, total, 100.0)).alias("compliance_percentage"),
        round_exact(F.coalesce(F.avg("actual_latency_hours"), F.lit(0.0))).alias("avg_latency_hours"),
        round_exact(F.coalesce(F.max("breach_duration_hours"), F.lit(0.0))).alias("max_breach_hours"),
    )


def latency_stats(df: DataFrame) -> DataFrame:
    def of(function, column: str) -> Column:
        return F.coalesce(function(column), F.lit(0.0))

    return df.agg(
        of(F.avg, "ingestion_latency_seconds").alias("avg_ingestion"),
        of(F.avg, "validation_latency_seconds").alias("avg_validation"),
        of(F.max, "ingestion_latency_seconds").alias("max_ingestion"),
        of(F.max, "validation_latency_seconds").alias("max_validation"),
    )


# --- loads ----------------------------------------------------------------------------


def warehouse_statistics(processed: DataFrame, history: DataFrame) -> DataFrame:
    """Rows per dataset next to the load totals and the newest load of all."""
    loads = history.agg(
        F.count(F.lit(1)).alias("total_loads"),
        _count("status", "completed", "successful_loads"),
        _count("status", "failed", "failed_loads"),
        F.max_by("status", F.struct("started_at", "batch_id")).alias("latest_load_status"),
        F.max("started_at").alias("latest_load_timestamp"),
    )
    rows = processed.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("record_count"))
    summary = loads.select(F.struct("*").alias("s"))
    return rows.withColumn("s", summary.scalar()).select(
        "dataset_name", "record_count", "s.*"
    )


def dataset_health(processed: DataFrame, history: DataFrame) -> DataFrame:
    """Rows per dataset and validation status, with the newest load of the dataset."""
    rows = processed.groupBy("dataset_name", "validation_status").agg(F.count(F.lit(1)).alias("record_count"))
    newest = latest_per_key(history, ["dataset_name"], F.col("started_at").desc(), F.col("batch_id").desc())
    latest = newest.select(
        "dataset_name",
        F.col("started_at").alias("latest_load_timestamp"),
        F.col("status").alias("latest_load_status"),
        F.col("records_loaded").alias("latest_records_loaded"),
    )
    return rows.join(latest, "dataset_name", "left").fillna(0, ["latest_records_loaded"])


def dataset_load_summary(history: DataFrame) -> DataFrame:
    return (
        history.groupBy("dataset_name").agg(
            F.count(F.lit(1)).alias("total_loads"),
            _count("status", "completed", "completed_loads"),
            _count("status", "failed", "failed_loads"),
            F.sum("records_loaded").alias("total_records_loaded"),
            F.sum("records_failed").alias("total_records_failed"),
        )
        .withColumn("success_rate", _rate("completed_loads", "total_loads", "success_rate"))
    )


def load_statistics(audit: DataFrame) -> DataFrame:
    completed = F.col("load_status") == "completed"
    mean = F.avg(F.when(completed, F.col("execution_time_seconds")))
    return (
        audit.agg(
            F.count(F.lit(1)).alias("total_loads"),
            _count("load_status", "completed", "completed_loads"),
            _count("load_status", "failed", "failed_loads"),
            _count("load_status", "retrying", "retrying_loads"),
            round_exact(F.coalesce(mean, F.lit(0.0))).alias("average_execution_time_seconds"),
        )
        .withColumn("success_rate", round_exact(_rate("completed_loads", "total_loads", "r")))
    )


def dataset_completeness(processed: DataFrame, failed: DataFrame) -> DataFrame:
    """Batches and rows per dataset and day, with the failed loads of that day."""
    # Rows are counted per batch first: the second step sees one row per batch.
    batches = processed.groupBy("dataset_name", day_of(F.col("created_at")).alias("day"), "batch_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    loaded = batches.groupBy("dataset_name", "day").agg(
        F.count(F.lit(1)).alias("total_batches"), F.sum("n").alias("total_records")
    )
    failures = failed.groupBy("dataset_name", day_of(F.col("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("failed_loads_count")
    )
    return loaded.join(failures, ["dataset_name", "day"], "full_outer").fillna(
        0, ["total_batches", "total_records", "failed_loads_count"]
    )


def avg_quality(processed: DataFrame) -> DataFrame:
    return processed.groupBy("batch_id", "dataset_name").agg(
        F.coalesce(F.avg("data_quality_score"), F.lit(0.0)).alias("average_quality_score"),
        F.least(F.count(F.lit(1)), F.lit(10)).alias("sample_size"),
    )


def quality_sample(processed: DataFrame, keys: list[str], *order: Column, n: int = 10) -> DataFrame:
    """The first ``n`` loaded rows of every batch."""
    return first_n_per_key(processed, keys, n, *order)


def failed_loads_summary(failed: DataFrame) -> DataFrame:
    """Counts per failure reason; the totals are their sums."""
    waiting = ~F.col("can_retry") & F.col("retry_validated_at").isNull()
    return failed.groupBy("failure_reason").agg(
        F.count(F.lit(1)).alias("failed_loads"),
        F.count_if("can_retry").alias("ready_for_retry"),
        F.count_if(waiting).alias("needs_validation"),
        F.count_if(F.col("retry_count") >= 3).alias("max_retries_reached"),
    )


# --- retries ------------------------------------------------------------------------------


RETRY_STATES = ("pending", "in_progress", "completed", "failed", "cancelled")


def retry_statistics(retries: DataFrame) -> DataFrame:
    return retries.agg(
        F.count(F.lit(1)).alias("total_retries"), *[_count("retry_status", s, s) for s in RETRY_STATES]
    ).withColumn("success_rate", _rate("completed", "total_retries", "success_rate"))


def retry_metrics(retries: DataFrame) -> DataFrame:
    completed = F.col("retry_status") == "completed"
    return (
        retries.agg(
            F.count(F.lit(1)).alias("total_retries"),
            *[_count("retry_status", s, s) for s in RETRY_STATES],
            F.count_if(completed & (F.col("retry_count") == 1)).alias("_first"),
            round_exact(
                F.coalesce(F.avg(F.when(completed, F.col("retry_count"))), F.lit(0.0))
            ).alias("average_retry_count"),
        )
        .withColumn("success_rate", _rate("completed", "total_retries", "r"))
        .withColumn("first_attempt_success_rate", _rate("_first", "completed", "r"))
        .drop("_first")
    )


def user_retry_activity(retries: DataFrame) -> DataFrame:
    return (
        retries.groupBy(F.col("initiated_by").alias("user")).agg(
            F.count(F.lit(1)).alias("total_retries"),
            _count("retry_status", "completed", "successful_retries"),
            _count("retry_status", "failed", "failed_retries"),
            _count("retry_status", "pending", "pending_retries"),
        )
        .withColumn("success_rate", _rate("successful_retries", "total_retries", "r"))
    )


def bulk_retry_result(attempts: DataFrame, keys: list[str]) -> DataFrame:
    success = F.col("status").isin("passed", "warning")
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(success).alias("succeeded"),
        F.count_if(~success).alias("failed"),
    )


# --- runs, drift, contracts, logs -----------------------------------------------------------


def dag_summary(runs: DataFrame) -> DataFrame:
    success = F.col("state") == "success"
    return (
        runs.groupBy("dag_id").agg(
            F.count(F.lit(1)).alias("total_executions"),
            _count("state", "success", "successful"),
            _count("state", "failed", "failed"),
            _count("state", "running", "running"),
            F.coalesce(F.avg(F.when(success, F.col("duration_seconds"))), F.lit(0.0))
            .alias("average_duration_seconds"),
        )
        .withColumn("success_rate", _rate("successful", "total_executions", "r"))
    )


def pipeline_summary(pipelines: DataFrame, runs: DataFrame, first: int = 10, last: int = 5) -> DataFrame:
    """(state, runs) over the last runs of the first pipelines, with pipeline totals.

    ``pipelines``: (dag_id, is_active, is_paused).
    """
    totals = pipelines.agg(
        F.count(F.lit(1)).alias("total_pipelines"),
        F.count_if(F.col("is_active") & ~F.col("is_paused")).alias("active_pipelines"),
        F.count_if("is_paused").alias("paused_pipelines"),
    ).select(F.struct("*").alias("t"))
    chosen = pipelines.orderBy("dag_id").limit(first).select("dag_id")
    # ``first`` pipelines at most: a broadcast of fixed size.
    recent = first_n_per_key(
        runs.join(F.broadcast(chosen), "dag_id", "left_semi"), ["dag_id"], last,
        F.col("execution_date").desc(), F.col("dag_run_id").desc(),
    )
    states = recent.groupBy("state").agg(F.count(F.lit(1)).alias("recent_runs"))
    return states.withColumn("t", totals.scalar()).select("state", "recent_runs", "t.*")


def drift_alerts(history: DataFrame) -> DataFrame:
    open_ = ~F.col("acknowledged")
    newest = F.struct("detected_at", "current_version")

    def severity(name: str) -> Column:
        return F.count_if(open_ & (F.col("severity") == name)).alias(f"{name}_count")

    return history.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("total_drifts"),
        F.count_if(open_).alias("unacknowledged_count"),
        severity("critical"), severity("warning"), severity("info"),
        F.max_by("drift_type", newest).alias("latest_drift_type"),
        F.max("detected_at").alias("latest_detected_at"),
    )


def contract_summary(results: DataFrame) -> DataFrame:
    return (
        results.agg(
            F.count(F.lit(1)).alias("total_validations"),
            F.count_if("is_valid").alias("passed"),
            F.count_if(~F.col("is_valid")).alias("failed"),
        )
        .withColumn("success_rate", round_exact(_rate("passed", "total_validations", "r")))
    )


def log_stats(logs: DataFrame) -> DataFrame:
    """(grouping, value, lines): total, per level and per logger in one pass."""
    level = F.coalesce("level", F.lit("UNKNOWN"))
    logger = F.coalesce("logger", F.lit("UNKNOWN"))
    rows = F.array(
        F.struct(F.lit("total").alias("grouping"), F.lit("all").alias("value")),
        F.struct(F.lit("level").alias("grouping"), level.alias("value")),
        F.struct(F.lit("logger").alias("grouping"), logger.alias("value")),
    )
    return logs.select(F.inline(rows)).groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("lines"))


def file_bytes(files: DataFrame) -> DataFrame:
    """Bytes of the files behind a frame read with its ``_metadata``."""
    return (
        files.select("_metadata.file_path", "_metadata.file_size").distinct()
        .agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("file_size_bytes"))
    )


def hit_rate(events: DataFrame, keys: list[str], hit: str = "is_hit") -> DataFrame:
    """Hits and misses with the share of hits; 0 when there were no lookups."""
    grouped = events.groupBy(*keys).agg(
        F.count_if(named(hit)).alias("hits"), F.count_if(~named(hit)).alias("misses")
    )
    return grouped.withColumn("hit_rate", safe_rate(F.col("hits"), F.col("hits") + F.col("misses")))


def health_trend(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(
        F.avg("overall_score").alias("average_score"), F.count(F.lit(1)).alias("points")
    )
