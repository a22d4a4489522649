"""Pipeline runs: upsert of run events, log batches, lineage, whole pipelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordering import ordered_row_number
from tidewatch.functions.results import Check, aggregate_results, error_struct, run_checks
from tidewatch.functions.scalars import micros, seconds_between, text_array, validator_type
from tidewatch.operators import checksums, validators

LOG_BATCH = 100


def run_upsert(events: DataFrame) -> DataFrame:
    """Current state of each run: for every field the newest event that sets it.

    ``events``: (dag_run_id, event_time, dag_id, state, start_date, end_date,
    total_tasks, completed_tasks, failed_tasks), NULL where not set.
    """
    def newest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("event_time"))).alias(column)

    fields = [
        "dag_id", "state", "start_date", "end_date", "total_tasks", "completed_tasks", "failed_tasks"
    ]
    return events.groupBy("dag_run_id").agg(*[newest(c) for c in fields]).withColumn(
        "duration_seconds", seconds_between(F.col("start_date"), F.col("end_date"))
    )


def merge_runs(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored runs (``run_upsert`` with the ``event_time`` of their newest event) brought up to date by later events, and new runs.

    Only the rows given are read: of a stored table those partitions that hold a run with an event.
    """
    every = stored.select(*events.columns).unionByName(events)
    newest = every.groupBy("dag_run_id").agg(F.max("event_time").alias("event_time"))
    return run_upsert(every).join(newest, "dag_run_id")


def log_batches(logs: DataFrame, stream: str, at: str, tie: Column, size: int = LOG_BATCH) -> DataFrame:
    """Log events per stream in time order, formatted and cut into batches of ``size``."""
    numbered = ordered_row_number(logs, [stream], micros(F.col(at)), tie, "_position")
    return numbered.select(
        stream,
        F.floor((F.col("_position") - 1) / size).alias("batch"),
        (micros(F.col(at)) / 1000).cast("bigint").alias("timestamp_ms"),
        F.concat(F.lit("["), F.coalesce("level", F.lit("INFO")), F.lit("] "), F.coalesce("message", F.lit("")))
        .alias("message"),
    )


def with_lineage_columns(df: DataFrame, job: str, at: Column | None = None) -> DataFrame:
    return df.withColumn(
        "processed_at", F.current_timestamp() if at is None else at
    ).withColumn("processing_job", F.lit(job))


def lineage_record(edges: DataFrame) -> DataFrame:
    """Upstream datasets and transformations per target; depth is the number of upstreams.

    ``edges``: (target_dataset, upstream_dataset, transformation). Repeated
    edges are reduced to distinct ones on the map side, so the lists hold
    dataset names, not rows.
    """
    distinct = edges.groupBy("target_dataset", "upstream_dataset").agg(
        F.array_sort(F.collect_set("transformation")).alias("t")
    )
    return distinct.groupBy("target_dataset").agg(
        F.array_sort(F.collect_list("upstream_dataset")).alias("upstream_datasets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("transformations"),
        F.count(F.lit(1)).alias("lineage_depth"),
    )


def validate_with_defaults(
    df: DataFrame,
    dataset_name: str,
    contract: Sequence[Mapping] | None = None,
    null_threshold: float = 5.0,
    expected_checksum: str | None = None,
    checksum_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Result rows of the standard checks: columns, schema, nulls, types, checksum.

    ``contract``: column entries with name, data_type and required. The schema
    check accepts a Spark type name as it is and a logical name (``integer``)
    for any type of its family. All checks share one aggregation of the table.
    A check that cannot be set up becomes an error row and the others go on.
    """
    checks: list[Check] = []
    declared = {c["name"]: c.get("data_type", c.get("type")) for c in contract or ()}

    def attempt(name: str, build: Callable[[], Check]) -> None:
        try:
            checks.append(build())
        except Exception as problem:  # noqa: BLE001 - any failure is reported as a row
            checks.append(Check([], [], error_struct(name, f"Validator execution failed: {problem}")))

    names = text_array

    def existence() -> Check:
        required = {c["name"] for c in contract if c.get("required", True)}
        optional = set(declared) - required
        actual = set(df.columns)
        verdict = validators.existence_verdict(
            F.lit(len(required)), names(sorted(required - actual)), names(sorted(actual - set(declared))),
            names(sorted(optional & actual)), F.col("total"),
        )
        return Check([], [], verdict)

    def schema() -> Check:
        wrong = [
            c for c, kind in declared.items()
            if c in df.columns and df.schema[c].dataType.simpleString() != kind
            and not validators.type_matches(df, c, kind)
        ]
        verdict = validators.schema_verdict(
            names([]), names(wrong), names([]), F.lit(len(df.columns)), F.col("total")
        )
        return Check([], [], verdict)

    if contract:
        attempt("ColumnExistenceValidator", existence)
        attempt("SchemaValidator", schema)
    attempt("NullValidator", lambda: validators.null_plan(df, max_null_percentage=null_threshold))
    if contract:
        attempt("DatatypeValidator", lambda: validators.datatype_plan(df, declared))
    if expected_checksum or checksum_columns:
        attempt(
            "ChecksumValidator", lambda: checksums.checksum_plan(df, expected_checksum, checksum_columns)
        )
    rows = run_checks(df, checks)
    return rows.select(
        F.lit(dataset_name).alias("dataset_name"), *rows.columns,
        F.lit(None).cast("double").alias("execution_time_ms"),
    )


def validation_summary(results: DataFrame) -> DataFrame:
    return aggregate_results(results, ["dataset_name"])


def audit_rows(results: DataFrame, triggered_by: str, environment: str, at: Column) -> DataFrame:
    """Audit rows of result rows; the errors become one text."""
    return results.select(
        "dataset_name",
        validator_type(F.col("validator_name")).alias("validation_type"),
        "status", "total_records", "failed_records", "pass_rate", "validator_name",
        F.lit(triggered_by).alias("triggered_by"),
        F.lit(environment).alias("environment"),
        F.when(F.size("errors") > 0, F.array_join("errors", "; ")).alias("error_summary"),
        at.alias("created_at"),
    )


LOG_FIELDS = [
    "validation_type", "status", "total_records", "failed_records", "pass_rate", "validator_name", "message"
]


def validation_log_rows(results: DataFrame, at: Column) -> DataFrame:
    """Log rows: one per validator, and one with the overall outcome per dataset.

    The results of a dataset, one entry per validator, are gathered next to
    their summary, so the checks behind them run once.
    """
    entry = F.struct(
        validator_type(F.col("validator_name")).alias("validation_type"), *LOG_FIELDS[1:]
    )
    summary = aggregate_results(results, ["dataset_name"], "position", F.collect_list(entry).alias("entries"))
    overall = F.struct(
        F.lit("aggregated").alias("validation_type"),
        F.col("overall_status").alias("status"),
        F.col("total_records"),
        F.lit(0).cast("bigint").alias("failed_records"),
        F.when(F.col("overall_passed"), 100.0).otherwise(0.0).alias("pass_rate"),
        F.lit("ValidationAggregator").alias("validator_name"),
        F.format_string(
            "Executed %d validators: %d passed, %d failed, %d warnings",
            "total_validators", "passed_validators", "failed_validators", "warning_validators",
        ).alias("message"),
    )
    rows = F.concat("entries", F.array(overall))
    return summary.select("dataset_name", F.inline(rows)).select("dataset_name", *LOG_FIELDS, at.alias("created_at"))


def revalidation_rows(results: DataFrame) -> DataFrame:
    """Log row of a repeated validation: passed only if every validator passed."""
    failures = F.collect_list(F.when(~F.col("passed"), F.col("message")))
    summary = aggregate_results(
        results, ["dataset_name"], "position", F.array_sort(failures).alias("errors")
    )
    return summary.select(
        "dataset_name",
        F.when(F.col("overall_passed"), "passed").otherwise("failed").alias("status"),
        "total_records",
        F.col("failed_validators").alias("failed_records"),
        (F.col("passed_validators") / F.col("total_validators") * 100.0).alias("pass_rate"),
        F.format_string(
            "Validation re-executed: %d/%d validators passed", "passed_validators", "total_validators"
        ).alias("message"),
        "errors",
    )
