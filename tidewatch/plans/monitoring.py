"""Queries: filters, pages, top lists and roll-ups over monitoring tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.ordering import first_n_per_key, latest_per_key
from tidewatch.operators import filters as flt
from tidewatch.operators import freshness, retries, rollups, runs
from tidewatch.plans.catalog import query
from tidewatch.plans.common import EVENTS_END, ORDERS_END, at, tidy
from tidewatch.session import work_path
from tidewatch.sources import snapshots
from tidewatch.sources.textindex import TextIndex

OT, ET = f"TIMESTAMP '{ORDERS_END}'", f"TIMESTAMP '{EVENTS_END}'"
AUDIT = ["id", "dataset_name", "validation_type", "status", "total_records", "failed_records", "created_at"]
AUDIT_SQL = ", ".join(AUDIT)


def _n(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


# --- audits and validations -------------------------------------------------------

AUDIT_WHERE = """contains(lower(dataset_name), 'dataset_') AND validation_type = 'null' AND environment = 'prod'
  AND created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at <= TIMESTAMP '2000-12-31 00:00:00'"""


def _audit_filter(t):
    return flt.apply_filters(
        t.audit_logs,
        ("dataset_name", "contains", "DATASET_"),
        ("validation_type", "eq", "null"),
        ("status", "eq", None),
        ("created_at", "ge", at("1996-01-01 00:00:00")),
        ("created_at", "le", at("2000-12-31 00:00:00")),
        ("triggered_by", "eq", None),
        ("environment", "eq", "prod"),
    )


@query(
    "audit_history",
    f"SELECT {AUDIT_SQL} FROM @audit_logs WHERE {AUDIT_WHERE} ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20",
)
def audit_history(t):
    return flt.sort_page(_audit_filter(t), "no_such_column", ["id"], True, 100, 20).select(*AUDIT)


@query("audit_count", f"SELECT count(*) AS total_count FROM @audit_logs WHERE {AUDIT_WHERE}")
def audit_count(t):
    return flt.count_rows(_audit_filter(t))


@query(
    "sort_page",
    f"SELECT {AUDIT_SQL} FROM @audit_logs ORDER BY failed_records, id LIMIT 50 OFFSET 150",
)
def sort_page(t):
    return flt.sort_page(t.audit_logs, "failed_records", ["id"], False, 50, 150).select(*AUDIT)


@query("page_info", f"SELECT count(*) AS total_count, 120 < count(*) AS has_more FROM @audit_logs WHERE {AUDIT_WHERE}")
def page_info(t):
    return flt.page_info(_audit_filter(t), limit=100, offset=20)


@query("recent_n", f"SELECT {AUDIT_SQL} FROM @audit_logs ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_n(t):
    return flt.recent(t.audit_logs.select(*AUDIT), "created_at", ["id"], 10)


@query(
    "retention_delete",
    f"""SELECT {_n(f"created_at < {OT} - INTERVAL 90 DAY", 'deleted_count')},
      {_n(f"created_at >= {OT} - INTERVAL 90 DAY", 'kept_count')} FROM @audit_logs""",
)
def retention_delete(t):
    return flt.retention_counts(t.audit_logs, "created_at", at(ORDERS_END), 90)


UNDATED = "SELECT id, metric_name, CASE WHEN dataset_name IS NOT NULL THEN timestamp END AS timestamp FROM @metrics"


@query("retention_kept", f"SELECT * FROM ({UNDATED}) WHERE timestamp >= {ET} - INTERVAL 10 DAY OR timestamp IS NULL")
def retention_kept(t):
    return flt.retention_split(t.sql(UNDATED), "timestamp", at(EVENTS_END), 10)[0]


@query("retention_in_place", f"SELECT * FROM ({UNDATED}) WHERE timestamp >= {ET} - INTERVAL 10 DAY OR timestamp IS NULL")
def retention_in_place(t):
    """Retention on a stored table by day: old days go unread, the day of the cutoff is rewritten."""
    store = snapshots.Snapshots(t.spark, work_path(t.spark, "store"))
    day = F.col("timestamp").cast("date").cast("string")
    store.write("metrics", t.sql(UNDATED), day)
    snapshots.expire(store, "metrics", "timestamp", at(EVENTS_END) - F.expr("INTERVAL 10 DAYS"), day)
    return store.read("metrics")


@query(
    "integrity_violations",
    """SELECT id, dataset_name, status, failed_records, created_at FROM @audit_logs
      WHERE status = 'failed' AND validation_type = 'schema' AND CAST(created_at AS DATE) = DATE '1998-03-07'""",
)
def integrity_violations(t):
    return flt.integrity_violations(
        t.audit_logs, validation_type="schema", status="failed", day="1998-03-07"
    ).select("id", "dataset_name", "status", "failed_records", "created_at")


@query(
    "integrity_violation_totals",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS violations, CAST(sum(failed_records) AS BIGINT) AS total_failed_records
      FROM @audit_logs WHERE status = 'failed' GROUP BY 1""",
)
def integrity_violation_totals(t):
    return flt.integrity_violations(t.audit_logs, status="failed").groupBy(
        F.col("created_at").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("violations"), F.sum("failed_records").alias("total_failed_records"))


@query(
    "validation_history",
    """SELECT id, dataset_name, validation_type, status, created_at AS executed_at, total_records, failed_records,
        round(pass_rate, 4) AS pass_rate FROM @audit_logs
      WHERE dataset_name = 'Dataset_3' AND validation_type = 'datatype' AND status = 'warning'""",
)
def validation_history(t):
    rows = flt.apply_filters(
        t.audit_logs, ("dataset_name", "eq", "Dataset_3"), ("validation_type", "eq", "datatype"),
        ("status", "eq", "warning"),
    )
    return tidy(
        rows.select(
            "id", "dataset_name", "validation_type", "status", F.col("created_at").alias("executed_at"),
            "total_records", "failed_records", "pass_rate",
        )
    )


@query(
    "failed_validations",
    f"""SELECT {AUDIT_SQL} FROM @audit_logs WHERE status IN ('failed', 'error') AND dataset_name = 'Dataset_1'
      ORDER BY created_at DESC, id DESC LIMIT 100""",
)
def failed_validations(t):
    rows = flt.apply_filters(retries.failed_validations(t.audit_logs), ("dataset_name", "eq", "Dataset_1"))
    return flt.recent(rows.select(*AUDIT), "created_at", ["id"], 100)


@query("lookup_by_id", f"SELECT {AUDIT_SQL} FROM @audit_logs WHERE id = 1234")
def lookup_by_id(t):
    return flt.apply_filters(t.audit_logs, ("id", "eq", 1234)).select(*AUDIT)


@query("lookup", "SELECT dag_id, dag_run_id, state, start_date FROM @dag_runs WHERE dag_run_id = 'run_99'")
def lookup(t):
    rows = flt.apply_filters(t.dag_runs, ("dag_run_id", "eq", "run_99"))
    return rows.select("dag_id", "dag_run_id", "state", "start_date")


@query("lookup_by_batch", "SELECT * FROM @load_history WHERE batch_id = 'batch_77'")
def lookup_by_batch(t):
    return flt.apply_filters(t.load_history, ("batch_id", "eq", "batch_77"))


VALIDATION_METRICS = f"""SELECT count(*) AS total_validations, {_n("status = 'passed'", 'passed_validations')},
  {_n("status = 'failed'", 'failed_validations')}, {_n("status = 'warning'", 'warning_validations')},
  round(coalesce(avg(pass_rate), 0), 2) AS average_pass_rate FROM @audit_logs"""


@query("validation_metrics", f"{VALIDATION_METRICS} WHERE created_at >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY")
def validation_metrics(t):
    recent = flt.since_midnight_days(t.audit_logs, "created_at", at("2001-08-02 17:30:00"), 365)
    return rollups.validation_metrics(recent)


@query(
    "dataset_statistics",
    """SELECT dataset_name, arg_max(total_records, (created_at, id)) AS row_count,
        arg_max(columns_checked, (created_at, id)) AS column_count, round(avg(pass_rate), 2) AS validation_score,
        max(created_at) AS last_validated FROM @audit_logs GROUP BY 1""",
)
def dataset_statistics(t):
    return rollups.dataset_statistics(t.audit_logs)


@query(
    "audit_statistics",
    """SELECT 'status' AS "grouping", status AS "value", count(*) AS "count",
        round(coalesce(avg(execution_time_ms), 0), 4) AS average_execution_time_ms FROM @audit_logs GROUP BY status
      UNION ALL SELECT 'validation_type', validation_type, count(*), round(coalesce(avg(execution_time_ms), 0), 4)
        FROM @audit_logs GROUP BY validation_type
      UNION ALL SELECT 'all', 'all', count(*), round(avg(execution_time_ms), 4) FROM @audit_logs""",
)
def audit_statistics(t):
    return tidy(rollups.audit_statistics(t.audit_logs))


OPTIONS = ["dataset_name", "validation_type", "status", "triggered_by", "environment"]


@query(
    "filter_options",
    " UNION ALL ".join(
        f"""SELECT DISTINCT '{c}' AS field, {c} AS "value" FROM @audit_logs WHERE {c} <> ''""" for c in OPTIONS
    ),
)
def filter_options(t):
    return flt.filter_options(t.audit_logs, OPTIONS)


FAILURES = """SELECT *, substr(message, 1, 100) AS pattern FROM @audit_logs
  WHERE status IN ('failed', 'error') AND message <> ''"""
PATTERNS = f"""WITH f AS ({FAILURES}),
  c AS (SELECT pattern, count(*) AS "count", arg_min(validation_type, id) AS validation_type FROM f GROUP BY 1),
  r AS (SELECT pattern, errors[1:3] AS e, row_number() OVER (PARTITION BY pattern ORDER BY id) AS k FROM f WHERE len(errors) > 0),
  s AS (SELECT pattern, max(e) FILTER (WHERE k = 1) AS e1, max(e) FILTER (WHERE k = 2) AS e2, max(e) FILTER (WHERE k = 3) AS e3
    FROM r WHERE k <= 3 GROUP BY 1),
  u AS (SELECT pattern, CASE WHEN len(e1) < 3 THEN list_concat(e1, coalesce(e2, [])) ELSE e1 END AS h, e3 FROM s)
  SELECT c.pattern, "count", validation_type, coalesce(array_to_string(
    CASE WHEN len(h) < 3 THEN list_concat(h, coalesce(e3, [])) ELSE h END, ';'), '') AS example_errors
  FROM c LEFT JOIN u ON c.pattern = u.pattern"""


@query("failure_patterns", f'{PATTERNS} ORDER BY "count" DESC, c.pattern LIMIT 10')
def failure_patterns(t):
    return tidy(rollups.failure_patterns(retries.failed_validations(t.audit_logs)))


@query("failure_patterns_all", PATTERNS)
def failure_patterns_all(t):
    return tidy(rollups.failure_patterns(retries.failed_validations(t.audit_logs), top=None))


# --- metrics ---------------------------------------------------------------------------

M_WHERE = f"timestamp >= {ET} - INTERVAL 20 DAY AND timestamp <= {ET}"


def _metric_window(t, **equals):
    start = F.timestamp_add("DAY", F.lit(-20), at(EVENTS_END))
    return rollups.metrics_window(t.metrics, start, at(EVENTS_END), **equals)


@query(
    "metrics_list",
    f"""SELECT id, metric_name, metric_value, timestamp FROM @metrics WHERE {M_WHERE} AND metric_type = 'counter'
      AND dataset_name = 'ds2' ORDER BY timestamp DESC, id DESC LIMIT 100""",
)
def metrics_list(t):
    rows = _metric_window(t, metric_type="counter", dataset_name="ds2")
    return flt.recent(rows.select("id", "metric_name", "metric_value", "timestamp"), "timestamp", ["id"], 100)


@query(
    "metrics_count",
    f"SELECT count(*) AS total_count FROM @metrics WHERE {M_WHERE} AND validation_type = 'view'",
)
def metrics_count(t):
    return flt.count_rows(_metric_window(t, validation_type="view"))


def _totals(group: str, extra: str = "", where: str = M_WHERE) -> str:
    return f"""SELECT metric_name, {group}, round(sum(metric_value), 4) AS total, count(*) AS "count",
      round(avg(metric_value), 4) AS average {extra} FROM @metrics WHERE {where} GROUP BY 1, 2"""


@query(
    "metrics_daily",
    _totals("CAST(timestamp AS DATE) AS \"date\"", ", min(metric_value) AS minimum, max(metric_value) AS maximum"),
)
def metrics_daily(t):
    return tidy(rollups.metrics_daily(_metric_window(t)))


@query("metrics_hourly", _totals("date_trunc('hour', timestamp) AS hour"))
def metrics_hourly(t):
    return tidy(rollups.metrics_hourly(_metric_window(t)))


@query("metrics_by_type", _totals("validation_type", where=f"{M_WHERE} AND validation_type IS NOT NULL"))
def metrics_by_type(t):
    return tidy(rollups.metrics_by(_metric_window(t), "validation_type"))


@query("metrics_by_dataset", _totals("dataset_name", where=f"{M_WHERE} AND dataset_name IS NOT NULL"))
def metrics_by_dataset(t):
    return tidy(rollups.metrics_by(_metric_window(t), "dataset_name"))


_COUNTED = (
    "validation_success", "validation_failure", "validation_warning", "ingestion_execution", "ingestion_success",
    "ingestion_failure",
)


@query(
    "metrics_summary",
    f"""WITH s AS (SELECT {", ".join(_n(f"metric_name = '{n}'", n) for n in _COUNTED)},
        round(coalesce(avg(execution_time) FILTER (WHERE metric_name = 'validation_duration'), 0), 2) AS avg_validation_duration_ms,
        round(coalesce(avg(execution_time) FILTER (WHERE metric_name = 'ingestion_duration'), 0), 2) AS avg_ingestion_duration_ms,
        round(coalesce(avg(execution_time) FILTER (WHERE metric_name = 'api_request_duration'), 0), 2) AS avg_api_duration_ms
        FROM @metrics WHERE {M_WHERE})
      SELECT *, validation_success + validation_failure + validation_warning AS validation_total,
        round(validation_success * 1e2 / (validation_success + validation_failure + validation_warning), 2) AS validation_success_rate,
        round(ingestion_success * 1e2 / (ingestion_success + ingestion_failure), 2) AS ingestion_success_rate FROM s""",
)
def metrics_summary(t):
    return rollups.metrics_summary(_metric_window(t))


@query(
    "histogram_stats",
    """WITH l AS (SELECT metric_name, list_sort(list(metric_value)) AS v FROM (SELECT metric_name, metric_value,
        row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, id DESC) AS k FROM @metrics) WHERE k <= 1000 GROUP BY 1)
      SELECT metric_name, len(v) AS "count", round(list_sum(v), 4) AS sum, v[1] AS min, v[len(v)] AS max,
        round(list_sum(v) / len(v), 4) AS avg, v[CAST(floor(len(v) * 5e-1) AS INT) + 1] AS p50,
        v[CAST(floor(len(v) * 95e-2) AS INT) + 1] AS p95, v[CAST(floor(len(v) * 99e-2) AS INT) + 1] AS p99 FROM l""",
)
def histogram_stats(t):
    newest = (F.col("timestamp").desc(), F.col("id").desc())
    return tidy(rollups.histogram_stats(t.metrics, ["metric_name"], "metric_value", *newest))


@query(
    "counter_totals",
    """SELECT metric_name || '{' || CASE WHEN dataset_name IS NULL THEN '' ELSE 'dataset=' || dataset_name || ',' END
        || 'type=' || metric_type || '}' AS counter_key, CAST(count(*) AS BIGINT) AS total, max(timestamp) AS last_updated
      FROM @metrics GROUP BY 1""",
)
def counter_totals(t):
    tags = F.map_filter(
        F.create_map(F.lit("type"), F.col("metric_type"), F.lit("dataset"), F.col("dataset_name")),
        lambda _, v: v.isNotNull(),
    )
    counted = t.metrics.select("metric_name", tags.alias("tags"), F.lit(1).alias("increment"), "timestamp")
    return rollups.counter_totals(counted, "metric_name", "tags", "increment", "timestamp")


NORMAL_PATH = "regexp_replace(path, '/[0-9]+', '/:id', 'g')"


@query(
    "api_counters",
    f"""WITH r AS (SELECT method, {NORMAL_PATH} AS path, status_code FROM @requests),
      c AS (SELECT 'api_requests_total' AS name, * FROM r
        UNION ALL SELECT 'api_requests_errors_total', * FROM r WHERE status_code >= 400)
      SELECT name || '{{method=' || method || ',path=' || path || ',status=' || status_code || '}}' AS counter_key,
        count(*) AS total FROM c GROUP BY 1""",
)
def api_counters(t):
    from tidewatch.functions.scalars import normalize_path

    requests = t.requests.withColumn("path", normalize_path(F.col("path")))
    return rollups.counter_totals(rollups.request_counters(requests), "name", "tags", "increment")


@query(
    "execution_counters",
    """WITH r AS (SELECT dataset_name AS d, status = 'completed' AS ok, records_loaded AS n FROM @load_history),
      c AS (SELECT 'ingestion_executions_total{dataset=' || d || ',status=' || CASE WHEN ok THEN 'success' ELSE 'failure' END || '}' AS k, 1 AS n FROM r
        UNION ALL SELECT 'ingestion_' || CASE WHEN ok THEN 'success' ELSE 'failure' END || '_total{dataset=' || d || '}', 1 FROM r
        UNION ALL SELECT 'ingestion_records_processed_total{dataset=' || d || '}', n FROM r)
      SELECT k AS counter_key, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""",
)
def execution_counters(t):
    done = t.load_history.select(
        F.col("dataset_name").alias("label"), (F.col("status") == "completed").alias("success"),
        F.col("records_loaded").alias("records"),
    )
    rows = rollups.execution_counters(done, "ingestion", "dataset")
    return rollups.counter_totals(rows, "name", "tags", "increment")


SUMMARIES = f"""SELECT dataset_name, validation_type, {_n("status = 'passed'", 'passed')},
  {_n("status <> 'passed'", 'failed')}, sum(execution_time_ms) / 1000 AS duration_seconds FROM @audit_logs GROUP BY 1, 2"""


@query(
    "validation_metric_rows",
    " UNION ALL ".join(
        f"""SELECT validation_type AS validation, dataset_name AS dataset, 'local' AS environment,
          '{name}' AS metric_name, round({value}, 4) AS metric_value, '{unit}' AS unit FROM ({SUMMARIES})"""
        for name, value, unit in (
            ("ValidationChecksPassed", "passed * 1e0", "Count"),
            ("ValidationChecksFailed", "failed * 1e0", "Count"),
            ("ValidationDuration", "duration_seconds", "Seconds"),
            ("ValidationSuccessRate", "passed * 1e2 / (passed + failed)", "Percent"),
        )
    ),
)
def validation_metric_rows(t):
    passed = F.col("status") == "passed"
    summaries = t.audit_logs.groupBy("dataset_name", "validation_type").agg(
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"),
        (F.sum("execution_time_ms") / 1000).alias("duration_seconds"),
    )
    return tidy(rollups.validation_metric_rows(summaries, "local"))


@query(
    "pipeline_metric_rows",
    """WITH h AS (SELECT dataset_name, sum(records_loaded) * 1e0 AS records_loaded, avg(execution_duration_ms) AS mean_duration,
        count(*) * 1e0 AS loads FROM @load_history GROUP BY 1)
      SELECT dataset_name, 'records_loaded' AS metric_name, round(records_loaded, 4) AS metric_value, 'Count' AS unit FROM h
      UNION ALL SELECT dataset_name, 'mean_duration', round(mean_duration, 4), 'Seconds' FROM h
      UNION ALL SELECT dataset_name, 'loads', loads, 'None' FROM h""",
)
def pipeline_metric_rows(t):
    values = t.load_history.groupBy("dataset_name").agg(
        F.sum("records_loaded").alias("records_loaded"),
        F.avg("execution_duration_ms").alias("mean_duration"),
        F.count(F.lit(1)).alias("loads"),
    )
    return tidy(rollups.pipeline_metric_rows(values, ["records_loaded", "mean_duration", "loads"], ["dataset_name"]))


@query(
    "hit_rate",
    """SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS hits,
        count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS misses,
        round(count(*) FILTER (WHERE event_type IN ('click', 'view')) * 1e2 / count(*), 4) AS hit_rate
      FROM @events GROUP BY 1""",
)
def hit_rate(t):
    lookups = t.events.withColumn("is_hit", F.col("event_type").isin("click", "view"))
    return tidy(rollups.hit_rate(lookups, ["user_id"]))


# --- freshness and service levels ---------------------------------------------------------


@query(
    "freshness_list",
    """SELECT id, dataset_name, ingestion_timestamp, freshness_status FROM @freshness WHERE dataset_name = 'orders'
      AND freshness_status = 'warning' AND sla_status = 'compliant' AND ingestion_timestamp >= TIMESTAMP '2024-01-10 00:00:00'
      ORDER BY ingestion_timestamp DESC, id DESC LIMIT 100""",
)
def freshness_list(t):
    rows = _fresh(t).select("id", "dataset_name", "ingestion_timestamp", "freshness_status")
    return flt.recent(rows, "ingestion_timestamp", ["id"], 100)


def _fresh(t):
    return flt.apply_filters(
        t.freshness, ("dataset_name", "eq", "orders"), ("freshness_status", "eq", "warning"),
        ("sla_status", "eq", "compliant"), ("ingestion_timestamp", "ge", at("2024-01-10 00:00:00")),
    )


@query(
    "freshness_count",
    """SELECT count(*) AS total_count FROM @freshness WHERE dataset_name = 'orders'
      AND freshness_status = 'warning' AND sla_status = 'compliant' AND ingestion_timestamp >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def freshness_count(t):
    return flt.count_rows(_fresh(t))


@query(
    "freshness_summary",
    f"""SELECT count(DISTINCT dataset_name) AS total_datasets, {_n("freshness_status = 'healthy'", 'healthy_count')},
      {_n("freshness_status = 'warning'", 'warning_count')}, {_n("freshness_status = 'critical'", 'critical_count')},
      {_n("sla_status = 'compliant'", 'sla_compliant_count')}, {_n("sla_status = 'breached'", 'sla_breached_count')},
      round(avg(ingestion_latency_seconds), 2) AS avg_ingestion_latency_seconds,
      round(avg(validation_latency_seconds), 2) AS avg_validation_latency_seconds,
      round(avg(dataset_age_hours), 2) AS avg_dataset_age_hours FROM @freshness""",
)
def freshness_summary(t):
    return rollups.freshness_summary(t.freshness)


@query(
    "latency_stats",
    """SELECT round(avg(ingestion_latency_seconds), 4) AS avg_ingestion, round(avg(validation_latency_seconds), 4) AS avg_validation,
      round(max(ingestion_latency_seconds), 4) AS max_ingestion, round(max(validation_latency_seconds), 4) AS max_validation FROM @freshness""",
)
def latency_stats(t):
    return tidy(rollups.latency_stats(t.freshness))


@query(
    "time_series",
    """SELECT id, ingestion_timestamp, dataset_age_hours FROM @freshness
      WHERE dataset_name = 'customers' ORDER BY ingestion_timestamp, id""",
)
def time_series(t):
    rows = flt.apply_filters(t.freshness, ("dataset_name", "eq", "customers"))
    return rows.select("id", "ingestion_timestamp", "dataset_age_hours").orderBy("ingestion_timestamp", "id")


SLA_BATCH = """SELECT {key} count(*) AS total_operations, count(*) FILTER (WHERE sla_status = 'compliant') AS compliant_count,
  count(*) - count(*) FILTER (WHERE sla_status = 'compliant') AS breached_count,
  {two[0]} count(*) FILTER (WHERE sla_status = 'compliant') * 1e2 / count(*) {two[1]} AS compliance_percentage,
  {two[0]} avg(dataset_age_hours) {two[1]} AS avg_latency_hours,
  {two[0]} coalesce(max(CASE WHEN sla_status = 'breached' THEN dataset_age_hours - 22 END), 0) {two[1]} AS max_breach_hours
  FROM @freshness WHERE sla_status IS NOT NULL {group}"""


# Rounded like the result: by the exact binary value.
TWO = ("CAST(format('{:.2f}',", ") AS DOUBLE)")


def _evaluations(t):
    """Operations with a service level: one without it has nothing to comply with, and is counted by ``sla_unrated``."""
    breach = F.when(F.col("sla_status") == "breached", F.col("dataset_age_hours") - 22)
    return t.freshness.filter(F.col("sla_status").isNotNull()).select(
        "dataset_name", "sla_status", F.col("dataset_age_hours").alias("actual_latency_hours"),
        breach.alias("breach_duration_hours"),
    )


@query("sla_batch", SLA_BATCH.format(key="", group="", two=TWO))
def sla_batch(t):
    return rollups.sla_batch(_evaluations(t))


@query("sla_batch_by_dataset", SLA_BATCH.format(key="dataset_name,", group="GROUP BY dataset_name", two=TWO))
def sla_batch_by_dataset(t):
    return rollups.sla_batch(_evaluations(t), ["dataset_name"])


@query(
    "sla_unrated",
    """SELECT dataset_name, count(*) AS operations, count(*) FILTER (WHERE sla_status IS NULL) AS unrated
      FROM @freshness GROUP BY 1""",
)
def sla_unrated(t):
    return t.freshness.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(F.col("sla_status").isNull()).alias("unrated")
    )


# --- windows ----------------------------------------------------------------------------------


def _latest(columns: str, table: str, key: str, order: str, n: int = 1) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
      FROM {table}) WHERE rn <= {n}"""


@query(
    "latest_per_dataset",
    _latest("dataset_name, id, ingestion_timestamp", "@freshness", "dataset_name", "ingestion_timestamp DESC, id DESC"),
)
def latest_per_dataset(t):
    rows = t.freshness.select("dataset_name", "id", "ingestion_timestamp")
    return latest_per_key(rows, ["dataset_name"], F.col("ingestion_timestamp").desc(), F.col("id").desc())


@query(
    "latest_load_per_dataset",
    _latest("dataset_name, batch_id, status, started_at", "@load_history", "dataset_name", "started_at DESC, batch_id DESC"),
)
def latest_load_per_dataset(t):
    rows = t.load_history.select("dataset_name", "batch_id", "status", "started_at")
    return latest_per_key(rows, ["dataset_name"], F.col("started_at").desc(), F.col("batch_id").desc())


@query(
    "latest_by_key",
    _latest("dataset_name, validation_type, id, status", "@audit_logs", "dataset_name, validation_type", "created_at DESC, id DESC"),
)
def latest_by_key(t):
    rows = t.audit_logs.select("dataset_name", "validation_type", "id", "status", "created_at")
    newest = (F.col("created_at").desc(), F.col("id").desc())
    return latest_per_key(rows, ["dataset_name", "validation_type"], *newest).drop("created_at")


@query(
    "last_n_per_key",
    _latest("dag_id, dag_run_id, state, rn AS row_number", "@dag_runs", "dag_id", "execution_date DESC, dag_run_id DESC", 5),
)
def last_n_per_key(t):
    rows = t.dag_runs.select("dag_id", "dag_run_id", "state", "execution_date")
    newest = (F.col("execution_date").desc(), F.col("dag_run_id").desc())
    return first_n_per_key(rows, ["dag_id"], 5, *newest).drop("execution_date")


# --- runs ----------------------------------------------------------------------------------------


@query(
    "dag_runs",
    """SELECT dag_id, dag_run_id, execution_date, state FROM @dag_runs WHERE dag_id = 'dag_12' AND state = 'failed'
      AND execution_date >= TIMESTAMP '1996-01-01 00:00:00' AND execution_date <= TIMESTAMP '2000-01-01 00:00:00'
      ORDER BY execution_date DESC, dag_run_id DESC LIMIT 50""",
)
def dag_runs(t):
    rows = flt.apply_filters(
        t.dag_runs, ("dag_id", "eq", "dag_12"), ("state", "eq", "failed"),
        ("execution_date", "ge", at("1996-01-01 00:00:00")), ("execution_date", "le", at("2000-01-01 00:00:00")),
    )
    return flt.recent(rows.select("dag_id", "dag_run_id", "execution_date", "state"), "execution_date", ["dag_run_id"], 50)


@query(
    "dag_summary",
    f"""SELECT dag_id, count(*) AS total_executions, {_n("state = 'success'", 'successful')}, {_n("state = 'failed'", 'failed')},
      {_n("state = 'running'", 'running')},
      round(coalesce(avg(duration_seconds) FILTER (WHERE state = 'success'), 0), 4) AS average_duration_seconds,
      round(count(*) FILTER (WHERE state = 'success') * 1e2 / count(*), 4) AS success_rate FROM @dag_runs GROUP BY 1""",
)
def dag_summary(t):
    return tidy(rollups.dag_summary(t.dag_runs))


PIPELINES = """SELECT dag_id, max(execution_date) > TIMESTAMP '2001-07-01 00:00:00' AS is_active,
  count(*) % 3 = 0 AS is_paused FROM @dag_runs GROUP BY 1"""


@query(
    "pipeline_summary",
    f"""WITH p AS ({PIPELINES}), c AS (SELECT dag_id FROM p ORDER BY 1 LIMIT 10),
      r AS (SELECT state, row_number() OVER (PARTITION BY dag_id ORDER BY execution_date DESC, dag_run_id DESC) AS rn
        FROM @dag_runs WHERE dag_id IN (SELECT dag_id FROM c))
      SELECT state, count(*) AS recent_runs, (SELECT count(*) FROM p) AS total_pipelines,
        (SELECT count(*) FROM p WHERE is_active AND NOT is_paused) AS active_pipelines,
        (SELECT count(*) FROM p WHERE is_paused) AS paused_pipelines FROM r WHERE rn <= 5 GROUP BY 1""",
)
def pipeline_summary(t):
    pipelines = t.dag_runs.groupBy("dag_id").agg(
        (F.max("execution_date") > at("2001-07-01 00:00:00")).alias("is_active"),
        (F.count(F.lit(1)) % 3 == 0).alias("is_paused"),
    )
    return rollups.pipeline_summary(pipelines, t.dag_runs)


RUNS = """SELECT dag_run_id, dag_id, state, start_date, end_date, CAST(duration_seconds AS DOUBLE) AS duration_seconds,
        CASE WHEN state = 'running' THEN 0 ELSE o.o_custkey % 9 + 1 END AS total_tasks,
        CASE WHEN state = 'success' THEN o.o_custkey % 9 + 1 ELSE 0 END AS completed_tasks,
        CASE WHEN state = 'failed' THEN 1 ELSE 0 END AS failed_tasks
      FROM @dag_runs AS r JOIN orders AS o ON r.dag_run_id = 'run_' || o.o_orderkey"""


@query("dag_run_upsert", RUNS)
def dag_run_upsert(t):
    return runs.run_upsert(t.run_events)


@query("dag_runs_patched", RUNS)
def dag_runs_patched(t):
    """Runs in a stored table: starts of most are there, ends and further starts come later and change their groups only."""
    store, group = snapshots.Snapshots(t.spark, work_path(t.spark, "store")), snapshots.bucket("dag_run_id", 16)
    started = (F.col("state") == "running") & ~F.col("dag_run_id").endswith("7")
    first = runs.merge_runs(t.run_events.limit(0), t.run_events.filter(started))
    store.write("dag_runs", first, group)
    snapshots.patch(store, "dag_runs", t.run_events.filter(~started), lambda rows, later: runs.merge_runs(rows, later), group, insert=True)
    return store.read("dag_runs").drop("event_time")


@query(
    "log_batches",
    """SELECT logger, CAST(floor((row_number() OVER (PARTITION BY logger ORDER BY timestamp, conv_id * 1000 + turn) - 1) / 100) AS BIGINT) AS batch,
        epoch_ms(timestamp) AS timestamp_ms, '[' || level || '] ' || message AS message FROM @logs""",
)
def log_batches(t):
    return runs.log_batches(t.logs, "logger", "timestamp", F.col("conv_id") * 1000 + F.col("turn"))


@query(
    "log_search",
    """SELECT conv_id, turn, timestamp, level, logger FROM @logs WHERE upper(level) = 'ERROR'
      AND contains(lower(logger), 'assist') AND contains(lower(message), 'the') AND timestamp >= TIMESTAMP '2024-01-01 00:30:00'
      ORDER BY timestamp DESC, conv_id DESC, turn DESC LIMIT 100""",
)
def log_search(t):
    rows = flt.log_search(
        t.logs, level="error", logger="Assist", search="THE", start=at("2024-01-01 00:30:00")
    )
    columns = ["conv_id", "turn", "timestamp", "level", "logger"]
    return flt.recent(rows.select(*columns), "timestamp", ["conv_id", "turn"], 100)


@query(
    "log_stats",
    """SELECT 'total' AS "grouping", 'all' AS "value", count(*) AS lines FROM @logs
      UNION ALL SELECT 'level', level, count(*) FROM @logs GROUP BY level
      UNION ALL SELECT 'logger', logger, count(*) FROM @logs GROUP BY logger""",
)
def log_stats(t):
    return rollups.log_stats(t.logs)


@query(
    "text_search",
    """SELECT rule_id, name FROM @rule_table WHERE contains(lower(name), 'brand#1') OR contains(lower(rule_id), 'brand#1')
      OR contains(lower(description), 'brand#1') OR len([x FOR x IN tags IF contains(lower(x), 'brand#1')]) > 0""",
)
def text_search(t):
    return flt.text_search(t.rule_table, "BRAND#1", ["name", "rule_id", "description"], "tags").select("rule_id", "name")


@query(
    "text_search_documents",
    "SELECT doc_id FROM @documents WHERE contains(lower(text), 'license')",
)
def text_search_documents(t):
    return flt.text_search(t.documents, "License", ["text"]).select("doc_id")


@query(
    "text_search_indexed",
    "SELECT doc_id FROM @documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')",
)
def text_search_indexed(t):
    """``text_search`` over files, of which an index of three-letter pieces leaves out those without the text."""
    path = work_path(t.spark, "documents")
    t.documents.repartition(16, "doc_id").write.parquet(path)
    index = TextIndex(t.spark, path, work_path(t.spark, "index"), ["text", "source"])
    index.update()
    return index.search("License").select("doc_id")


@query(
    "lineage_record",
    """WITH d AS (SELECT DISTINCT target_dataset, upstream_dataset FROM @lineage_edges),
      x AS (SELECT DISTINCT target_dataset, transformation FROM @lineage_edges)
      SELECT d.target_dataset, string_agg(upstream_dataset, ';' ORDER BY upstream_dataset) AS upstream_datasets,
        any_value(t) AS transformations, count(*) AS lineage_depth
      FROM d JOIN (SELECT target_dataset, string_agg(transformation, ';' ORDER BY transformation) AS t FROM x GROUP BY 1) AS y
        ON d.target_dataset = y.target_dataset GROUP BY 1""",
)
def lineage_record(t):
    return tidy(runs.lineage_record(t.lineage_edges))


@query(
    "with_lineage_cols",
    "SELECT o_orderkey, TIMESTAMP '2001-08-02 00:00:00' AS processed_at, 'ingest' AS processing_job FROM @orders",
)
def with_lineage_cols(t):
    return runs.with_lineage_columns(t.orders.select("o_orderkey"), "ingest", at(ORDERS_END))


LATENCIES = """SELECT id AS operation_id, dataset_name, date_diff('microsecond', ingestion_start, ingestion_end) / 1e6 AS ingestion_latency_seconds,
    date_diff('microsecond', validation_start, validation_end) / 1e6 AS validation_latency_seconds,
    date_diff('microsecond', ingestion_start, coalesce(validation_end, ingestion_end)) / 1e6 AS total_latency_seconds FROM @operations"""


@query("latencies", f"SELECT operation_id, dataset_name, round(ingestion_latency_seconds, 4) AS ingestion_latency_seconds, round(validation_latency_seconds, 4) AS validation_latency_seconds, round(total_latency_seconds, 4) AS total_latency_seconds FROM ({LATENCIES})")
def latencies(t):
    operations = freshness.pivot_operations(t.operation_events, ["operation_id", "dataset_name"])
    return tidy(
        freshness.with_latencies(operations).select(
            "operation_id", "dataset_name", "ingestion_latency_seconds", "validation_latency_seconds",
            "total_latency_seconds",
        )
    )
