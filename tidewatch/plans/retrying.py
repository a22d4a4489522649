"""Queries: the retry queue of failed validations, and repeated validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import filters, retries, rollups, runs
from tidewatch.plans.catalog import query
from tidewatch.plans.common import EVENTS_END, at, tidy
from tidewatch.plans.validation import DEFAULTS_SQL, default_results

ET = f"TIMESTAMP '{EVENTS_END}'"
STATES = ("pending", "in_progress", "completed", "failed", "cancelled")
COUNTS = ", ".join(f"count(*) FILTER (WHERE retry_status = '{s}') AS {s}" for s in STATES)


def _recent(t, days: int):
    return filters.since_days(t.retries, "created_at", at(EVENTS_END), days)


@query(
    "pending_retries",
    "SELECT id, validation_log_id, created_at FROM @retries WHERE retry_status = 'pending' ORDER BY created_at, id LIMIT 100",
)
def pending_retries(t):
    rows = filters.apply_filters(t.retries, ("retry_status", "eq", "pending"))
    return filters.oldest(rows.select("id", "validation_log_id", "created_at"), "created_at", ["id"], 100)


@query(
    "retries_for_validation",
    "SELECT id, retry_status, created_at FROM @retries WHERE validation_log_id = 700 ORDER BY created_at DESC, id DESC",
)
def retries_for_validation(t):
    rows = filters.apply_filters(t.retries, ("validation_log_id", "eq", 700))
    return rows.select("id", "retry_status", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc())


HISTORY = f"""SELECT r.*, l.dataset_name, l.validation_type, l.status AS log_status,
    r.retry_status IN ('pending', 'failed') AND r.retry_count < r.max_retries AS is_retryable
  FROM @retries AS r JOIN @audit_logs AS l ON r.validation_log_id = l.id WHERE r.created_at >= {ET} - INTERVAL 15 DAY"""
COLUMNS = "id, validation_log_id, dataset_name, validation_type, retry_status, retry_count, initiated_by, created_at, is_retryable"


def _history(t):
    return retries.retry_history(_recent(t, 15), t.audit_logs)


@query("retry_x_validation", f"SELECT {COLUMNS} FROM ({HISTORY})")
def retry_x_validation(t):
    return _history(t).select(*COLUMNS.split(", "))


@query(
    "retry_history_page",
    f"""SELECT {COLUMNS} FROM ({HISTORY}) WHERE dataset_name = 'Dataset_2' AND retry_status = 'failed'
      ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10""",
)
def retry_history_page(t):
    rows = filters.apply_filters(
        _history(t), ("validation_log_id", "eq", None), ("dataset_name", "eq", "Dataset_2"),
        ("retry_status", "eq", "failed"),
    )
    return filters.sort_page(rows.select(*COLUMNS.split(", ")), "created_at", ["id"], True, 20, 10)


@query(
    "retry_history_info",
    f"SELECT count(*) AS total_count, 30 < count(*) AS has_more FROM ({HISTORY}) WHERE retry_status = 'failed'",
)
def retry_history_info(t):
    return filters.page_info(filters.apply_filters(_history(t), ("retry_status", "eq", "failed")), 20, 10)


@query(
    "most_retried",
    f"SELECT dataset_name, validation_type, count(*) AS retry_count FROM ({HISTORY}) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10",
)
def most_retried(t):
    return retries.most_retried(_history(t))


@query(
    "topk_retried",
    """SELECT dataset_name, validation_type, count(*) AS retry_count FROM @retries AS r JOIN @audit_logs AS l
      ON r.validation_log_id = l.id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3""",
)
def topk_retried(t):
    return retries.most_retried(retries.retry_history(t.retries, t.audit_logs), top=3)


@query(
    "failure_insights",
    f"""SELECT id, dataset_name, validation_type, status FROM @audit_logs WHERE status IN ('failed', 'error')
      AND id IN (SELECT validation_log_id FROM @retries WHERE created_at >= {ET} - INTERVAL 7 DAY)""",
)
def failure_insights(t):
    return retries.failures_with_retries(t.audit_logs, _recent(t, 7)).select(
        "id", "dataset_name", "validation_type", "status"
    )


INSIGHT = f"""SELECT substr(message, 1, 100) AS pattern, count(*) AS "count", arg_min(validation_type, id) AS validation_type
  FROM @audit_logs WHERE status IN ('failed', 'error') AND message <> ''
    AND id IN (SELECT validation_log_id FROM @retries WHERE created_at >= {ET} - INTERVAL 7 DAY) GROUP BY 1"""


@query("topk_patterns", f'{INSIGHT} ORDER BY "count" DESC, pattern LIMIT 10')
def topk_patterns(t):
    failures = retries.failures_with_retries(t.audit_logs, _recent(t, 7))
    return rollups.failure_patterns(failures).drop("example_errors")


@query(
    "retry_timeline",
    """SELECT id, validation_log_id, retry_status, created_at, row_number() OVER (PARTITION BY validation_log_id
      ORDER BY created_at, id) AS attempt_order FROM @retries""",
)
def retry_timeline(t):
    return retries.retry_timeline(t.retries.select("id", "validation_log_id", "retry_status", "created_at"))


@query(
    "retry_timeline_by_user",
    """SELECT id, initiated_by AS validation_log_id, created_at, row_number() OVER (PARTITION BY initiated_by
      ORDER BY created_at, id) AS attempt_order FROM @retries""",
)
def retry_timeline_by_user(t):
    rows = t.retries.select("id", F.col("initiated_by").alias("validation_log_id"), "created_at")
    return retries.retry_timeline(rows)


@query(
    "retry_statistics",
    f"""SELECT count(*) AS total_retries, {COUNTS},
      round(count(*) FILTER (WHERE retry_status = 'completed') * 1e2 / count(*), 4) AS success_rate FROM @retries""",
)
def retry_statistics(t):
    return tidy(rollups.retry_statistics(t.retries))


@query(
    "retry_metrics",
    f"""SELECT count(*) AS total_retries, {COUNTS},
      round(coalesce(avg(retry_count) FILTER (WHERE retry_status = 'completed'), 0), 2) AS average_retry_count,
      round(count(*) FILTER (WHERE retry_status = 'completed') * 1e2 / count(*), 4) AS success_rate,
      round(count(*) FILTER (WHERE retry_status = 'completed' AND retry_count = 1) * 1e2
        / count(*) FILTER (WHERE retry_status = 'completed'), 4) AS first_attempt_success_rate
      FROM @retries WHERE created_at >= {ET} - INTERVAL 7 DAY""",
)
def retry_metrics(t):
    return tidy(rollups.retry_metrics(_recent(t, 7)))


@query(
    "user_retry_activity",
    f"""SELECT initiated_by AS "user", count(*) AS total_retries,
      count(*) FILTER (WHERE retry_status = 'completed') AS successful_retries,
      count(*) FILTER (WHERE retry_status = 'failed') AS failed_retries,
      count(*) FILTER (WHERE retry_status = 'pending') AS pending_retries,
      round(count(*) FILTER (WHERE retry_status = 'completed') * 1e2 / count(*), 4) AS success_rate
      FROM @retries WHERE created_at >= {ET} - INTERVAL 30 DAY GROUP BY 1""",
)
def user_retry_activity(t):
    return tidy(rollups.user_retry_activity(_recent(t, 30)))


@query(
    "bulk_retry_result",
    """SELECT executor, count(*) AS total, count(*) FILTER (WHERE status IN ('passed', 'warning')) AS succeeded,
      count(*) FILTER (WHERE status NOT IN ('passed', 'warning')) AS failed FROM @attempts GROUP BY 1""",
)
def bulk_retry_result(t):
    return rollups.bulk_retry_result(t.attempts, ["executor"])


@query(
    "retry_enqueue",
    """SELECT id AS validation_log_id, 'pending' AS retry_status, CAST(0 AS INT) AS retry_count, CAST(3 AS INT) AS max_retries
      FROM @audit_logs WHERE status IN ('failed', 'error') AND id NOT IN
        (SELECT validation_log_id FROM @retries WHERE retry_status IN ('pending', 'in_progress'))""",
)
def retry_enqueue(t):
    return retries.enqueue(t.audit_logs, t.retries)


@query(
    "retry_advance",
    """WITH a AS (SELECT retry_id, count(*) AS n, arg_max(status, (attempt_at, attempt_id)) AS last_status, max(attempt_at) AS made_at FROM @attempts GROUP BY 1),
      j AS (SELECT q.*, n, last_status, made_at, q.retry_count + coalesce(n, 0) AS c, coalesce(last_status IN ('passed', 'warning'), false) AS ok
        FROM @retry_queue AS q LEFT JOIN a ON q.retry_id = a.retry_id)
      SELECT retry_id, CASE WHEN n IS NULL THEN retry_status WHEN ok THEN 'completed' ELSE 'failed' END AS retry_status,
        c AS retry_count, max_retries, made_at AS last_retry_at,
        CASE WHEN n IS NOT NULL AND (ok OR c >= max_retries) THEN made_at END AS completed_at,
        CASE WHEN n IS NULL THEN NULL WHEN ok THEN 'Validation passed on retry attempt ' || c
          WHEN c >= max_retries THEN 'Max retries reached (' || max_retries || ')' END AS error_message FROM j""",
)
def retry_advance(t):
    return retries.advance(t.retry_queue, t.attempts)


@query(
    "retry_cancel",
    f"""SELECT id, CASE WHEN retry_status IN ('pending', 'in_progress') THEN 'cancelled' ELSE retry_status END AS retry_status,
      CASE WHEN retry_status IN ('pending', 'in_progress') THEN {ET} ELSE completed_at END AS completed_at,
      CASE WHEN retry_status IN ('pending', 'in_progress') THEN 'Cancelled by admin' ELSE error_message END AS error_message FROM @retries""",
)
def retry_cancel(t):
    return retries.cancel(t.retries, F.lit("admin"), at(EVENTS_END)).select(
        "id", "retry_status", "completed_at", "error_message"
    )


@query(
    "revalidate",
    f"""WITH d AS ({DEFAULTS_SQL})
      SELECT dataset_name, CASE WHEN bool_and(status = 'passed') THEN 'passed' ELSE 'failed' END AS status,
        arg_min(total_records, position) FILTER (WHERE total_records > 0) AS total_records,
        count(*) FILTER (WHERE status = 'failed') AS failed_records,
        round(count(*) FILTER (WHERE status = 'passed') * 1e2 / count(*), 4) AS pass_rate,
        'Validation re-executed: ' || count(*) FILTER (WHERE status = 'passed') || '/' || count(*) || ' validators passed' AS message,
        string_agg(message, ';' ORDER BY message) FILTER (WHERE status <> 'passed') AS errors FROM d GROUP BY 1""",
)
def revalidate(t):
    return tidy(runs.revalidation_rows(default_results(t)))
