"""Queries: staging, loads, verification, history and retry decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scalars import record_hash
from tidewatch.operators import filters, hashfilter, loads, rollups
from tidewatch.plans.catalog import query
from tidewatch.plans.common import EVENTS_END, ORDERS_END, at, tidy
from tidewatch.session import work_path, written
from tidewatch.sources import snapshots

OT = f"TIMESTAMP '{ORDERS_END}'"


def _n(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


# --- filters ------------------------------------------------------------------------


@query(
    "processed_data",
    """SELECT batch_id, dataset_name, source_record_id, validation_status, price, load_timestamp FROM @processed
      WHERE dataset_name = 'ds3' AND validation_status = 'warning' AND load_timestamp >= TIMESTAMP '1997-01-01 00:00:00'
        AND load_timestamp <= TIMESTAMP '1997-12-31 00:00:00'
      ORDER BY load_timestamp DESC, batch_id DESC, source_record_id DESC, price DESC LIMIT 100""",
)
def processed_data(t):
    rows = filters.apply_filters(
        t.processed, ("dataset_name", "eq", "ds3"), ("batch_id", "eq", None), ("validation_status", "eq", "warning"),
        ("load_timestamp", "ge", at("1997-01-01 00:00:00")), ("load_timestamp", "le", at("1997-12-31 00:00:00")),
    )
    columns = ["batch_id", "dataset_name", "source_record_id", "validation_status", "price", "load_timestamp"]
    return filters.recent(rows.select(*columns), "load_timestamp", ["batch_id", "source_record_id", "price"], 100)


@query(
    "load_history",
    """SELECT batch_id, dataset_name, load_type, status, started_at FROM @load_history WHERE dataset_name = 'ds1'
      AND status = 'failed' AND load_type = 'full' AND started_at >= TIMESTAMP '1999-01-01 00:00:00'
      ORDER BY started_at DESC, batch_id DESC LIMIT 50 OFFSET 5""",
)
def load_history(t):
    rows = filters.apply_filters(
        t.load_history, ("dataset_name", "eq", "ds1"), ("status", "eq", "failed"), ("load_type", "eq", "full"),
        ("started_at", "ge", at("1999-01-01 00:00:00")),
    )
    columns = ["batch_id", "dataset_name", "load_type", "status", "started_at"]
    return filters.sort_page(rows.select(*columns), "started_at", ["batch_id"], True, 50, 5)


@query(
    "retry_ready_loads",
    "SELECT batch_id, failure_reason, load_failed_at FROM @failed_loads WHERE can_retry ORDER BY load_failed_at, batch_id LIMIT 50",
)
def retry_ready_loads(t):
    rows = filters.apply_filters(t.failed_loads, ("can_retry", "eq", True))
    return filters.oldest(rows.select("batch_id", "failure_reason", "load_failed_at"), "load_failed_at", ["batch_id"], 50)


FAILED_RECORDS = """SELECT batch_id, dataset_name, record_hash, error_message, substr(raw_data, 1, 200) AS raw_data_preview
  FROM @staging WHERE NOT is_processed AND error_message IS NOT NULL"""


@query("failed_records", FAILED_RECORDS)
def failed_records(t):
    return loads.failed_records(t.staging)


@query(
    "failed_records_page",
    f"{FAILED_RECORDS} AND dataset_name = 'ds4' ORDER BY batch_id, record_hash, raw_data_preview LIMIT 100",
)
def failed_records_page(t):
    rows = filters.apply_filters(loads.failed_records(t.staging), ("dataset_name", "eq", "ds4"))
    return rows.orderBy("batch_id", "record_hash", "raw_data_preview").limit(100)


@query(
    "load_audit_history",
    f"""SELECT id, batch_id, load_status, created_at FROM @load_audit WHERE created_at >= {OT} - INTERVAL 120 DAY
      AND dataset_name = 'ds2' AND load_status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 100""",
)
def load_audit_history(t):
    recent = filters.since_days(t.load_audit, "created_at", at(ORDERS_END), 120)
    rows = filters.apply_filters(recent, ("dataset_name", "eq", "ds2"), ("load_status", "eq", "completed"))
    return filters.recent(rows.select("id", "batch_id", "load_status", "created_at"), "created_at", ["id"], 100)


# --- roll-ups -------------------------------------------------------------------------


@query(
    "warehouse_statistics",
    f"""SELECT dataset_name, record_count, l.* FROM (SELECT dataset_name, count(*) AS record_count FROM @processed GROUP BY 1),
      (SELECT count(*) AS total_loads, {_n("status = 'completed'", 'successful_loads')}, {_n("status = 'failed'", 'failed_loads')},
        arg_max(status, (started_at, batch_id)) AS latest_load_status, max(started_at) AS latest_load_timestamp FROM @load_history) AS l""",
)
def warehouse_statistics(t):
    return rollups.warehouse_statistics(t.processed, t.load_history)


@query(
    "dataset_health",
    """WITH l AS (SELECT dataset_name, arg_max(started_at, (started_at, batch_id)) AS latest_load_timestamp,
        arg_max(status, (started_at, batch_id)) AS latest_load_status,
        arg_max(records_loaded, (started_at, batch_id)) AS latest_records_loaded FROM @load_history GROUP BY 1)
      SELECT p.dataset_name, validation_status, record_count, latest_load_timestamp, latest_load_status, latest_records_loaded
      FROM (SELECT dataset_name, validation_status, count(*) AS record_count FROM @processed GROUP BY 1, 2) AS p
      LEFT JOIN l ON p.dataset_name = l.dataset_name""",
)
def dataset_health(t):
    return rollups.dataset_health(t.processed, t.load_history)


@query(
    "dataset_load_summary",
    f"""SELECT dataset_name, count(*) AS total_loads, {_n("status = 'completed'", 'completed_loads')},
      {_n("status = 'failed'", 'failed_loads')}, CAST(sum(records_loaded) AS BIGINT) AS total_records_loaded,
      CAST(sum(records_failed) AS BIGINT) AS total_records_failed,
      round(count(*) FILTER (WHERE status = 'completed') * 1e2 / count(*), 4) AS success_rate FROM @load_history GROUP BY 1""",
)
def dataset_load_summary(t):
    return tidy(rollups.dataset_load_summary(t.load_history))


@query(
    "load_statistics",
    f"""SELECT count(*) AS total_loads, {_n("load_status = 'completed'", 'completed_loads')},
      {_n("load_status = 'failed'", 'failed_loads')}, {_n("load_status = 'retrying'", 'retrying_loads')},
      round(avg(execution_time_seconds) FILTER (WHERE load_status = 'completed'), 2) AS average_execution_time_seconds,
      round(count(*) FILTER (WHERE load_status = 'completed') * 1e2 / count(*), 2) AS success_rate
      FROM @load_audit WHERE created_at >= {OT} - INTERVAL 700 DAY""",
)
def load_statistics(t):
    return rollups.load_statistics(filters.since_days(t.load_audit, "created_at", at(ORDERS_END), 700))


@query(
    "dataset_completeness",
    """WITH p AS (SELECT dataset_name, CAST(created_at AS DATE) AS day, count(DISTINCT batch_id) AS total_batches,
        count(*) AS total_records FROM @processed GROUP BY 1, 2),
      f AS (SELECT dataset_name, CAST(created_at AS DATE) AS day, count(*) AS n FROM @failed_loads GROUP BY 1, 2)
      SELECT coalesce(p.dataset_name, f.dataset_name) AS dataset_name, coalesce(p.day, f.day) AS day,
        coalesce(total_batches, 0) AS total_batches, coalesce(total_records, 0) AS total_records,
        coalesce(n, 0) AS failed_loads_count FROM p FULL JOIN f ON p.dataset_name = f.dataset_name AND p.day = f.day""",
)
def dataset_completeness(t):
    return rollups.dataset_completeness(t.processed, t.failed_loads)


@query(
    "avg_quality",
    """SELECT batch_id, dataset_name, round(coalesce(avg(data_quality_score), 0), 4) AS average_quality_score,
      least(count(*), 10) AS sample_size FROM @processed GROUP BY 1, 2""",
)
def avg_quality(t):
    return tidy(rollups.avg_quality(t.processed))


@query(
    "quality_sample",
    """SELECT batch_id, source_record_id, price, round(data_quality_score, 4) AS data_quality_score FROM (SELECT *, row_number() OVER
      (PARTITION BY batch_id ORDER BY price DESC, source_record_id) AS rn FROM @processed) WHERE rn <= 3""",
)
def quality_sample(t):
    rows = t.processed.select("batch_id", "source_record_id", "price", "data_quality_score")
    return tidy(
        rollups.quality_sample(rows, ["batch_id"], F.col("price").desc(), F.col("source_record_id"), n=3).drop("row_number")
    )


@query(
    "failed_loads_summary",
    f"""SELECT failure_reason, count(*) AS failed_loads, {_n('can_retry', 'ready_for_retry')},
      {_n('NOT can_retry AND retry_validated_at IS NULL', 'needs_validation')}, {_n('retry_count >= 3', 'max_retries_reached')}
      FROM @failed_loads GROUP BY 1""",
)
def failed_loads_summary(t):
    return rollups.failed_loads_summary(t.failed_loads)


# --- loading ----------------------------------------------------------------------------

# Incoming records: every document, whose text also occurs as a copy; stored: those of one language. Some have no hash.
INCOMING = "SELECT doc_id, lang, CASE WHEN doc_id % 17 <> 3 THEN sha256(text) END AS record_hash FROM @documents"
STORED = "SELECT CASE WHEN doc_id % 19 <> 4 THEN sha256(text) END AS record_hash FROM @documents WHERE lang = 'de'"
KNOWN = f"SELECT record_hash FROM ({STORED}) WHERE record_hash IS NOT NULL"


def _hash(without: str):
    return F.when(F.expr(without), F.sha2("text", 256)).alias("record_hash")


def _incoming(t):
    return t.documents.select("doc_id", "lang", _hash("doc_id % 17 <> 3"))


def _stored(t):
    return t.documents.filter(F.col("lang") == "de").select(_hash("doc_id % 19 <> 4"))


@query(
    "load_dedup",
    f"""SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, record_hash FROM ({INCOMING})
      WHERE record_hash IS NOT NULL AND record_hash NOT IN ({KNOWN}) GROUP BY record_hash
      UNION ALL SELECT * FROM ({INCOMING}) WHERE record_hash IS NULL""",
)
def load_dedup(t):
    return loads.load_dedup(_incoming(t), _stored(t), "doc_id")


OUTCOMES = f"""SELECT doc_id, lang, record_hash, CASE WHEN record_hash IS NULL THEN 'loaded' WHEN record_hash IN ({KNOWN})
    OR row_number() OVER (PARTITION BY record_hash ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'loaded' END AS outcome FROM ({INCOMING})"""


@query("load_outcomes", OUTCOMES)
def load_outcomes(t):
    return loads.load_outcomes(_incoming(t), _stored(t), "doc_id")


@query(
    "load_batch",
    f"""SELECT lang, count(*) AS records_attempted, {_n("outcome = 'loaded'", 'records_loaded')},
      {_n("outcome = 'duplicate'", 'records_duplicate')}, CAST(0 AS BIGINT) AS records_failed,
      round(count(*) FILTER (WHERE outcome = 'loaded') * 1e2 / count(*), 4) AS success_rate, 'completed' AS status
      FROM ({OUTCOMES}) GROUP BY 1""",
)
def load_batch(t):
    return tidy(loads.load_summary(loads.load_outcomes(_incoming(t), _stored(t), "doc_id"), ["lang"]))


@query("load_outcomes_filtered", OUTCOMES)
def load_outcomes_filtered(t):
    """``load_outcomes`` where a filter per batch spares reading the stored hashes of batches without a hit."""
    store = _store(t)
    batched = _stored(t).withColumn("batch_id", F.concat(F.lit("batch_"), F.substring("record_hash", 1, 1)))
    store.write("hashes", batched, F.col("batch_id"))
    filters = written(hashfilter.build_filter(store.read("hashes"), by=("batch_id",), blocks=16), "filters")
    known = hashfilter.known_hashes(_incoming(t), filters, "batch_id", lambda names: store.read("hashes", partitions=names), blocks=16)
    return loads.load_outcomes(_incoming(t), known, "doc_id")


@query(
    "record_hash",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":'
        || coalesce('"' || priority || '"', 'null') || ',"o_totalprice":' || o_totalprice || '}') AS record_hash
      FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS priority FROM @orders)""",
)
def record_hash_query(t):
    rows = t.orders.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return rows.select(
        "o_orderkey", record_hash(["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]).alias("record_hash")
    )


BATCHES = "SELECT batch_id FROM @load_history WHERE load_type = 'full' AND status = 'failed'"


def _to_roll_back(t):
    return t.load_history.filter("load_type = 'full' AND status = 'failed'").select("batch_id")


@query(
    "load_rollback",
    f"""SELECT b.batch_id, count(p.batch_id) AS records_deleted, 'rolled_back' AS status,
        'Batch manually rolled back' AS error_message
      FROM ({BATCHES}) AS b LEFT JOIN @processed AS p ON b.batch_id = p.batch_id GROUP BY 1""",
)
def load_rollback(t):
    return loads.rollback_counts(t.processed, _to_roll_back(t))


@query("load_rollback_kept", f"SELECT batch_id, source_record_id, price FROM @processed WHERE batch_id NOT IN ({BATCHES})")
def load_rollback_kept(t):
    return loads.without_batches(t.processed, _to_roll_back(t)).select("batch_id", "source_record_id", "price")


UNBATCHED = "SELECT CASE WHEN record_hash >= '1' THEN batch_id END AS batch_id, record_hash, raw_data FROM @staging"


@query("delete_staging", f"SELECT * FROM ({UNBATCHED}) WHERE batch_id IS NULL OR batch_id <> 'batch_5'")
def delete_staging(t):
    return loads.without_batch(t.sql(UNBATCHED), "batch_5")


# One update for most batches, and a later one for some of them.
UPDATES = """SELECT 'batch_' || CAST(o_orderkey AS {string}) AS batch_id, o_orderdate AS updated_at,
    CASE WHEN o_custkey % 4 = 0 THEN 'completed' WHEN o_custkey % 4 = 1 THEN 'rolled_back' END AS status,
    CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS records_loaded,
    CASE WHEN o_custkey % 4 = 1 THEN 'Batch manually rolled back' END AS error_message
    FROM @orders WHERE o_custkey % 2 = 0 OR o_custkey % 4 = 1
  UNION ALL SELECT 'batch_' || CAST(o_orderkey AS {string}), TIMESTAMP{zone} '2002-01-01 00:00:00',
    CASE WHEN o_custkey % 3 = 0 THEN 'running' WHEN o_custkey % 3 = 1 THEN 'failed' END, o_custkey * 2, NULL
    FROM @orders WHERE o_custkey % 5 = 0"""


def _last(column: str) -> str:
    return f"arg_max({column}, updated_at) FILTER (WHERE {column} IS NOT NULL) AS {column}"


UPSERTED = f"""SELECT h.* REPLACE (coalesce(u.status, h.status) AS status, coalesce(u.records_loaded, h.records_loaded) AS records_loaded,
        coalesce(u.error_message, h.error_message) AS error_message, coalesce(u.ended, h.completed_at) AS completed_at)
      FROM @load_history AS h LEFT JOIN (SELECT batch_id, {_last("status")}, {_last("records_loaded")}, {_last("error_message")},
        max(updated_at) FILTER (WHERE status IN ('completed', 'failed', 'rolled_back')) AS ended
        FROM ({UPDATES.format(string='VARCHAR', zone='')}) GROUP BY batch_id) AS u ON h.batch_id = u.batch_id"""


@query("load_history_upsert", UPSERTED)
def load_history_upsert(t):
    return loads.upsert_history(t.load_history, t.sql(UPDATES.format(string="STRING", zone="_NTZ")))


LIFECYCLE = """SELECT batch_id, any_value(dataset_name) AS dataset_name, arg_max(event, (event_time, event)) AS load_status,
    max(event_time) FILTER (WHERE event IN ('started', 'retrying')) AS load_started_at,
    max(event_time) FILTER (WHERE event IN ('completed', 'failed')) AS ended,
    arg_max_null(records, (event_time, event)) AS warehouse_record_count, arg_max_null(reason, (event_time, event)) AS failure_reason,
    count(*) FILTER (WHERE event = 'retrying') AS retry_count FROM @load_events GROUP BY 1"""
STATES = f"""SELECT batch_id, dataset_name, load_status, load_started_at,
    CASE WHEN load_status IN ('completed', 'failed') THEN ended END AS load_completed_at,
    CASE WHEN load_status IN ('completed', 'failed') THEN date_diff('second', load_started_at, ended) END AS execution_time_seconds,
    warehouse_record_count, failure_reason, retry_count FROM ({LIFECYCLE})"""


@query("load_audit_lifecycle", STATES)
def load_audit_lifecycle(t):
    return loads.load_lifecycle(t.load_events)


@query(
    "failed_load_rows",
    f"""SELECT batch_id, dataset_name, load_started_at, load_completed_at AS load_failed_at, failure_reason,
      warehouse_record_count, retry_count, false AS can_retry FROM ({STATES}) WHERE load_status = 'failed'""",
)
def failed_load_rows(t):
    return loads.failed_load_rows(loads.load_lifecycle(t.load_events))


# --- tables that change in one step -----------------------------------------------------------


def _store(t):
    return snapshots.Snapshots(t.spark, work_path(t.spark, "store"))


ROLLED_BACK = "SELECT batch_id FROM @load_history WHERE load_type = 'full' AND status = 'failed' AND batch_id < 'batch_3'"


@query(
    "rollback_in_place",
    f"""SELECT 'processed' AS table_name, batch_id, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS status FROM @processed
        WHERE batch_id NOT IN ({ROLLED_BACK}) GROUP BY batch_id
      UNION ALL SELECT 'history', batch_id, count(*), CASE WHEN batch_id IN ({ROLLED_BACK}) THEN 'rolled_back' ELSE any_value(status) END FROM @load_history GROUP BY batch_id""",
)
def rollback_in_place(t):
    """Batches leave two tables in one commit; folders of other batches stay as they are."""
    store = _store(t)
    group = snapshots.bucket("batch_id", 16)
    store.commit({"processed": snapshots.Replace(t.processed, group), "history": snapshots.Replace(t.load_history, group)})
    gone = t.sql(ROLLED_BACK).distinct()
    snapshots.roll_back_grouped(store, gone, ["processed"], "history", group)
    counts = [
        store.read(name).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), status.alias("status")).select(F.lit(name).alias("table_name"), "*")
        for name, status in (("processed", F.first(F.lit(None).cast("string"))), ("history", F.first("status")))
    ]
    return counts[0].unionByName(counts[1])


@query("history_patched", f"SELECT batch_id, status, records_loaded, error_message FROM ({UPSERTED})")
def history_patched(t):
    """The upsert of ``load_history_upsert`` on a stored table: only groups of batches with updates are rewritten."""
    store, group = _store(t), snapshots.bucket("batch_id", 16)
    store.write("history", t.load_history, group)
    snapshots.patch(store, "history", t.sql(UPDATES.format(string="STRING", zone="_NTZ")), loads.upsert_history, group)
    return store.read("history").select("batch_id", "status", "records_loaded", "error_message")


# --- verification ---------------------------------------------------------------------------

COUNTS = """SELECT coalesce(s.batch_id, p.batch_id) AS batch_id, coalesce(s.dataset_name, p.dataset_name) AS dataset_name,
    coalesce(staging_count, 0) AS staging_count, coalesce(failed_count, 0) AS failed_count, coalesce(warehouse_count, 0) AS warehouse_count
  FROM (SELECT batch_id, dataset_name, count(*) AS staging_count,
      count(*) FILTER (WHERE NOT is_processed AND error_message IS NOT NULL) AS failed_count FROM @staging GROUP BY 1, 2) AS s
  FULL JOIN (SELECT batch_id, dataset_name, count(*) AS warehouse_count FROM @partly_processed GROUP BY 1, 2) AS p
    ON s.batch_id = p.batch_id AND s.dataset_name = p.dataset_name"""


@query("batch_verify", COUNTS)
def batch_verify(t):
    return loads.batch_counts(t.staging, t.partly_processed)


@query(
    "verify_batch",
    f"""SELECT *, staging_count AS source_count, staging_count - warehouse_count AS discrepancy,
      concat_ws(';', CASE WHEN staging_count > warehouse_count THEN (staging_count - warehouse_count) || ' records missing from warehouse' END,
        CASE WHEN failed_count > 0 THEN failed_count || ' records failed during processing' END,
        CASE WHEN warehouse_count = 0 AND staging_count > 0 THEN 'No records loaded to warehouse despite source data' END) AS issues,
      staging_count <= warehouse_count AND failed_count = 0 AS is_valid,
      CASE WHEN staging_count <= warehouse_count AND failed_count = 0 THEN 'PASSED' ELSE 'FAILED' END AS verification_status
      FROM ({COUNTS})""",
)
def verify_batch(t):
    return tidy(loads.verify_batches(loads.batch_counts(t.staging, t.partly_processed)))


RETRYABLE = "regexp_matches(lower(failure_reason), 'timeout|network_error|temporary_error|resource_limit|connection_error')"


@query(
    "retry_eligibility",
    f"""WITH s AS (SELECT batch_id, count(*) AS n FROM @staging GROUP BY 1),
      p AS (SELECT batch_id, dataset_name, count(*) AS n FROM @partly_processed GROUP BY 1, 2),
      x AS (SELECT f.*, coalesce(s.n, 0) AS sc, coalesce(p.n, 0) AS wc,
        date_diff('microsecond', load_failed_at, {OT}) / 36e8 AS h FROM @failed_loads AS f
        LEFT JOIN s ON f.batch_id = s.batch_id LEFT JOIN p ON f.batch_id = p.batch_id AND f.dataset_name = p.dataset_name)
      SELECT batch_id, failure_reason, retry_count,
        concat_ws(';', CASE WHEN sc > 0 THEN 'Staging data exists (' || sc || ' records)' END,
          CASE WHEN {RETRYABLE} THEN 'Failure reason is retryable' END,
          CASE WHEN retry_count < 3 THEN 'Retry count acceptable (' || retry_count || '/3)' END,
          CASE WHEN wc = 0 THEN 'No partial data in warehouse (clean retry)' END,
          CASE WHEN h >= 1 THEN 'Sufficient time elapsed since failure (' || format('{{:.1f}}', h) || 'h)' END) AS checks_passed,
        concat_ws(';', CASE WHEN sc = 0 THEN 'No staging data found - may need to re-ingest' END,
          CASE WHEN NOT {RETRYABLE} THEN 'Failure reason may not be retryable - review required' END,
          CASE WHEN retry_count >= 3 THEN 'Maximum retry attempts reached (' || retry_count || ')' END,
          CASE WHEN wc > 0 THEN 'Partial data exists in warehouse (' || wc || ' records)' END,
          CASE WHEN h < 1 THEN 'Recent failure - consider waiting before retry' END) AS checks_failed,
        concat_ws(';', CASE WHEN sc = 0 THEN 'Re-ingest source data before retry' END,
          CASE WHEN NOT {RETRYABLE} THEN 'Review failure reason: ' || failure_reason END,
          CASE WHEN retry_count >= 3 THEN 'Investigate root cause before further retries' END,
          CASE WHEN wc > 0 THEN 'Clean up partial warehouse data before retry' END,
          CASE WHEN h < 1 THEN 'Wait at least 1 hour between retry attempts' END) AS recommendations,
        sc > 0 AND {RETRYABLE} AND retry_count < 3 AND wc = 0 AND h >= 1 AS ready,
        CASE WHEN sc > 0 AND {RETRYABLE} AND retry_count < 3 AND wc = 0 AND h >= 1 THEN 'READY_FOR_RETRY' ELSE 'NOT_READY' END
          AS validation_status FROM x""",
)
def retry_eligibility(t):
    return tidy(
        loads.retry_eligibility(t.failed_loads, t.staging, t.partly_processed, at(ORDERS_END)).select(
            "batch_id", "failure_reason", "retry_count", "checks_passed", "checks_failed", "recommendations",
            "ready", "validation_status",
        )
    )


APPROVALS = """SELECT 'batch_' || CAST(user_id * 5 AS {string}) AS batch_id,
  CASE WHEN event_type IN ('error', 'view') THEN 'revoke' ELSE 'approve' END AS action, ts AS event_time,
  'user' || CAST(event_id % 7 AS {string}) AS actor FROM @events"""


@query(
    "retry_revoke",
    f"""SELECT batch_id, action = 'approve' AS can_retry, CASE WHEN action = 'approve' THEN event_time END AS retry_validated_at,
      CASE WHEN action = 'approve' THEN actor END AS retry_validated_by, CASE WHEN action = 'revoke' THEN event_time END AS revoked_at,
      CASE WHEN action = 'revoke' THEN actor END AS revoked_by
      FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_time DESC, action DESC) AS rn
        FROM ({APPROVALS.format(string="VARCHAR")})) WHERE rn = 1""",
)
def retry_revoke(t):
    return loads.retry_approvals(t.sql(APPROVALS.format(string="STRING")))


@query(
    "approvals_before",
    f"""SELECT batch_id, count(*) AS decisions FROM ({APPROVALS.format(string="VARCHAR")})
      WHERE event_time >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY GROUP BY 1""",
)
def approvals_before(t):
    recent = filters.since_days(t.sql(APPROVALS.format(string="STRING")), "event_time", at(EVENTS_END), 7)
    return recent.groupBy("batch_id").agg(F.count(F.lit(1)).alias("decisions"))
