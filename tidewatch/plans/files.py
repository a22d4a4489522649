"""Queries: readers, writers and streams, over files written from the tables.

Every run writes to a new folder below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import filters, freshness, loads, profile, rollups, runs, validators
from tidewatch.plans.catalog import query
from tidewatch.plans.common import EVENTS_END, ORDERS_END, at, tidy
from tidewatch.plans.profiling import DATASET_PROFILE, DIRTY_COLUMNS
from tidewatch.plans.validation import CONTRACT, DEFAULTS_SQL, default_results
from tidewatch.session import work_path
from tidewatch.sources import growing, readers, writers
from tidewatch.streaming import live

OT, ET = f"TIMESTAMP '{ORDERS_END}'", f"TIMESTAMP '{EVENTS_END}'"
ORDERS_CSV = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)

# --- readers -----------------------------------------------------------------------


@query("scan_csv", "SELECT event_id, user_id, event_type, nullif(user_id % 5, 0) AS grp, value FROM @events")
def scan_csv(t):
    path = work_path(t.spark, "events.csv")
    rows = t.events.select(
        "event_id", "user_id", "event_type", F.nullif(F.col("user_id") % 5, F.lit(0)).alias("grp"), "value"
    )
    rows.write.option("header", True).csv(path)
    found = readers.read_csv(t.spark, path)
    return found.select(*[F.col(c).cast(k).alias(c) for c, k in rows.dtypes])


@query("scan_csv_spark", "SELECT * FROM @orders")
def scan_csv_spark(t):
    path = work_path(t.spark, "orders.csv")
    t.orders.write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, schema=ORDERS_CSV)


@query("scan_text_csv", "SELECT doc_id, text, lang FROM @documents")
def scan_text_csv(t):
    path = work_path(t.spark, "documents.csv")
    rows = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("text"), "lang")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    found = readers.read_csv(t.spark, path, schema="doc_id bigint, text string, lang string")
    return found.withColumn("text", F.replace("text", F.lit("\\n"), F.lit("\n")))


@query(
    "scan_json",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS events, round(sum(value), 4) AS total FROM @events GROUP BY 1""",
)
def scan_json(t):
    path = work_path(t.spark, "days.json")
    days = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")
    )
    # One whole document per file: each day is one row in a folder of its own.
    days.write.partitionBy("day").json(path)
    return readers.read_json(t.spark, path, schema="events bigint, total double, day date")


@query(
    "scan_by_extension",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, p_partkey, p_name, p_size FROM @part" for k in ("csv", "json", "parquet")),
)
def scan_by_extension(t):
    rows = t.part.select("p_partkey", "p_name", "p_size")
    found = None
    for kind in ("csv", "json", "parquet"):
        path = f"{work_path(t.spark, 'part')}.{kind}"
        writer = rows.write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(path)
        part = readers.read_by_extension(t.spark, path).select(
            F.lit(kind).alias("kind"), F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name",
            F.col("p_size").cast("int").alias("p_size"),
        )
        found = part if found is None else found.unionAll(part)
    return found


@query("scan_object_store", "SELECT event_id, event_type, value FROM @events WHERE event_type IN ('click', 'view')")
def scan_object_store(t):
    path = work_path(t.spark, "objects")
    t.events.select("event_id", "event_type", "value").write.partitionBy("event_type").json(path)
    paths = [f"{path}/event_type={kind}" for kind in ("click", "view")]
    found = readers.read_objects(t.spark, paths, "json", "event_id bigint, value double")
    kind = F.regexp_extract(F.col("_metadata.file_path"), "event_type=([a-z]+)", 1)
    return found.select("event_id", kind.alias("event_type"), "value")


@query("scan_prefix", "SELECT o_orderstatus AS folder, true AS has_files, true AS has_bytes FROM @orders GROUP BY 1")
def scan_prefix(t):
    path = work_path(t.spark, "orders")
    t.orders.write.partitionBy("o_orderstatus").parquet(path)
    files = readers.list_objects(t.spark, path, "*.parquet")
    folder = F.regexp_extract("path", "o_orderstatus=([A-Z])", 1)
    return files.groupBy(folder.alias("folder")).agg(
        (F.count(F.lit(1)) > 0).alias("has_files"), (F.min("size") > 0).alias("has_bytes")
    )


@query(
    "scan_processed_or_raw",
    """SELECT 'processed' AS origin, s_suppkey, s_acctbal FROM @supplier WHERE s_acctbal > 0
      UNION ALL SELECT 'raw', s_suppkey, s_acctbal FROM @supplier""",
)
def scan_processed_or_raw(t):
    raw, processed = f"{work_path(t.spark, 'raw')}.csv", f"{work_path(t.spark, 'processed')}.json"
    absent = f"{work_path(t.spark, 'absent')}.json"
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    rows.write.option("header", True).csv(raw)
    rows.filter("s_acctbal > 0").write.json(processed)
    schema = "s_suppkey bigint, s_acctbal double"
    first = readers.read_processed_or_raw(t.spark, processed, raw, schema=schema)
    second = readers.read_processed_or_raw(t.spark, absent, raw, schema=schema)
    return first.select(F.lit("processed").alias("origin"), "*").unionAll(second.select(F.lit("raw"), "*"))


@query("scan_json_log", "SELECT timestamp, level, logger, message FROM @logs WHERE conv_id % 10 <> 0")
def scan_json_log(t):
    path = work_path(t.spark, "app.log")
    line = F.to_json(F.struct("timestamp", "level", "logger", "message"))
    broken = F.concat(F.lit("{"), line)
    t.logs.select(F.when(F.col("conv_id") % 10 == 0, broken).otherwise(line).alias("value")).write.text(path)
    return readers.read_json_log(t.spark, path)


@query(
    "scan_json_log_tail",
    """SELECT timestamp, level, logger, message FROM @logs WHERE conv_id % 10 <> 0
      ORDER BY timestamp DESC, logger DESC, message DESC LIMIT 100""",
)
def scan_json_log_tail(t):
    return filters.recent(scan_json_log(t), "timestamp", ["logger", "message"], 100)


@query(
    "scan_log_increments",
    """SELECT 1 AS read_number, timestamp, level, logger, message FROM @logs WHERE conv_id % 2 = 0
      UNION ALL SELECT 2, timestamp, level, logger, message FROM @logs WHERE conv_id % 2 <> 0""",
)
def scan_log_increments(t):
    """Two reads of a growing log: the second has the lines added since the first only."""
    path = work_path(t.spark, "app-log")
    line = F.to_json(F.struct("timestamp", "level", "logger", "message")).alias("value")
    t.logs.filter("conv_id % 2 = 0").select(line).write.mode("append").text(path)
    first, offsets = growing.read_new_lines(t.spark, path)
    t.logs.filter("conv_id % 2 <> 0").select(line).write.mode("append").text(path)
    second, _ = growing.read_new_lines(t.spark, path, offsets)
    parts = [growing.json_lines(lines).select(F.lit(n).alias("read_number"), "*") for n, lines in ((1, first), (2, second))]
    return parts[0].unionAll(parts[1])


@query(
    "scan_log_bytes",
    "SELECT true AS has_files, count(*) AS lines FROM @logs",
)
def scan_log_bytes(t):
    path = work_path(t.spark, "app.log")
    t.logs.select(F.to_json(F.struct("timestamp", "level", "logger", "message")).alias("value")).write.text(path)
    lines = t.spark.read.text(path)
    size = rollups.file_bytes(lines).select((F.col("file_size_bytes") > 0).alias("ok"))
    return lines.agg(F.count(F.lit(1)).alias("lines")).withColumn("has_files", size.scalar())


@query("scan_obs_table", "SELECT id, dataset_name, status, pass_rate FROM @audit_logs WHERE status = 'error'")
def scan_obs_table(t):
    path = work_path(t.spark, "audit_logs")
    writers.append(t.audit_logs, path)
    return readers.read_table(t.spark, path).filter("status = 'error'").select(
        "id", "dataset_name", "status", "pass_rate"
    )


@query(
    "load_contracts",
    """SELECT 'contract ' || dataset_name AS contract_name, dataset_name, '1.0.0' AS version, true AS is_active,
      column_name, data_type, required, nullable FROM @contract_columns""",
)
def load_contracts(t):
    path = work_path(t.spark, "contracts")
    column = F.struct(F.col("column_name").alias("name"), "data_type", "required", "nullable")
    # As many entries per document as the dataset has columns.
    documents = t.contract_columns.groupBy("dataset_name").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    documents.select(
        F.concat(F.lit("contract "), "dataset_name").alias("name"), "dataset_name",
        F.struct("columns").alias("schema_definition"), F.col("dataset_name").alias("folder"),
    ).write.partitionBy("folder").json(path)
    return readers.load_contracts(t.spark, path).drop("position")


@query(
    "load_rules",
    """SELECT rule_id, name, rule_type, enabled, severity, array_to_string(tags, ';') AS tags,
      CASE WHEN trim(name) = '' THEN 'name cannot be empty' END AS problem FROM
      (SELECT rule_id, CASE WHEN description LIKE '%Brand#3%' THEN '' ELSE name END AS name, rule_type, enabled, severity, tags
        FROM @rule_table)""",
)
def load_rules(t):
    path = work_path(t.spark, "rules")
    name = F.when(F.contains("description", F.lit("Brand#3")), F.lit(" ")).otherwise(F.col("name"))
    rule = F.struct(
        "rule_id", name.alias("name"), "description", "rule_type", "enabled", F.upper("severity").alias("severity"), "tags"
    )
    # One document with one rule per line, so no document grows with the table.
    t.rule_table.select(F.lit("1.0").alias("version"), F.array(rule).alias("rules")).write.json(path)
    rules = readers.load_rules(t.spark, path, whole_document=False)
    return tidy(rules.select("rule_id", "name", "rule_type", "enabled", "severity", "tags", "problem"))


NAMES = """SELECT doc_id, source || '/' || CAST(doc_id AS {string}) || CASE doc_id % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.json'
  WHEN 2 THEN '.xml' WHEN 3 THEN '.csv' ELSE '.parquet' END AS name FROM @documents"""


@query(
    "file_type_guard",
    f"""SELECT doc_id, name, lower(regexp_extract(name, '([^.]+)$', 1)) AS file_type,
      lower(regexp_extract(name, '([^.]+)$', 1)) IN ('csv', 'json') AS supported FROM ({NAMES.format(string='VARCHAR')})""",
)
def file_type_guard(t):
    return readers.file_type_guard(t.sql(NAMES.format(string="STRING")))


# --- writers ---------------------------------------------------------------------------


@query("sink_processed_json", "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS note FROM @pages")
def sink_processed_json(t):
    path = work_path(t.spark, "processed")
    writers.write_json(t.pages.withColumn("note", F.lit(None).cast("string")), path)
    return t.spark.read.schema("page_id bigint, url string, html string, note string").json(path)


@query("sink_format_partitioned", "SELECT l_orderkey, l_extendedprice, l_returnflag, l_linestatus FROM @lineitem")
def sink_format_partitioned(t):
    path = writers.dated_path(work_path(t.spark, "processed"), 2001, 8, 2)
    rows = t.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    writers.write_partitioned(rows, path, "parquet", ["l_returnflag", "l_linestatus"])
    return t.spark.read.parquet(path)


@query(
    "ingest_summary",
    """SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM @customer) AS record_count FROM @customer
      ORDER BY c_custkey LIMIT 5""",
)
def ingest_summary(t):
    """The first written rows and the number of all, which the job that writes has counted."""
    path = f"{work_path(t.spark, 'ingested')}/customers"
    report = writers.write_observed(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return t.spark.read.parquet(path).orderBy("c_custkey").limit(5).withColumn("record_count", F.lit(report.record_count))


@query(
    "ingest_observed",
    """SELECT 'nulls' AS kind, 'order_id' AS name, count(*) - count(order_id) AS failed_records, count(*) AS total_records FROM @dirty_orders
      UNION ALL SELECT 'nulls', 'priority', count(*) - count(priority), count(*) FROM @dirty_orders
      UNION ALL SELECT 'nulls', 'total', count(*) - count(total), count(*) FROM @dirty_orders
      UNION ALL SELECT 'check', 'positive', count(*) - count(*) FILTER (WHERE total > 0), count(*) FROM @dirty_orders
      UNION ALL SELECT 'written', 'rows', count(*), count(*) FROM @dirty_orders""",
)
def ingest_observed(t):
    """Counts, NULLs and a check, all measured by the job that writes."""
    path = f"{work_path(t.spark, 'ingested')}/orders"
    rows = t.dirty_orders.select("order_id", "priority", "total")
    report = writers.write_observed(rows, path, checks={"positive": F.col("total") > 0}, allowed={"positive": 1.0})
    kept = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("failed_records"), F.count(F.lit(1)).alias("total_records"))
    return report.rows(t.spark).unionByName(kept.select(F.lit("written").alias("kind"), F.lit("rows").alias("name"), "*"))


AUDIT_SQL = f"""WITH d AS ({DEFAULTS_SQL})
  SELECT dataset_name, replace(lower(validator_name), 'validator', '') AS validation_type, status, total_records, failed_records,
    pass_rate, validator_name, 'system' AS triggered_by, 'dev' AS environment, {OT} AS created_at FROM d"""


def _appended_audit(t, results):
    path = work_path(t.spark, "audit_logs")
    writers.append(runs.audit_rows(results, "system", "dev", at(ORDERS_END)), path)
    return readers.read_table(t.spark, path)


@query("append_audit", AUDIT_SQL)
def append_audit(t):
    return tidy(_appended_audit(t, default_results(t)).drop("error_summary"))


@query(
    "append_validation_log",
    f"""WITH d AS ({DEFAULTS_SQL})
      SELECT dataset_name, replace(lower(validator_name), 'validator', '') AS validation_type, status, total_records, failed_records,
        pass_rate, validator_name, message, {OT} AS created_at FROM d
      UNION ALL SELECT dataset_name, 'aggregated', CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'error'
          WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed'
          WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'passed' END,
        arg_min(total_records, position) FILTER (WHERE total_records > 0), 0,
        CASE WHEN count(*) FILTER (WHERE status <> 'passed') = 0 THEN 1e2 ELSE 0e0 END, 'ValidationAggregator',
        'Executed ' || count(*) || ' validators: ' || count(*) FILTER (WHERE status = 'passed') || ' passed, '
          || count(*) FILTER (WHERE status = 'failed') || ' failed, ' || count(*) FILTER (WHERE status = 'warning') || ' warnings',
        {OT} FROM d GROUP BY 1""",
)
def append_validation_log(t):
    path = work_path(t.spark, "validation_logs")
    writers.append(runs.validation_log_rows(default_results(t), at(ORDERS_END)), path)
    return tidy(readers.read_table(t.spark, path))


@query(
    "append_metric",
    """SELECT 'validation_success' AS metric_name, 1e0 AS metric_value, 'counter' AS metric_type, ts AS timestamp, value AS execution_time,
        'ds' || user_id % 5 AS dataset_name, event_type AS validation_type, CAST(NULL AS VARCHAR) AS dag_id,
        CAST(NULL AS VARCHAR) AS task_id FROM @events WHERE event_type = 'click'
      UNION ALL SELECT 'api_request_duration', value, 'histogram', ts, value, NULL, NULL, NULL, NULL FROM @events WHERE event_type = 'view'""",
)
def append_metric(t):
    path = work_path(t.spark, "metrics")
    dataset = F.concat(F.lit("ds"), (F.col("user_id") % 5).cast("string"))
    success = writers.metric_row(
        t.events.filter("event_type = 'click'"), "validation_success",
        writers.STANDARD_METRICS["validation_success"], F.lit(1), F.col("ts"), execution_time=F.col("value"),
        dataset_name=dataset, validation_type=F.col("event_type"),
    )
    duration = writers.metric_row(
        t.events.filter("event_type = 'view'"), "api_request_duration",
        writers.STANDARD_METRICS["api_request_duration"], F.col("value"), F.col("ts"), execution_time=F.col("value"),
    )
    writers.append(success, path)
    writers.append(duration, path)
    return readers.read_table(t.spark, path)


@query(
    "append_freshness",
    f"""WITH o AS (SELECT *, date_diff('microsecond', ingestion_start, {ET}) / 36e8 AS age,
        date_diff('microsecond', ingestion_start, coalesce(validation_end, ingestion_end)) / 36e8 AS lat FROM @operations)
      SELECT id, dataset_name, CAST(format('{{:.2f}}', age) AS DOUBLE) AS dataset_age_hours, CAST(format('{{:.2f}}', lat) AS DOUBLE) AS actual_latency_hours,
        date_diff('microsecond', ingestion_start, ingestion_end) / 1e6 AS ingestion_latency_seconds,
        date_diff('microsecond', validation_start, validation_end) / 1e6 AS validation_latency_seconds FROM o""",
)
def append_freshness(t):
    path = work_path(t.spark, "freshness_metrics")
    writers.append(freshness.freshness_rows(t.operations, at(EVENTS_END)), path, ["freshness_status"])
    return readers.read_table(t.spark, path).select(
        "id", "dataset_name", "dataset_age_hours", "actual_latency_hours", "ingestion_latency_seconds",
        "validation_latency_seconds",
    )


@query(
    "append_staging",
    """SELECT 'docs' AS dataset_name, 'batch_' || lang AS batch_id, source AS source_system, text AS raw_data, sha256(text) AS record_hash,
      false AS is_processed, CAST(NULL AS TIMESTAMP) AS processed_at, CAST(NULL AS VARCHAR) AS error_message FROM @documents""",
)
def append_staging(t):
    path = work_path(t.spark, "staging")
    batch = F.concat(F.lit("batch_"), "lang")
    rows = loads.staging_rows(t.documents, F.lit("docs"), batch, F.col("source"), F.col("text"))
    writers.append(rows, path)
    return readers.read_table(t.spark, path)


@query(
    "append_processed",
    f"""SELECT 'docs' AS dataset_name, 'batch_' || lang AS batch_id, source AS source_system, CAST(doc_id AS VARCHAR) AS source_record_id,
      text AS data, sha256(text) AS record_hash, n_chars * 1e0 AS data_quality_score,
      CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'passed' END AS validation_status, {OT} AS load_timestamp,
      CAST(NULL AS VARCHAR) AS partition_key FROM @documents""",
)
def append_processed(t):
    path = work_path(t.spark, "processed")
    rows = loads.processed_rows(
        t.documents, F.lit("docs"), F.concat(F.lit("batch_"), "lang"), F.col("source"), F.col("text"),
        at(ORDERS_END), F.col("doc_id"), F.sha2("text", 256), F.col("n_chars"),
        F.when(F.col("doc_id") % 3 == 0, "warning"),
    )
    writers.append(rows, path)
    return readers.read_table(t.spark, path)


@query(
    "export_csv",
    """SELECT '"' || rule_id || '","' || replace(name, '"', '""') || '","' || CASE WHEN enabled THEN 'say ""yes""' ELSE '' END || '","'
      || '[""' || tags[1] || '"",""' || tags[2] || '""]"' AS line FROM @rule_table""",
)
def export_csv(t):
    path = work_path(t.spark, "export")
    rows = t.rule_table.select("rule_id", "name", F.when(F.col("enabled"), 'say "yes"').alias("answer"), "tags")
    writers.export_csv(rows, path)
    lines = t.spark.read.text(path).withColumnRenamed("value", "line")
    return lines.filter(F.col("line") != '"Rule id","Name","Answer","Tags"')


@query(
    "append_profile",
    f"""SELECT dataset_name, column_name, row_count, null_count, median, unique_count, 'completed' AS status,
      'system' AS profiled_by, {OT} AS profiled_at FROM ({DATASET_PROFILE})""",
)
def append_profile(t):
    path = work_path(t.spark, "profiling_results")
    rows = writers.profile_rows(
        profile.profile_dataset(t.dirty_orders, "orders", DIRTY_COLUMNS), "system", at(ORDERS_END)
    )
    writers.append(rows, path)
    return tidy(
        readers.read_table(t.spark, path).select(
            "dataset_name", "column_name", "row_count", "null_count", "median", "unique_count", "status",
            "profiled_by", "profiled_at",
        )
    )


@query(
    "pipeline_ingest_validate_audit",
    f"""WITH a AS ({AUDIT_SQL})
      SELECT 'audit' AS step, validation_type AS label, status, total_records FROM a
      UNION ALL SELECT 'completion', 'run_1', CASE WHEN bool_and(status = 'passed') THEN 'success' ELSE 'failed' END,
        arg_max(total_records, total_records) FROM a""",
)
def pipeline_ingest_validate_audit(t):
    raw = f"{work_path(t.spark, 'raw_orders')}.csv"
    rows = t.dirty_orders
    rows.write.option("header", True).csv(raw)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    ingested = readers.read_csv(t.spark, raw, schema=schema)
    results = runs.validate_with_defaults(
        ingested, "dirty_orders", CONTRACT, checksum_columns=["order_id", "total"]
    )
    audit = _appended_audit(t, results)
    completion = audit.agg(
        F.when(F.bool_and(F.col("status") == "passed"), "success").otherwise("failed").alias("status"),
        F.max("total_records").alias("total_records"),
    )
    return audit.select(
        F.lit("audit").alias("step"), F.col("validation_type").alias("label"), "status", "total_records"
    ).unionAll(completion.select(F.lit("completion"), F.lit("run_1"), "status", "total_records"))


@query(
    "batch_rewrite",
    "SELECT batch_id, status, records_loaded FROM @load_history WHERE batch_id <> 'batch_9'",
)
def batch_rewrite(t):
    old, new = work_path(t.spark, "history"), work_path(t.spark, "history")
    writers.append(t.load_history, old)
    writers.replace_table(loads.without_batch(readers.read_table(t.spark, old), "batch_9"), new)
    return readers.read_table(t.spark, new).select("batch_id", "status", "records_loaded")


# --- streams -------------------------------------------------------------------------------


def _event_stream(t):
    return live.file_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")


def _finish(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(
    "stream_counters",
    """SELECT event_type, user_id, count(*) AS "count", round(sum(value), 4) AS total FROM @events GROUP BY 1, 2""",
)
def stream_counters(t):
    sink, checkpoint = work_path(t.spark, "counters"), work_path(t.spark, "offsets")
    keys = ["event_type", "user_id"]
    _finish(live.stream_counters(_event_stream(t), keys, "value", sink, checkpoint))
    return tidy(live.current_state(t.spark, sink, keys, ["count", "total"]))


@query(
    "stream_idle_counters",
    """SELECT event_type, user_id, count(*) AS "count", round(sum(value), 4) AS total FROM @events GROUP BY 1, 2""",
)
def stream_idle_counters(t):
    """Counters whose state goes when a key is idle for a day; the totals stay whole."""
    sink, checkpoint = work_path(t.spark, "counters"), work_path(t.spark, "offsets")
    keys = ["event_type", "user_id"]
    _finish(live.expiring_counters(_event_stream(t), keys, "value", "ts", sink, checkpoint, idle="1 day", late="1 hour"))
    return tidy(live.session_totals(t.spark, sink, keys))


@query(
    "stream_timeseries",
    """SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS "count", round(sum(value), 4) AS total
        FROM @events GROUP BY 1, 2)
      WHERE hour > (SELECT max(date_trunc('hour', ts)) FROM @events) - INTERVAL 24 HOUR""",
)
def stream_timeseries(t):
    sink, checkpoint = work_path(t.spark, "series"), work_path(t.spark, "offsets")
    _finish(live.stream_timeseries(_event_stream(t), "ts", ["event_type"], "value", sink, checkpoint))
    series = live.current_state(t.spark, sink, ["hour", "event_type"], ["count", "total"])
    return tidy(live.retained(series, "hour"))


@query(
    "stream_ingest",
    """SELECT 'NullValidator' AS validator_name, count(*) AS total_records, count(*) - count(nullif(event_type, 'error')) AS failed_records
      FROM @events""",
)
def stream_ingest(t):
    sink, checkpoint = work_path(t.spark, "results"), work_path(t.spark, "offsets")
    files = _event_stream(t).select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    _finish(live.stream_ingest(files, lambda batch: validators.null_check(batch, ["event_type"]), sink, checkpoint))
    results = t.spark.read.parquet(sink)
    return results.groupBy("validator_name").agg(
        F.sum("total_records").alias("total_records"), F.sum("failed_records").alias("failed_records")
    )
