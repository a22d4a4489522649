"""Monitoring tables derived from the test tables.

Each text is plain SQL that Spark and the checking engine both run, so the two
sides of a comparison start from the same rows; ``@name`` stands for a base
table. Only adding seconds and building arrays differ between the dialects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def add_seconds(self, ts: str, seconds: str) -> str:
        if self.spark:
            return f"timestampadd(SECOND, CAST(floor({seconds}) AS INT), {ts})"
        return f"({ts} + to_seconds(CAST(floor({seconds}) AS BIGINT)))"

    def array(self, *items: str) -> str:
        inner = ", ".join(items)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def empty(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)" if self.spark else "CAST([] AS VARCHAR[])"


def audit_logs(d: Dialect) -> str:
    e = "'check ' || CAST(o_orderkey % 3 AS STRING)"
    return f"""
    SELECT o_orderkey AS id,
      CASE WHEN o_custkey % 37 = 0 THEN '' ELSE 'Dataset_' || CAST(o_custkey % 8 AS STRING) END AS dataset_name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'null' WHEN '2-HIGH' THEN 'schema'
        WHEN '3-MEDIUM' THEN 'datatype' WHEN '4-NOT SPECIFIED' THEN 'checksum'
        ELSE 'columnexistence' END AS validation_type,
      CASE WHEN o_orderkey % 20 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'passed'
        WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'warning' END AS status,
      o_custkey % 1000 + 100 AS total_records,
      CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 90 END AS failed_records,
      CASE WHEN o_orderstatus = 'F' THEN 1e2 ELSE
        (o_custkey % 1000 + 100 - o_orderkey % 90) * 1e2 / (o_custkey % 1000 + 100) END AS pass_rate,
      CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice / 1e3 END AS execution_time_ms,
      'Validator' || CAST(o_custkey % 5 AS STRING) AS validator_name,
      CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Null validation failed: '
        || CAST(o_custkey % 40 AS STRING) || ' issue(s) found in the nightly load of the reporting '
        || 'warehouse, region ' || CAST(o_custkey % 4 AS STRING) || ', see order '
        || CAST(o_orderkey AS STRING) END AS message,
      CASE o_orderkey % 4 WHEN 0 THEN {d.empty()} WHEN 1 THEN {d.array(e)}
        WHEN 2 THEN {d.array(e, "'b'")} ELSE {d.array("'a'", "'b'", "'c'", e)} END AS errors,
      CASE o_custkey % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'scheduler' WHEN 2 THEN 'api'
        WHEN 3 THEN NULL ELSE 'admin' END AS triggered_by,
      CASE o_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment,
      CAST(o_custkey % 30 AS INT) AS columns_checked,
      {d.add_seconds('o_orderdate', 'o_orderkey % 86400')} AS created_at
    FROM @orders"""


def metrics(d: Dialect) -> str:
    return """
    SELECT event_id AS id,
      CASE event_type || CAST(user_id % 2 AS STRING)
        WHEN 'click0' THEN 'validation_success' WHEN 'click1' THEN 'validation_duration'
        WHEN 'error0' THEN 'validation_failure' WHEN 'error1' THEN 'ingestion_failure'
        WHEN 'view0' THEN 'validation_warning' WHEN 'view1' THEN 'api_request_duration'
        WHEN 'signup0' THEN 'ingestion_execution' WHEN 'purchase0' THEN 'ingestion_duration'
        ELSE 'ingestion_success' END AS metric_name,
      value AS metric_value,
      CASE WHEN event_type = 'click' THEN 'counter' ELSE 'histogram' END AS metric_type,
      CASE WHEN user_id % 9 = 0 THEN NULL ELSE value * 2 END AS execution_time,
      ts AS timestamp,
      CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'ds' || CAST(user_id % 5 AS STRING) END AS dataset_name,
      nullif(event_type, 'signup') AS validation_type
    FROM @events"""


def operations(d: Dialect) -> str:
    end = d.add_seconds("ts", "value * 1500")
    return f"""
    SELECT event_id AS id,
      CASE user_id % 6 WHEN 0 THEN 'customers' WHEN 1 THEN 'Orders' WHEN 2 THEN 'transactions'
        WHEN 3 THEN 'inventory' WHEN 4 THEN 'analytics' ELSE 'other' END AS dataset_name,
      ts AS ingestion_start,
      CASE WHEN event_type = 'signup' THEN NULL ELSE {end} END AS ingestion_end,
      {d.add_seconds(end, '60')} AS validation_start,
      CASE WHEN event_type = 'error' THEN NULL ELSE {d.add_seconds(end, '60 + value')} END AS validation_end
    FROM @events"""


def operation_events(d: Dialect) -> str:
    base = operations(d)
    kinds = ("ingestion_start", "ingestion_end", "validation_start", "validation_end")
    return " UNION ALL ".join(
        f"SELECT id AS operation_id, dataset_name, '{k}' AS event, {k} AS event_time "
        f"FROM ({base}) AS o{i} WHERE {k} IS NOT NULL"
        for i, k in enumerate(kinds)
    )


def freshness(d: Dialect) -> str:
    return """
    SELECT event_id AS id,
      CASE user_id % 6 WHEN 0 THEN 'customers' WHEN 1 THEN 'orders' WHEN 2 THEN 'transactions'
        WHEN 3 THEN 'inventory' WHEN 4 THEN 'analytics' ELSE 'other' END AS dataset_name,
      'pipeline_' || CAST(user_id % 10 AS STRING) AS pipeline_name,
      ts AS ingestion_timestamp,
      value / 4 AS dataset_age_hours,
      CASE WHEN value < 60 THEN 'healthy' WHEN value < 150 THEN 'warning' ELSE 'critical' END AS freshness_status,
      CASE WHEN event_type = 'error' THEN NULL WHEN value < 90 THEN 'compliant' ELSE 'breached' END AS sla_status,
      CASE WHEN event_type = 'signup' THEN NULL ELSE value * 3 END AS ingestion_latency_seconds,
      CASE WHEN event_type = 'error' THEN NULL ELSE value * 5 END AS validation_latency_seconds,
      value * 8 AS total_latency_seconds
    FROM @events"""


def load_history(d: Dialect) -> str:
    started = d.add_seconds("o_orderdate", "o_orderkey % 86400")
    return f"""
    SELECT 'batch_' || CAST(o_orderkey AS STRING) AS batch_id,
      'ds' || CAST(o_orderkey % 5 AS STRING) AS dataset_name,
      CASE o_custkey % 3 WHEN 0 THEN 'full' ELSE 'incremental' END AS load_type,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
      o_custkey % 500 + 10 AS records_attempted,
      CASE WHEN o_orderstatus = 'F' THEN o_custkey % 500 ELSE 0 END AS records_loaded,
      CASE WHEN o_orderstatus = 'O' THEN o_custkey % 77 ELSE 0 END AS records_failed,
      o_custkey % 10 AS records_duplicate,
      o_totalprice AS execution_duration_ms,
      {started} AS started_at,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {d.add_seconds(started, 'o_totalprice / 100')} END AS completed_at,
      CAST(NULL AS STRING) AS error_message
    FROM @orders"""


def staging(d: Dialect) -> str:
    return """
    SELECT 'batch_' || CAST(l_orderkey AS STRING) AS batch_id,
      'ds' || CAST(l_orderkey % 5 AS STRING) AS dataset_name,
      md5(CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) AS record_hash,
      'part ' || CAST(l_partkey AS STRING) || ' supplier ' || CAST(l_suppkey AS STRING) || ' price '
        || CAST(l_extendedprice AS STRING) AS raw_data,
      l_linestatus = 'F' AS is_processed,
      CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'timeout on line '
        || CAST(l_linenumber AS STRING) END AS error_message
    FROM @lineitem"""


def processed(d: Dialect) -> str:
    """Loaded records; those of returned lines have failed their checks."""
    return f"""
    SELECT 'batch_' || CAST(l_orderkey AS STRING) AS batch_id,
      'ds' || CAST(l_orderkey % 5 AS STRING) AS dataset_name,
      CAST(l_partkey AS STRING) AS source_record_id,
      CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'warning' ELSE 'failed' END AS validation_status,
      l_discount * 10 AS data_quality_score,
      l_extendedprice AS price,
      {d.add_seconds('l_shipdate', 'l_orderkey % 86400')} AS load_timestamp,
      l_shipdate AS created_at
    FROM @lineitem"""


def partly_processed(d: Dialect) -> str:
    """A warehouse in which the records of returned lines are missing, as the verification is to find."""
    return "SELECT * FROM @processed WHERE validation_status <> 'failed'"


def failed_loads(d: Dialect) -> str:
    failed = d.add_seconds("o_orderdate", "o_orderkey % 86400")
    return f"""
    SELECT 'batch_' || CAST(o_orderkey AS STRING) AS batch_id,
      'ds' || CAST(o_orderkey % 5 AS STRING) AS dataset_name,
      CASE o_custkey % 6 WHEN 0 THEN 'Connection_Error: db-1' WHEN 1 THEN 'read timeout'
        WHEN 2 THEN 'schema mismatch' WHEN 3 THEN 'RESOURCE_LIMIT reached' WHEN 4 THEN 'disk full'
        ELSE 'network_error' END AS failure_reason,
      CAST(o_custkey % 5 AS INT) AS retry_count,
      o_custkey % 4 = 0 AS can_retry,
      CASE WHEN o_custkey % 3 = 0 THEN {d.add_seconds(failed, '7200')} END AS retry_validated_at,
      {failed} AS load_failed_at,
      o_orderdate AS created_at
    FROM @orders WHERE o_orderstatus = 'O'"""


def load_audit(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS id, 'batch_' || CAST(o_orderkey AS STRING) AS batch_id,
      'ds' || CAST(o_orderkey % 5 AS STRING) AS dataset_name,
      CASE WHEN o_orderkey % 11 = 0 THEN 'retrying' WHEN o_orderstatus = 'F' THEN 'completed'
        WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'started' END AS load_status,
      CAST(floor(o_totalprice / 100) AS INT) AS execution_time_seconds,
      {d.add_seconds('o_orderdate', 'o_orderkey % 86400')} AS created_at
    FROM @orders"""


def load_events(d: Dialect) -> str:
    start = d.add_seconds("o_orderdate", "o_orderkey % 86400")
    key = """'batch_' || CAST(o_orderkey AS STRING) AS batch_id,
      'ds' || CAST(o_orderkey % 5 AS STRING) AS dataset_name"""
    none = "CAST(NULL AS STRING)"
    return f"""
    SELECT {key}, 'started' AS event, {start} AS event_time, CAST(0 AS BIGINT) AS records, {none} AS reason FROM @orders
    UNION ALL
    SELECT {key}, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END,
      {d.add_seconds(start, 'o_custkey % 900 + 5')}, o_custkey % 700,
      CASE WHEN o_orderstatus = 'F' THEN {none} ELSE 'timeout' END
    FROM @orders WHERE o_orderstatus <> 'P'
    UNION ALL
    SELECT {key}, 'retrying', {d.add_seconds(start, '5000')}, CAST(0 AS BIGINT), 'timeout'
    FROM @orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0"""


def retries(d: Dialect) -> str:
    return f"""
    SELECT event_id AS id, event_id * 7 % 20000 AS validation_log_id,
      CASE event_type WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
        WHEN 'signup' THEN 'in_progress' ELSE 'cancelled' END AS retry_status,
      CAST(user_id % 4 AS INT) AS retry_count, CAST(3 AS INT) AS max_retries,
      'user' || CAST(user_id % 12 AS STRING) AS initiated_by,
      ts AS created_at,
      CASE WHEN event_type IN ('purchase', 'view') THEN {d.add_seconds('ts', 'value')} END AS completed_at,
      CAST(NULL AS STRING) AS error_message
    FROM @events"""


def attempts(d: Dialect) -> str:
    return """
    SELECT event_id AS attempt_id, user_id * 13 % 5000 AS retry_id, ts AS attempt_at,
      CASE event_type WHEN 'click' THEN 'passed' WHEN 'view' THEN 'warning' ELSE 'failed' END AS status,
      'user' || CAST(user_id % 12 AS STRING) AS executor
    FROM @events"""


def retry_queue(d: Dialect) -> str:
    return """
    SELECT o_orderkey AS retry_id,
      CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'failed' ELSE 'in_progress' END AS retry_status,
      CAST(o_custkey % 3 AS INT) AS retry_count, CAST(o_custkey % 70 + 3 AS INT) AS max_retries
    FROM @orders"""


def dag_runs(d: Dialect) -> str:
    start = d.add_seconds("o_orderdate", "o_orderkey % 86400")
    return f"""
    SELECT 'dag_' || CAST(o_custkey % 12 + 10 AS STRING) AS dag_id,
      'run_' || CAST(o_orderkey AS STRING) AS dag_run_id, o_orderdate AS execution_date,
      CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS state,
      {start} AS start_date,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {d.add_seconds(start, 'o_totalprice / 50')} END AS end_date,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice / 50) * 1e0 END AS duration_seconds
    FROM @orders"""


def run_events(d: Dialect) -> str:
    start = d.add_seconds("o_orderdate", "o_orderkey % 86400")
    none = "CAST(NULL AS INT)"
    return f"""
    SELECT 'run_' || CAST(o_orderkey AS STRING) AS dag_run_id, {start} AS event_time,
      'dag_' || CAST(o_custkey % 12 + 10 AS STRING) AS dag_id, 'running' AS state, {start} AS start_date,
      CAST(NULL AS TIMESTAMP{'_NTZ' if d.spark else ''}) AS end_date,
      CAST(0 AS INT) AS total_tasks, CAST(0 AS INT) AS completed_tasks, CAST(0 AS INT) AS failed_tasks
    FROM @orders
    UNION ALL
    SELECT 'run_' || CAST(o_orderkey AS STRING), {d.add_seconds(start, 'o_totalprice / 50')}, NULL,
      CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END, NULL,
      {d.add_seconds(start, 'o_totalprice / 50')}, CAST(o_custkey % 9 + 1 AS INT),
      CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 9 + 1 AS INT) ELSE {none} END,
      CASE WHEN o_orderstatus = 'O' THEN CAST(1 AS INT) ELSE {none} END
    FROM @orders WHERE o_orderstatus <> 'P'"""


def observations(d: Dialect) -> str:
    """A schema per user and day: its columns are the event types seen that day."""
    return """
    SELECT 'user_' || CAST(user_id AS STRING) AS dataset_name, date_trunc('day', ts) AS observed_at,
      event_type AS column_name,
      CASE WHEN count(*) > 1 THEN 'integer' ELSE 'string' END AS data_type,
      max(value) < 40 AS nullable
    FROM @events GROUP BY user_id, date_trunc('day', ts), event_type"""


def contract_columns(d: Dialect) -> str:
    """A contract per user group, from the types of events its first users produce."""
    return """
    SELECT 'group_' || CAST(user_id % 20 AS STRING) AS dataset_name,
      event_type || '_' || CAST(user_id % 3 AS STRING) AS column_name,
      CASE WHEN min(value) < 0.3 THEN 'integer' WHEN max(value) > 150 THEN 'Float' ELSE 'string' END AS data_type,
      min(value) < 0.5 AS required, max(value) > 100 AS nullable
    FROM @events GROUP BY user_id % 20, event_type, user_id % 3"""


def observed_columns(d: Dialect) -> str:
    """The columns found: some of the contract are missing by their name, some are new, some changed their type."""
    return """
    SELECT 'group_' || CAST(user_id % 20 AS STRING) AS dataset_name,
      CASE WHEN max(value) > 250 THEN 'new_' ELSE '' END || event_type || '_' || CAST(user_id % 3 AS STRING)
        AS column_name,
      CASE WHEN min(value) < 0.3 THEN 'int64' WHEN max(value) > 120 THEN ' DOUBLE ' ELSE 'object' END AS data_type,
      min(value) < 1 AS nullable
    FROM @events GROUP BY user_id % 20, event_type, user_id % 3
    HAVING event_type || CAST(user_id % 3 AS STRING) NOT IN ('signup1', 'error2')"""


def rule_table(d: Dialect) -> str:
    return f"""
    SELECT 'rule_' || CAST(p_partkey AS STRING) AS rule_id, p_name AS name,
      p_brand || ' of type ' || p_type AS description,
      CASE p_size % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'null_check' WHEN 2 THEN 'pattern' ELSE 'uniqueness' END
        AS rule_type,
      p_size % 3 <> 0 AS enabled,
      CASE p_size % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity,
      {d.array("p_type", "p_brand")} AS tags
    FROM @part"""


def logs(d: Dialect) -> str:
    start = "TIMESTAMP_NTZ '2024-01-01 00:00:00'" if d.spark else "TIMESTAMP '2024-01-01 00:00:00'"
    return f"""
    SELECT conv_id, turn,
      {d.add_seconds(start, 'conv_id % 500 * 40 + turn * 7')} AS timestamp,
      CASE (conv_id + turn) % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'DEBUG' END
        AS level,
      'app.' || role AS logger, text AS message
    FROM @conversations"""


def records(d: Dialect) -> str:
    """JSON records with missing keys, wrong types and repeated keys."""
    o, c = ("{{", "}}") if d.spark else ("{", "}")
    return f"""
    SELECT event_id AS idx,
      '{o}"id": ' || CAST(event_id % 9000 AS STRING)
      || CASE WHEN user_id % 17 = 0 THEN '' ELSE ', "kind": "' || event_type || '"' END
      || ', "amount": ' || CASE WHEN user_id % 23 = 0 THEN '"n/a"' WHEN user_id % 29 = 0 THEN 'null'
           ELSE CAST(value AS STRING) END
      || ', "active": ' || CASE WHEN user_id % 31 = 0 THEN '"yes"' ELSE 'true' END
      || CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN '' ELSE ', "user": ' || CAST(user_id AS STRING) END
      || '{c}' AS payload
    FROM @events"""


def lineage_edges(d: Dialect) -> str:
    return """
    SELECT 'mart_' || CAST(c.c_nationkey AS STRING) AS target_dataset, 'src_' || o.o_orderpriority AS upstream_dataset,
      CASE o.o_orderstatus WHEN 'F' THEN 'filter' WHEN 'O' THEN 'join' ELSE 'aggregate' END AS transformation
    FROM @orders AS o JOIN @customer AS c ON o.o_custkey = c.c_custkey"""


def requests(d: Dialect) -> str:
    return """
    SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, url AS path,
      CAST(CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS INT) AS status_code
    FROM @pages"""


def dirty_orders(d: Dialect) -> str:
    """Orders with NULLs, odd texts and a bad foreign key, as a dataset under test."""
    return """
    SELECT o_orderkey AS order_id, nullif(o_custkey % 300, 0) AS customer_id,
      nullif(o_orderpriority, '5-LOW') AS priority,
      CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS quantity_text,
      CASE WHEN o_orderkey % 10 = 0 THEN 'not a date' ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END
        AS date_text,
      CASE WHEN o_orderkey % 8 = 0 THEN 'yes' ELSE 'true' END AS flag_text,
      o_totalprice AS total, CAST(NULL AS STRING) AS comment
    FROM @orders"""


def fk_child(d: Dialect) -> str:
    return """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, nullif(l_orderkey * (l_orderkey % 7), 0) AS order_ref,
      l_orderkey % 7 AS spread, l_suppkey AS supplier_ref
    FROM @lineitem"""


def fk_orders(d: Dialect) -> str:
    return "SELECT o_orderkey * (o_orderkey % 7) AS order_id FROM @orders WHERE o_orderstatus <> 'P'"


def fk_suppliers(d: Dialect) -> str:
    return "SELECT s_suppkey AS supplier_id FROM @supplier WHERE s_acctbal > 1000"


ADAPTERS = {
    f.__name__: f
    for f in (
        audit_logs, metrics, operations, operation_events, freshness, load_history, staging, processed, partly_processed,
        failed_loads, load_audit, load_events, retries, attempts, retry_queue, dag_runs, run_events,
        observations, contract_columns, observed_columns, rule_table, logs, records, lineage_edges,
        requests, dirty_orders, fk_child, fk_orders, fk_suppliers,
    )
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NAME = re.compile(r"@(\w+)")


class Tables:
    """Base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in ADAPTERS:
            return self.sql(ADAPTERS[name](Dialect(spark=True)))
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which ``@name`` is a base or derived table."""
        used = {n: getattr(self, n) for n in set(_NAME.findall(text))}
        return self.spark.sql(_NAME.sub(r"{\1}", text), **used)


def oracle_text(text: str) -> str:
    """SQL for the checking engine: derived tables become subqueries, base tables stay."""
    def replace(match: re.Match) -> str:
        name = match.group(1)
        if name in ADAPTERS:
            return f"({oracle_text(ADAPTERS[name](Dialect(spark=False)))})"
        return name

    return _NAME.sub(replace, text)
