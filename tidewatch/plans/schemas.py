"""Queries: contracts, schema versions and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.ordering import latest_per_key
from tidewatch.operators import contracts, drift, filters, rollups
from tidewatch.plans.catalog import query
from tidewatch.plans.common import at
from tidewatch.session import work_path
from tidewatch.sources import readers, writers

NORMAL = """CASE trim(lower({c})) WHEN 'int64' THEN 'integer' WHEN 'object' THEN 'string' WHEN 'double' THEN 'float'
  ELSE trim(lower({c})) END"""
C, O = "@contract_columns", "@observed_columns"
SAME = "w.dataset_name = h.dataset_name AND w.column_name = h.column_name"

MISSING = f"""SELECT w.dataset_name, 'missing_column' AS error_type, w.column_name, 'Required column: ' || w.column_name AS expected,
  'Column not found' AS actual, 'Required column ''' || w.column_name || ''' is missing from dataset' AS message
  FROM {C} AS w WHERE required AND NOT EXISTS (SELECT 1 FROM {O} AS h WHERE {SAME})"""
UNEXPECTED = f"""SELECT h.dataset_name, 'unexpected_column' AS error_type, h.column_name, 'Column should not exist' AS expected,
  'Column found: ' || h.column_name AS actual,
  'Column ''' || h.column_name || ''' exists in dataset but not in contract' AS message
  FROM {O} AS h WHERE NOT EXISTS (SELECT 1 FROM {C} AS w WHERE {SAME})"""
MISMATCH = f"""SELECT w.dataset_name, 'type_mismatch' AS error_type, w.column_name, w.data_type AS expected, h.data_type AS actual,
  'Column ''' || w.column_name || ''' has type ''' || h.data_type || ''' but expected ''' || w.data_type || '''' AS message
  FROM {C} AS w JOIN {O} AS h ON {SAME} WHERE {NORMAL.format(c="w.data_type")} <> {NORMAL.format(c="h.data_type")}"""
VERDICTS = f"""WITH e AS ({MISSING} UNION ALL {UNEXPECTED} UNION ALL {MISMATCH}),
  w AS (SELECT dataset_name, count(*) AS total_columns_expected FROM {C} GROUP BY 1),
  h AS (SELECT dataset_name, count(*) AS total_columns_actual FROM {O} GROUP BY 1),
  g AS (SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE error_type = 'missing_column') AS m,
    count(*) FILTER (WHERE error_type = 'unexpected_column') AS u, count(*) FILTER (WHERE error_type = 'type_mismatch') AS t FROM e GROUP BY 1)
  SELECT w.dataset_name, total_columns_expected, coalesce(total_columns_actual, 0) AS total_columns_actual,
    coalesce(n, 0) AS error_count, coalesce(m, 0) AS missing_columns, coalesce(u, 0) AS unexpected_columns,
    coalesce(t, 0) AS type_mismatches, coalesce(n, 0) = 0 AS is_valid
  FROM w LEFT JOIN h ON w.dataset_name = h.dataset_name LEFT JOIN g ON w.dataset_name = g.dataset_name"""


@query("contract_missing", MISSING)
def contract_missing(t):
    return contracts.contract_missing(t.contract_columns, t.observed_columns)


@query("contract_unexpected", UNEXPECTED)
def contract_unexpected(t):
    return contracts.contract_unexpected(t.contract_columns, t.observed_columns)


@query("contract_type_mismatch", MISMATCH)
def contract_type_mismatch(t):
    return contracts.contract_type_mismatch(t.contract_columns, t.observed_columns)


@query("contract_validate", VERDICTS)
def contract_validate(t):
    return contracts.contract_validate(t.contract_columns, t.observed_columns)


@query("contract_batch_validate", f"{MISSING} UNION ALL {UNEXPECTED} UNION ALL {MISMATCH}")
def contract_batch_validate(t):
    return contracts.contract_errors(t.contract_columns, t.observed_columns)


@query("contract_results", f"SELECT * FROM ({VERDICTS}) WHERE NOT is_valid ORDER BY error_count DESC, dataset_name DESC LIMIT 10")
def contract_results(t):
    verdicts = contracts.contract_validate(t.contract_columns, t.observed_columns)
    invalid = filters.apply_filters(verdicts, ("is_valid", "eq", False))
    return filters.sort_page(invalid, "error_count", ["dataset_name"], True, 10, 0)


@query(
    "contract_summary",
    f"""SELECT count(*) AS total_validations, count(*) FILTER (WHERE is_valid) AS passed,
      count(*) FILTER (WHERE NOT is_valid) AS failed, round(count(*) FILTER (WHERE is_valid) * 1e2 / count(*), 2) AS success_rate
      FROM ({VERDICTS})""",
)
def contract_summary(t):
    return rollups.contract_summary(contracts.contract_validate(t.contract_columns, t.observed_columns))


@query(
    "normalize_type",
    f"SELECT dataset_name, column_name, data_type, {NORMAL.format(c='data_type')} AS normalized_type FROM {O}",
)
def normalize_type(t):
    from tidewatch.functions.scalars import normalize_type as normal

    return t.observed_columns.select(
        "dataset_name", "column_name", "data_type", normal(F.col("data_type")).alias("normalized_type")
    )


# --- versions and drift -----------------------------------------------------------------

HASHED = """SELECT dataset_name, observed_at, sha256('{"columns": [' || string_agg('{"data_type": "' || data_type
    || '", "name": "' || column_name || '", "nullable": ' || CASE WHEN nullable THEN 'true' ELSE 'false' END
    || ', "position": ' || pos || '}', ', ' ORDER BY column_name) || ']}') AS version_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, observed_at ORDER BY column_name) - 1 AS pos FROM @observations)
  GROUP BY 1, 2"""
VERSIONS = f"""SELECT dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY observed_at) AS version_number, version_hash,
    observed_at AS detected_at
  FROM (SELECT *, lag(version_hash) OVER (PARTITION BY dataset_name ORDER BY observed_at) AS before FROM ({HASHED}))
  WHERE before IS NULL OR before <> version_hash"""
COLUMNS = f"""SELECT v.dataset_name, v.version_number, v.version_hash, v.detected_at, o.column_name, o.data_type, o.nullable,
    CAST(row_number() OVER (PARTITION BY v.dataset_name, v.version_number ORDER BY o.column_name) - 1 AS INT) AS position
  FROM ({VERSIONS}) AS v JOIN @observations AS o ON v.dataset_name = o.dataset_name AND v.detected_at = o.observed_at"""


def _pairs(previous: str, current: str) -> str:
    return f"""SELECT coalesce(a.dataset_name, b.dataset_name) AS dataset_name, coalesce(a.k, b.k) AS k,
      coalesce(a.column_name, b.column_name) AS column_name, a.column_name IS NOT NULL AS old, b.column_name IS NOT NULL AS new,
      a.data_type AS previous_type, b.data_type AS current_type, a.nullable AS previous_nullable, b.nullable AS current_nullable,
      a.position AS previous_position, b.position AS current_position
      FROM ({previous}) AS a FULL JOIN ({current}) AS b
        ON a.dataset_name = b.dataset_name AND a.k = b.k AND a.column_name = b.column_name"""


def _changes(pairs: str) -> str:
    conditions = {
        "added": "new AND NOT old",
        "removed": "old AND NOT new",
        "type": "old AND new AND previous_type <> current_type",
        "nullability": "old AND new AND previous_nullable <> current_nullable",
        "position": "old AND new AND previous_position <> current_position",
    }
    return " UNION ALL ".join(f"SELECT *, '{k}' AS change FROM ({pairs}) WHERE {c}" for k, c in conditions.items())


def _category(changes: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE change = '{k}') AS {k}_changes" for k in ("removed", "type", "nullability", "added", "position")
    )
    return f"""SELECT *, CASE WHEN removed_changes > 0 THEN 'column_removed' WHEN type_changes > 0 THEN 'type_changed'
        WHEN nullability_changes > 0 THEN 'nullability_changed' WHEN added_changes > 0 THEN 'column_added'
        ELSE 'position_changed' END AS drift_type,
      CASE WHEN removed_changes + type_changes > 0 THEN 'critical' WHEN relaxed > 0 THEN 'warning' ELSE 'info' END AS severity
      FROM (SELECT dataset_name, k, {counts},
        count(*) FILTER (WHERE change = 'nullability' AND NOT previous_nullable AND current_nullable) AS relaxed
        FROM ({changes}) GROUP BY 1, 2)"""


SUCCESSIVE = _pairs(
    f"SELECT *, version_number + 1 AS k FROM ({COLUMNS}) QUALIFY version_number < max(version_number) OVER (PARTITION BY dataset_name)",
    f"SELECT *, version_number AS k FROM ({COLUMNS}) WHERE version_number > 1",
)
DRIFT = _category(_changes(SUCCESSIVE))
HISTORY = f"""SELECT d.dataset_name, d.k AS current_version, removed_changes, type_changes, nullability_changes, added_changes,
    position_changes, drift_type, severity, v.detected_at, d.k - 1 AS previous_version, false AS acknowledged
  FROM ({DRIFT}) AS d JOIN ({VERSIONS}) AS v ON d.dataset_name = v.dataset_name AND d.k = v.version_number"""


def _versions(t):
    return drift.register_schemas(t.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")))


def _stored_versions(t):
    """Versions are registered once, into a table; drift reads that table."""
    path = work_path(t.spark, "schema_versions")
    writers.append(_versions(t), path)
    return readers.read_table(t.spark, path)


def _columns(t):
    return drift.version_columns(_stored_versions(t))


def _history(t):
    return drift.drift_history(_columns(t))


@query("schema_hash", HASHED)
def schema_hash(t):
    normal = drift.normalize_schema(t.observations, ["dataset_name", "observed_at"])
    return normal.select(
        "dataset_name", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
        drift.schema_hash(F.col("columns")).alias("version_hash"),
    )


@query("schema_register", VERSIONS)
def schema_register(t):
    return _versions(t).drop("columns")


CUT = "2024-01-16 00:00:00"


@query("schema_register_new", f"SELECT * FROM ({VERSIONS}) WHERE detected_at >= TIMESTAMP '{CUT}'")
def schema_register_new(t):
    """Versions up to a day are stored; the observations after it are registered against them."""
    seen = t.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    path = work_path(t.spark, "schema_versions")
    writers.append(drift.register_schemas(seen.filter(F.col("observed_at") < at(CUT))), path)
    later = seen.filter(F.col("observed_at") >= at(CUT))
    return drift.register_new_schemas(readers.read_table(t.spark, path), later).drop("columns")


@query(
    "next_version_number",
    f"SELECT dataset_name, max(version_number) + 1 AS next_version FROM ({VERSIONS}) GROUP BY 1",
)
def next_version_number(t):
    return _versions(t).groupBy("dataset_name").agg((F.max("version_number") + 1).alias("next_version"))


@query("schema_versions", f"SELECT * FROM ({VERSIONS}) WHERE dataset_name = 'user_17' ORDER BY version_number DESC LIMIT 100")
def schema_versions(t):
    rows = filters.apply_filters(_versions(t).drop("columns"), ("dataset_name", "eq", "user_17"))
    return filters.recent(rows, "version_number", ["dataset_name"], 100)


@query(
    "latest_schema_version",
    f"""SELECT dataset_name, version_number, version_hash FROM (SELECT *, row_number() OVER
      (PARTITION BY dataset_name ORDER BY version_number DESC) AS rn FROM ({VERSIONS})) WHERE rn = 1""",
)
def latest_schema_version(t):
    rows = _versions(t).select("dataset_name", "version_number", "version_hash")
    return latest_per_key(rows, ["dataset_name"], F.col("version_number").desc())


@query(
    "drift_compare",
    f"SELECT * EXCLUDE (k, old, new), k AS current_version FROM ({_changes(SUCCESSIVE)})",
)
def drift_compare(t):
    return drift.drift_changes(_columns(t))


@query(
    "drift_over_versions",
    f"""SELECT dataset_name, k AS current_version, count(*) AS changes, count(DISTINCT column_name) AS columns_changed
      FROM ({_changes(SUCCESSIVE)}) GROUP BY 1, 2""",
)
def drift_over_versions(t):
    return drift.drift_changes(_columns(t)).groupBy("dataset_name", "current_version").agg(
        F.count(F.lit(1)).alias("changes"), F.count_distinct("column_name").alias("columns_changed")
    )


@query("drift_detect", HISTORY)
def drift_detect(t):
    return _history(t)


@query("drift_category", f"SELECT drift_type, severity, count(*) AS drifts FROM ({HISTORY}) GROUP BY 1, 2")
def drift_category(t):
    return _history(t).groupBy("drift_type", "severity").agg(F.count(F.lit(1)).alias("drifts"))


@query(
    "drift_history",
    f"""SELECT dataset_name, current_version, drift_type, severity, detected_at FROM ({HISTORY})
      WHERE severity = 'warning' ORDER BY detected_at DESC, dataset_name DESC, current_version DESC LIMIT 100""",
)
def drift_history(t):
    rows = filters.apply_filters(_history(t), ("severity", "eq", "warning"), ("acknowledged", "eq", False))
    columns = ["dataset_name", "current_version", "drift_type", "severity", "detected_at"]
    return filters.recent(rows.select(*columns), "detected_at", ["dataset_name", "current_version"], 100)


@query(
    "compare_versions",
    f"""WITH c AS ({COLUMNS}),
      p AS (SELECT dataset_name FROM c WHERE version_number IN (2, 4) GROUP BY 1 HAVING count(DISTINCT version_number) = 2),
      d AS ({_category(_changes(_pairs("SELECT *, 0 AS k FROM c WHERE version_number = 2 AND dataset_name IN (SELECT dataset_name FROM p)", "SELECT *, 0 AS k FROM c WHERE version_number = 4 AND dataset_name IN (SELECT dataset_name FROM p)")))})
      SELECT p.dataset_name, drift_type IS NOT NULL AS has_drift, drift_type, severity,
        coalesce(removed_changes, 0) AS removed_changes, coalesce(type_changes, 0) AS type_changes,
        coalesce(nullability_changes, 0) AS nullability_changes, coalesce(added_changes, 0) AS added_changes,
        coalesce(position_changes, 0) AS position_changes FROM p LEFT JOIN d ON p.dataset_name = d.dataset_name""",
)
def compare_versions(t):
    return drift.compare_versions(_columns(t), 2, 4)


@query(
    "schema_timeline",
    f"""SELECT v.dataset_name, v.version_number, v.detected_at, d.drift_type, d.severity, d.drift_type IS NOT NULL AS drift_occurred
      FROM ({VERSIONS}) AS v LEFT JOIN ({DRIFT}) AS d ON v.dataset_name = d.dataset_name AND v.version_number = d.k""",
)
def schema_timeline(t):
    versions = _stored_versions(t)
    return drift.schema_timeline(versions, drift.drift_history(drift.version_columns(versions)))


ACKS = """SELECT 'user_' || CAST(user_id AS {string}) AS dataset_name, event_id % 9 + 2 AS current_version,
  'reviewer_' || CAST(event_id % 4 AS {string}) AS acknowledged_by, ts AS acknowledged_at, props AS notes
  FROM @events WHERE event_type = 'click'"""
ACKNOWLEDGED = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, current_version
    ORDER BY acknowledged_at DESC, acknowledged_by) AS rn FROM ({ACKS.format(string="VARCHAR")}))
  SELECT h.dataset_name, h.current_version, h.drift_type, h.severity, h.detected_at, a.acknowledged_by, a.acknowledged_at, a.notes,
    a.acknowledged_at IS NOT NULL AS acknowledged FROM ({HISTORY}) AS h LEFT JOIN a
    ON h.dataset_name = a.dataset_name AND h.current_version = a.current_version AND a.rn = 1"""


def _acknowledged(t):
    acks = t.sql(ACKS.format(string="STRING"))
    return drift.acknowledge(_history(t), acks, ["dataset_name", "current_version"])


@query("drift_acknowledge", ACKNOWLEDGED)
def drift_acknowledge(t):
    return _acknowledged(t).select(
        "dataset_name", "current_version", "drift_type", "severity", "detected_at", "acknowledged_by",
        "acknowledged_at", "notes", "acknowledged",
    )


@query(
    "drift_alerts",
    f"""SELECT dataset_name, count(*) AS total_drifts, count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged_count,
      count(*) FILTER (WHERE NOT acknowledged AND severity = 'critical') AS critical_count,
      count(*) FILTER (WHERE NOT acknowledged AND severity = 'warning') AS warning_count,
      count(*) FILTER (WHERE NOT acknowledged AND severity = 'info') AS info_count,
      arg_max(drift_type, (detected_at, current_version)) AS latest_drift_type, max(detected_at) AS latest_detected_at
      FROM ({ACKNOWLEDGED}) GROUP BY 1""",
)
def drift_alerts(t):
    return rollups.drift_alerts(_acknowledged(t))
