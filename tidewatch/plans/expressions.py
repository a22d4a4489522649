"""Queries: ages, service levels, thresholds and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import freshness
from tidewatch.plans.catalog import query
from tidewatch.plans.common import EVENTS_END, at, tidy

ET = f"TIMESTAMP '{EVENTS_END}'"
AGE = f"date_diff('microsecond', ingestion_start, {ET}) / 36e8"
LIMITS = """CASE lower(dataset_name) WHEN 'customers' THEN {0} WHEN 'orders' THEN {1} WHEN 'transactions' THEN {2}
  WHEN 'inventory' THEN {3} ELSE {4} END"""
HEALTHY = LIMITS.format("12e0", "6e0", "1e0", "24e0", "24e0")
WARNING = LIMITS.format("24e0", "12e0", "3e0", "48e0", "48e0")
SLA = """CASE lower(dataset_name) WHEN 'customers' THEN 12e0 WHEN 'orders' THEN 6e0 WHEN 'transactions' THEN 2e0
  WHEN 'inventory' THEN 24e0 WHEN 'analytics' THEN 48e0 ELSE 24e0 END"""
STATUS = f"CASE WHEN age <= {HEALTHY} THEN 'healthy' WHEN age <= {WARNING} THEN 'warning' ELSE 'critical' END"
AGED = f"SELECT *, {AGE} AS age FROM @operations"


@query("age_hours", f"SELECT id, round({AGE}, 4) AS age_hours FROM @operations")
def age_hours(t):
    return tidy(
        t.operations.select("id", scalars.hours_between(F.col("ingestion_start"), at(EVENTS_END)).alias("age_hours"))
    )


@query("freshness_status", f"SELECT id, dataset_name, {STATUS} AS freshness_status FROM ({AGED})")
def freshness_status(t):
    age = scalars.hours_between(F.col("ingestion_start"), at(EVENTS_END))
    limits = freshness.freshness_limits(F.col("dataset_name"))
    return t.operations.select(
        "id", "dataset_name", freshness.freshness_status(age, *limits).alias("freshness_status")
    )


MESSAGE = f"""'Dataset ''' || dataset_name || '''' || CASE {STATUS} WHEN 'healthy' THEN ' is fresh. Age: '
    WHEN 'warning' THEN ' is aging. Age: ' ELSE ' is stale! Age: ' END || format('{{:.1f}}', age) || ' hours'
    || CASE {STATUS} WHEN 'healthy' THEN ', Threshold: ' ELSE ', Expected threshold: ' END || {HEALTHY} || 'h'"""


@query(
    "freshness_validate",
    f"""SELECT id, dataset_name, CAST(format('{{:.2f}}', age) AS DOUBLE) AS dataset_age_hours, {STATUS} AS freshness_status,
      {HEALTHY} AS freshness_threshold_hours, {STATUS} = 'healthy' AS is_fresh, {MESSAGE} AS message FROM ({AGED})""",
)
def freshness_validate(t):
    return freshness.freshness_validate(
        t.operations.select("id", "dataset_name", "ingestion_start"), "ingestion_start", at(EVENTS_END)
    ).drop("ingestion_start")


@query(
    "freshness_message",
    f"SELECT {STATUS} AS freshness_status, count(DISTINCT {MESSAGE}) AS messages FROM ({AGED}) GROUP BY 1",
)
def freshness_message(t):
    rows = freshness.freshness_validate(t.operations, "ingestion_start", at(EVENTS_END))
    return rows.groupBy("freshness_status").agg(F.count_distinct("message").alias("messages"))


LATENCY = "date_diff('microsecond', ingestion_start, coalesce(validation_end, ingestion_end)) / 36e8"
EVALUATED = f"""SELECT id, dataset_name, {SLA} AS lim, {LATENCY} AS lat FROM @operations"""


@query(
    "sla_eval",
    f"""SELECT id, dataset_name, lim AS sla_threshold_hours, CAST(format('{{:.2f}}', lat) AS DOUBLE) AS actual_latency_hours,
      CASE WHEN lat IS NULL THEN NULL WHEN lat <= lim THEN 'compliant' ELSE 'breached' END AS sla_status,
      CASE WHEN lat IS NOT NULL THEN CAST(format('{{:.2f}}', CASE WHEN lat <= lim THEN 1e2 ELSE greatest(0, lim / lat * 100) END) AS DOUBLE) END
        AS compliance_percentage,
      CASE WHEN lat > lim THEN CAST(format('{{:.2f}}', lat - lim) AS DOUBLE) END AS breach_duration_hours FROM ({EVALUATED})""",
)
def sla_eval(t):
    done = t.operations.select(
        "id", "dataset_name", "ingestion_start", F.coalesce("validation_end", "ingestion_end").alias("done")
    )
    return freshness.sla_eval(done, "ingestion_start", "done").drop("ingestion_start", "done")


# Thresholds derived from the data: one row per event group, for most datasets.
THRESHOLDS = """SELECT CASE user_id % 6 WHEN 0 THEN 'customers' WHEN 1 THEN 'orders' WHEN 2 THEN 'transactions'
    WHEN 3 THEN 'inventory' ELSE 'user' || CAST(user_id AS {string}) END AS dataset,
    max(value) / 10 AS healthy_hours, max(value) / 5 AS warning_hours, avg(user_id % 6) * 4 AS sla_hours
  FROM @events WHERE user_id % 6 <> 4 GROUP BY 1"""


@query(
    "threshold_lookup",
    f"""SELECT id, dataset_name, round(coalesce(healthy_hours, 24), 4) AS healthy_hours, round(coalesce(warning_hours, 48), 4) AS warning_hours,
      round(coalesce(sla_hours, 24), 4) AS sla_hours FROM (SELECT id, dataset_name FROM @operations) AS o
      LEFT JOIN ({THRESHOLDS.format(string="VARCHAR")}) AS h ON lower(o.dataset_name) = h.dataset""",
)
def threshold_lookup(t):
    rows = freshness.threshold_lookup(
        t.operations.select("id", "dataset_name"), t.sql(THRESHOLDS.format(string="STRING"))
    )
    return tidy(rows)


@query(
    "normalize_path",
    """SELECT page_id, regexp_replace(regexp_replace(path, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', ':id', 'gi'),
        '/[0-9]+', '/:id', 'g') AS path
      FROM (SELECT page_id, url || '/' || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4)
        || '-' || substr(md5(url), 17, 4) || '-' || upper(substr(md5(url), 21, 12)) AS path FROM @pages)""",
)
def normalize_path(t):
    h = F.md5("url")
    parts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4))]
    uuid = F.concat_ws("-", *parts, F.upper(F.substring(h, 21, 12)))
    return t.pages.select(
        "page_id", scalars.normalize_path(F.concat("url", F.lit("/"), uuid)).alias("path")
    )


@query(
    "metric_unit",
    """SELECT o_orderkey, CASE WHEN contains(n, 'duration') OR contains(n, 'time') OR contains(n, 'latency') THEN 'Seconds'
        WHEN contains(n, 'size') OR contains(n, 'bytes') THEN 'Bytes'
        WHEN contains(n, 'count') OR contains(n, 'records') OR contains(n, 'rows') THEN 'Count'
        WHEN contains(n, 'rate') OR contains(n, 'percent') THEN 'Percent' ELSE 'None' END AS unit
      FROM (SELECT o_orderkey, lower(CASE o_custkey % 9 WHEN 0 THEN 'Duration' WHEN 1 THEN 'upTime' WHEN 2 THEN 'LATENCY' WHEN 3 THEN 'size'
        WHEN 4 THEN 'rowsRate' WHEN 5 THEN 'hitRate' WHEN 6 THEN 'percent_ok' WHEN 7 THEN 'records' ELSE 'score' END || o_orderpriority) AS n
        FROM @orders)""",
)
def metric_unit(t):
    words = ["Duration", "upTime", "LATENCY", "size", "rowsRate", "hitRate", "percent_ok", "records", "score"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_custkey") % 9 + 1).cast("int"))
    return t.orders.select("o_orderkey", scalars.metric_unit(F.concat(word, "o_orderpriority")).alias("unit"))


RATES = """SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 3e-2) AS part,
  count(*) FILTER (WHERE l_quantity > 20) AS whole FROM @lineitem GROUP BY 1"""


def _rates(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_discount") > 0.03).alias("part"), F.count_if(F.col("l_quantity") > 20).alias("whole")
    )


@query(
    "safe_rate",
    f"SELECT l_orderkey, round(CASE WHEN whole > 0 THEN part * 1e2 / whole ELSE 0 END, 4) AS rate FROM ({RATES})",
)
def safe_rate(t):
    return tidy(_rates(t).select("l_orderkey", scalars.safe_rate(F.col("part"), F.col("whole")).alias("rate")))


@query(
    "grade",
    """SELECT o_orderkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade
      FROM (SELECT o_orderkey, o_totalprice / 5000 AS s FROM @orders)""",
)
def grade(t):
    return t.orders.select("o_orderkey", scalars.grade(F.col("o_totalprice") / 5000).alias("grade"))


@query(
    "sla_band",
    """SELECT o_orderkey, CASE WHEN s >= 95 THEN 'Excellent' WHEN s >= 80 THEN 'Good' WHEN s >= 60 THEN 'Fair' ELSE 'Poor' END AS band
      FROM (SELECT o_orderkey, o_totalprice / 5000 AS s FROM @orders)""",
)
def sla_band(t):
    return t.orders.select("o_orderkey", scalars.sla_band(F.col("o_totalprice") / 5000).alias("band"))


@query(
    "validator_type",
    "SELECT DISTINCT trim(replace(lower(validation_type || ' Validator'), 'validator', '')) AS validator_type FROM @audit_logs",
)
def validator_type(t):
    name = F.concat("validation_type", F.lit(" Validator"))
    return t.audit_logs.select(scalars.validator_type(name).alias("validator_type")).distinct()


@query(
    "retryable_reason",
    """SELECT batch_id, contains(lower(failure_reason), 'timeout') OR contains(lower(failure_reason), 'network_error')
        OR contains(lower(failure_reason), 'temporary_error') OR contains(lower(failure_reason), 'resource_limit')
        OR contains(lower(failure_reason), 'connection_error') AS retryable FROM @failed_loads""",
)
def retryable_reason(t):
    return t.failed_loads.select(
        "batch_id", scalars.reason_is_retryable(F.col("failure_reason")).alias("retryable")
    )


@query(
    "is_retryable",
    "SELECT id, retry_status IN ('pending', 'failed') AND retry_count < max_retries AS is_retryable FROM @retries",
)
def is_retryable(t):
    allowed = scalars.is_retryable(F.col("retry_status"), F.col("retry_count"), F.col("max_retries"))
    return t.retries.select("id", allowed.alias("is_retryable"))


@query(
    "date_parts",
    "SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour FROM @events",
)
def date_parts(t):
    return t.events.select("event_id", scalars.day_of(F.col("ts")).alias("day"), scalars.hour_of(F.col("ts")).alias("hour"))


@query(
    "json_payload",
    """SELECT event_id, '{"k":"' || CASE WHEN user_id % 3 = 0 THEN 'new' ELSE props ->> '$.k' END || '","user":"' || user_id || '"}' AS merged
      FROM @events""",
)
def json_payload(t):
    old = F.from_json("props", "map<string,string>")
    user = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    change = F.create_map(F.lit("k"), F.lit("new"), F.lit("user"), F.col("user_id").cast("string"))
    new = F.when(F.col("user_id") % 3 == 0, change).otherwise(user)
    merged = F.map_from_entries(F.array_sort(F.map_entries(scalars.merge_metadata(old, new))))
    return t.events.select("event_id", F.to_json(merged).alias("merged"))


@query(
    "text_ops",
    """SELECT p_partkey, upper(p_name) || ' / ' || p_brand AS label, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_number,
      round(p_retailprice * 11e-1 + p_size, 4) AS price FROM @part""",
)
def text_ops(t):
    return tidy(
        t.part.select(
            "p_partkey",
            F.concat(F.upper("p_name"), F.lit(" / "), "p_brand").alias("label"),
            F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").alias("brand_number"),
            (F.col("p_retailprice") * 1.1 + F.col("p_size")).alias("price"),
        )
    )


@query("make_batch_id", "SELECT o_orderkey, true AS well_formed FROM @orders")
def make_batch_id(t):
    made = scalars.batch_id(F.col("o_orderdate"))
    return t.orders.select(
        "o_orderkey", made.rlike("^batch_[0-9]{8}_[0-9]{6}_[0-9a-f]{8}$").alias("well_formed")
    )


@query("make_object_name", "SELECT o_orderkey, true AS well_formed, true AS keeps_name FROM @orders")
def make_object_name(t):
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv"))
    path = scalars.object_name("raw/", F.col("o_orderdate"), name)
    return t.orders.select(
        "o_orderkey",
        path.rlike("^raw/[0-9]{8}_[0-9]{6}_[0-9a-f]{32}_").alias("well_formed"),
        F.endswith(path, name).alias("keeps_name"),
    )


@query(
    "custom_thresholds",
    f"""SELECT id, {LIMITS.format('2e0', '6e0', '1e0', '24e0', '24e0')} AS healthy_hours FROM @operations""",
)
def custom_thresholds(t):
    healthy, _ = freshness.freshness_limits(F.col("dataset_name"), {"Customers": (2.0, 4.0)})
    return t.operations.select("id", healthy.alias("healthy_hours"))


