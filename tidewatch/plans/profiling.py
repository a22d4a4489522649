"""Queries: profiles, distributions, quality and health scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.ordering import first_n_per_key, latest_per_key
from tidewatch.functions.scalars import health_band
from tidewatch.operators import filters, profile, rollups, rules, sketches
from tidewatch.plans.catalog import query
from tidewatch.plans.common import at, tidy
from tidewatch.session import written

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_partkey"]
TEXTS = ["l_returnflag", "l_linestatus"]


def _number(c: str, table: str, kind: str, with_median: bool = True) -> str:
    median = f", round(median({c}), 4) AS median" if with_median else ""
    return f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) - count({c}) AS null_count,
      round((count(*) - count({c})) * 1e2 / count(*), 4) AS null_percentage, min({c}) * 1e0 AS min, max({c}) * 1e0 AS max,
      round(avg({c}), 4) AS mean {median}, round(stddev_samp({c}), 4) AS std, count(*) AS total FROM {table}"""


def _text(c: str, table: str, with_median: bool = True) -> str:
    none = "CAST(NULL AS DOUBLE)"
    median = f", {none} AS median" if with_median else ""
    return f"""SELECT '{c}' AS column_name, 'string' AS data_type, count(*) - count({c}) AS null_count,
      round((count(*) - count({c})) * 1e2 / count(*), 4) AS null_percentage, {none} AS min, {none} AS max,
      {none} AS mean {median}, {none} AS std, count(*) AS total FROM {table}"""


KINDS = {"l_linenumber": "int", "l_partkey": "bigint"}
LINEITEM_PROFILE = " UNION ALL ".join(
    [_number(c, "@lineitem", KINDS.get(c, "double")) for c in NUMBERS] + [_text(c, "@lineitem") for c in TEXTS]
)
DIRTY_PROFILE = " UNION ALL ".join(
    [
        _number("order_id", "@dirty_orders", "bigint"),
        _number("customer_id", "@dirty_orders", "bigint"),
        _text("priority", "@dirty_orders"),
        _text("comment", "@dirty_orders"),
        _number("total", "@dirty_orders", "double"),
    ]
)
DIRTY_COLUMNS = ["order_id", "customer_id", "priority", "comment", "total"]


@query("profile_columns", LINEITEM_PROFILE)
def profile_columns(t):
    return tidy(profile.profile_columns(t.lineitem, NUMBERS + TEXTS))


@query("profile_columns_nulls", DIRTY_PROFILE)
def profile_columns_nulls(t):
    return tidy(profile.profile_columns(t.dirty_orders, DIRTY_COLUMNS))


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM @dirty_orders" for c in DIRTY_COLUMNS
    ),
)
def profile_distinct(t):
    return profile.distinct_counts(t.dirty_orders, DIRTY_COLUMNS)


TOP_COLUMNS = ["l_returnflag", "l_partkey", "l_quantity", "l_shipdate"]


def _top(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, * FROM (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INT) AS rank,
      CAST({c} AS VARCHAR) AS "value", count(*) AS "count",
      round(count(*) * 1e2 / (SELECT count(*) FROM @lineitem), 4) AS percentage FROM @lineitem GROUP BY {c})
      WHERE rank <= 10"""


@query("profile_top_values", " UNION ALL ".join(_top(c) for c in TOP_COLUMNS))
def profile_top_values(t):
    return tidy(profile.top_values(t.lineitem, TOP_COLUMNS))


@query(
    "topk_per_group",
    """SELECT lang, source, n AS documents, CAST(rn AS INT) AS row_number FROM (SELECT lang, source, count(*) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rn FROM @documents GROUP BY 1, 2)
      WHERE rn <= 3""",
)
def topk_per_group(t):
    counts = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    return first_n_per_key(counts, ["lang"], 3, F.col("documents").desc(), F.col("source"))


DATASET_PROFILE = f"""WITH p AS ({DIRTY_PROFILE}),
  d AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM @dirty_orders" for c in DIRTY_COLUMNS)})
  SELECT 'orders' AS dataset_name, total AS row_count, CAST(5 AS BIGINT) AS column_count, p.column_name, data_type, null_count,
    null_percentage, min, max, mean, median, std, unique_count FROM p JOIN d ON p.column_name = d.column_name"""


@query("profile_dataset", DATASET_PROFILE)
def profile_dataset(t):
    return tidy(profile.profile_dataset(t.dirty_orders, "orders", DIRTY_COLUMNS))


@query(
    "profile_summary",
    f"""SELECT round(avg(null_percentage), 4) AS average_null_percentage, count(mean) AS numeric_columns,
      count(*) AS column_count FROM ({DIRTY_PROFILE})""",
)
def profile_summary(t):
    return tidy(profile.profile_summary(profile.profile_columns(t.dirty_orders, DIRTY_COLUMNS)))


@query(
    "quality_score",
    f"""WITH p AS ({DATASET_PROFILE}),
      v AS (SELECT (CASE WHEN count(*) = count(DISTINCT order_id) THEN 1 ELSE 0 END
        + CASE WHEN count(*) = count(priority) THEN 1 ELSE 0 END) * 4e1 / 2 AS v FROM @dirty_orders),
      s AS (SELECT dataset_name, avg(1e2 - null_percentage) * 3e-1 AS c,
        least(avg(unique_count * 1e2 / row_count), 1e2) * 3e-1 AS u FROM p GROUP BY 1),
      x AS (SELECT *, v + c + u AS total FROM s, v)
      SELECT dataset_name, round(total, 2) AS quality_score, round(v, 2) AS validation_score,
        round(c, 2) AS completeness_score, round(u, 2) AS uniqueness_score,
        CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D'
          ELSE 'F' END AS grade FROM x""",
)
def quality_score(t):
    checks = [
        rules.Rule("unique", "Unique id", "uniqueness", target_columns=("order_id",)),
        rules.Rule("filled", "Priority set", "null_check", target_columns=("priority",)),
    ]
    summary = rules.run_summary(rules.run_rules(t.dirty_orders, checks))
    return profile.quality_score(profile.profile_dataset(t.dirty_orders, "orders", DIRTY_COLUMNS), summary)


PARTS = f"""WITH p AS ({DATASET_PROFILE}) SELECT dataset_name, avg(1e2 - null_percentage) AS completeness,
  avg(unique_count * 1e2 / row_count) AS uniqueness FROM p GROUP BY 1"""


@query(
    "quality_metric_rows",
    f"""WITH s AS ({PARTS})
      SELECT dataset_name, 'DataQualityScore' AS metric_name, round((completeness + uniqueness) / 2, 4) AS metric_value, 'None' AS unit FROM s
      UNION ALL SELECT dataset_name, 'QualityScore_completeness', round(completeness, 4), 'None' FROM s
      UNION ALL SELECT dataset_name, 'QualityScore_uniqueness', round(uniqueness, 4), 'None' FROM s""",
)
def quality_metric_rows(t):
    scores = (
        profile.profile_dataset(t.dirty_orders, "orders", DIRTY_COLUMNS).groupBy("dataset_name")
        .agg(
            F.avg(100.0 - F.col("null_percentage")).alias("completeness"),
            F.avg(F.col("unique_count") * 100.0 / F.col("row_count")).alias("uniqueness"),
        )
        .withColumn("score", (F.col("completeness") + F.col("uniqueness")) / 2)
    )
    return tidy(
        rollups.quality_metric_rows(scores, "score", ["completeness", "uniqueness"], ["dataset_name"])
    )


PIPELINE_CHECKS = """SELECT 'pipeline_' || CAST(id % 12 AS VARCHAR) AS pipeline_name, status FROM @audit_logs"""
HEALTH = f"""WITH v AS (SELECT pipeline_name, count(*) AS total_validations, count(*) FILTER (WHERE status = 'passed') AS ok
    FROM ({PIPELINE_CHECKS}) GROUP BY 1),
  f AS (SELECT pipeline_name, count(*) AS n, count(*) FILTER (WHERE freshness_status = 'critical') AS bad,
    count(*) FILTER (WHERE sla_status = 'compliant') AS good, avg(total_latency_seconds) AS lat FROM @freshness GROUP BY 1),
  s AS (SELECT coalesce(v.pipeline_name, f.pipeline_name) AS pipeline_name, coalesce(total_validations, 0) AS total_validations,
    coalesce(bad, 0) AS freshness_violations, lat AS average_latency_seconds, coalesce(ok * 1e2 / total_validations, 0) AS vs,
    coalesce((n - bad) * 1e2 / n, 0) AS fs, coalesce(good * 1e2 / n, 0) AS ls
    FROM v FULL JOIN f ON v.pipeline_name = f.pipeline_name)
  SELECT *, (vs + fs + ls) / 3 AS o FROM s"""
STATUS = "CASE WHEN o >= 80 THEN 'healthy' WHEN o >= 60 THEN 'degraded' ELSE 'unhealthy' END"


def _health(t):
    checks = t.audit_logs.select(
        F.concat(F.lit("pipeline_"), (F.col("id") % 12).cast("string")).alias("pipeline_name"), "status"
    )
    return profile.health_score(checks, t.freshness)


@query(
    "health_score",
    f"""SELECT pipeline_name, total_validations, freshness_violations, round(average_latency_seconds, 4) AS average_latency_seconds,
      round(vs, 4) AS validation_score, round(fs, 4) AS freshness_score, round(ls, 4) AS latency_score,
      round(o, 4) AS overall_score, {STATUS} AS status FROM ({HEALTH})""",
)
def health_score(t):
    return tidy(_health(t))


# A score per pipeline and day, as the history a roll-up reads.
SCORES = """SELECT pipeline_name, CAST(ingestion_timestamp AS DATE) AS day,
  count(*) FILTER (WHERE freshness_status <> 'critical') * 1e2 / count(*) AS overall_score FROM @freshness GROUP BY 1, 2"""


def _scores(t):
    score = F.count_if(F.col("freshness_status") != "critical") * 100.0 / F.count(F.lit(1))
    return (
        t.freshness.groupBy("pipeline_name", F.col("ingestion_timestamp").cast("date").alias("day"))
        .agg(score.alias("overall_score"))
        .withColumn("status", health_band(F.col("overall_score")))
    )


@query(
    "health_rollup",
    f"""WITH l AS (SELECT overall_score AS o, row_number() OVER (PARTITION BY pipeline_name ORDER BY day DESC) AS rn FROM ({SCORES}))
      SELECT count(*) AS total_pipelines, count(*) FILTER (WHERE {STATUS} = 'healthy') AS healthy_count,
        count(*) FILTER (WHERE {STATUS} = 'degraded') AS degraded_count,
        count(*) FILTER (WHERE {STATUS} = 'unhealthy') AS unhealthy_count, round(avg(o), 2) AS average_overall_score
      FROM l WHERE rn = 1""",
)
def health_rollup(t):
    return profile.health_rollup(_scores(t), "pipeline_name", F.col("day").desc())


@query(
    "health_trend",
    f"SELECT pipeline_name, round(avg(overall_score), 4) AS average_score, count(*) AS points FROM ({SCORES}) GROUP BY 1",
)
def health_trend(t):
    return tidy(rollups.health_trend(_scores(t), "pipeline_name"))


# A profile per user and day: how many events, how many of them without a value.
PROFILES = """SELECT user_id, 'user_' || CAST(user_id % 40 AS {string}) AS dataset_name, CAST(ts AS DATE) AS day, count(*) AS row_count
  FROM @events GROUP BY 1, 2, 3"""


@query(
    "profile_history",
    f"""SELECT * FROM ({PROFILES.format(string="VARCHAR")}) WHERE dataset_name = 'user_7'
      ORDER BY day DESC, user_id DESC LIMIT 100""",
)
def profile_history(t):
    rows = filters.apply_filters(t.sql(PROFILES.format(string="STRING")), ("dataset_name", "eq", "user_7"))
    return filters.recent(rows, "day", ["user_id"], 100)


@query(
    "latest_profile",
    f"""SELECT dataset_name, day, user_id, row_count FROM (SELECT *, row_number() OVER
      (PARTITION BY dataset_name ORDER BY day DESC, user_id DESC) AS rn FROM ({PROFILES.format(string="VARCHAR")})) WHERE rn = 1""",
)
def latest_profile(t):
    rows = t.sql(PROFILES.format(string="STRING"))
    return latest_per_key(rows, ["dataset_name"], F.col("day").desc(), F.col("user_id").desc())


# --- sketches ------------------------------------------------------------------------------

SKETCHED = ["o_custkey", "o_totalprice", "o_orderpriority"]


@query(
    "profile_from_days",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
          {f'min({c}) * 1e0' if c != 'o_orderpriority' else 'CAST(NULL AS DOUBLE)'} AS minimum, {f'max({c}) * 1e0' if c != 'o_orderpriority' else 'CAST(NULL AS DOUBLE)'} AS maximum,
          true AS distinct_within_bound, {'true' if c != 'o_orderpriority' else 'CAST(NULL AS BOOLEAN)'} AS median_within_bound FROM @orders"""
        for c in SKETCHED
    ),
)
def profile_from_days(t):
    """A profile of all orders from the stored sketches of their days, checked against the exact figures."""
    stored = written(sketches.profile_sketches(t.orders.withColumn("day", F.to_date("o_orderdate")), SKETCHED, ["day"]), "sketches")
    found = sketches.profile_estimates(sketches.merged_profiles(stored), [0.5])
    exact = t.orders.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).unpivot([], SKETCHED, "column_name", "exact")
    medians = found.filter("p50 IS NOT NULL").select("column_name", "p50")
    values = t.orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in SKETCHED[:2]])))
    ranks = sketches.rank_range(values.join(F.broadcast(medians), "column_name"), ["column_name"], "v", "p50")
    within = (F.col("low") - sketches.RANK_ERROR <= 0.5) & (F.col("high") + sketches.RANK_ERROR >= 0.5)
    near = F.abs(F.col("unique_estimate") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact") + 1
    return found.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "column_name", "row_count", "null_count", "minimum", "maximum", near.alias("distinct_within_bound"), within.alias("median_within_bound")
    )


@query(
    "histogram_windows",
    """SELECT metric_name, count(metric_value) AS value_count, min(metric_value) AS minimum, max(metric_value) AS maximum, true AS p95_within_bound
      FROM @metrics WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 00:00:00' GROUP BY metric_name""",
)
def histogram_windows(t):
    """Percentiles over ten days from hourly sketches, checked against the values' ranks."""
    stored = written(sketches.value_sketches(t.metrics, ["metric_name"], "timestamp", "metric_value"), "hours")
    start, end = at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00")
    found = sketches.window_percentiles(stored, ["metric_name"], start, end)
    rows = t.metrics.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select("metric_name", "metric_value")
    ranks = sketches.rank_range(rows.join(found.select("metric_name", "p95"), "metric_name"), ["metric_name"], "metric_value", "p95")
    within = (F.col("low") - sketches.RANK_ERROR <= 0.95) & (F.col("high") + sketches.RANK_ERROR >= 0.95)
    return found.join(ranks, "metric_name").select("metric_name", "value_count", "minimum", "maximum", within.alias("p95_within_bound"))
