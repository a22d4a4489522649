"""Declarative rules: a list of definitions becomes one aggregation over the table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import fixed
from tidewatch.functions.results import error_list
from tidewatch.functions.scalars import named, pass_rate, safe_rate
from tidewatch.operators import integrity, validators


@dataclass(frozen=True)
class Threshold:
    metric: str
    operator: str
    value: float


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    rule_type: str
    enabled: bool = True
    target_columns: tuple[str, ...] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)
    thresholds: tuple[Threshold, ...] = ()
    severity: str = "error"
    tags: tuple[str, ...] = ()
    description: str | None = None


def parse_rule(definition: Mapping[str, Any]) -> Rule:
    """A checked rule; raises ValueError on an empty id or name or an unknown word."""
    given = dict(definition)
    for key in ("rule_id", "name"):
        if not str(given.get(key) or "").strip():
            raise ValueError(f"{key} cannot be empty")
        given[key] = given[key].strip()
    severity = str(given.get("severity", "error")).lower()
    if severity not in fixed.SEVERITIES:
        raise ValueError(f"severity must be one of {list(fixed.SEVERITIES)}")
    if given.get("rule_type") not in fixed.RULE_TYPES:
        raise ValueError(f"unknown rule type: {given.get('rule_type')}")
    thresholds = []
    for t in given.get("thresholds") or []:
        if t["operator"] not in fixed.THRESHOLD_OPERATORS:
            raise ValueError(f"unknown threshold operator: {t['operator']}")
        thresholds.append(Threshold(t["metric"], t["operator"], float(t["value"])))
    return Rule(
        rule_id=given["rule_id"],
        name=given["name"],
        rule_type=given["rule_type"],
        enabled=bool(given.get("enabled", True)),
        target_columns=tuple(given.get("target_columns") or ()),
        parameters=dict(given.get("parameters") or {}),
        thresholds=tuple(thresholds),
        severity=severity,
        tags=tuple(given.get("tags") or ()),
        description=given.get("description"),
    )


def parse_rules(config: str | Mapping[str, Any]) -> list[Rule]:
    """Rules of a configuration document (JSON text or parsed)."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except json.JSONDecodeError as problem:
            raise ValueError(f"Invalid JSON in rules configuration: {problem}") from problem
    return [parse_rule(r) for r in config.get("rules", [])]


# --- compilation --------------------------------------------------------------


def _row_checks(df: DataFrame, rule: Rule) -> list[Column] | None:
    """Conditions that mark a failing cell, or None if the rule needs its own grouping."""
    columns = [c for c in (rule.target_columns or df.columns) if c in df.columns]
    if rule.rule_type == "null_check":
        return [named(c).isNull() for c in columns]
    if rule.rule_type == "datatype":
        types = rule.parameters.get("expected_types") or {}
        return [validators.type_mismatch(df, c, t) for c, t in types.items() if c in df.columns]
    if rule.rule_type == "range":
        low, high = rule.parameters.get("min_value"), rule.parameters.get("max_value")
        return [validators.out_of_range(df, c, low, high) for c in columns]
    if rule.rule_type == "pattern":
        return [validators.pattern_mismatch(c, rule.parameters["pattern"]) for c in columns]
    if rule.rule_type == "custom":
        holds = F.coalesce(F.expr(rule.parameters["expression"]), F.lit(False))
        return [~holds]
    return None


def _unusable(df: DataFrame, rule: Rule) -> str | None:
    """Why a rule cannot run on this table."""
    expected = list(rule.target_columns) + list((rule.parameters.get("expected_types") or {}))
    missing = [c for c in expected if c not in df.columns]
    if missing:
        return f"Column '{missing[0]}' not found in DataFrame"
    if rule.rule_type == "pattern" and "pattern" not in rule.parameters:
        return "Missing required parameter: pattern"
    if rule.rule_type == "custom" and "expression" not in rule.parameters:
        return "Missing required parameter: expression"
    if rule.rule_type == "referential_integrity":
        needed = ("reference_df", "source_column", "reference_column")
        if any(rule.parameters.get(k) is None for k in needed):
            return "Missing required parameters for referential integrity check"
    if rule.rule_type == "uniqueness" and not rule.target_columns:
        return "Missing target columns for uniqueness check"
    try:
        _plan(df, rule)
    except (PySparkException, ValueError, TypeError, KeyError) as problem:
        return f"Rule cannot be evaluated: {str(problem).strip().splitlines()[0]}"
    return None


def _plan(df: DataFrame, rule: Rule) -> None:
    """Raise what is wrong with a rule without reading the table: unknown columns, bad SQL, types or patterns."""
    if rule.rule_type == "referential_integrity":
        df.select(named(rule.parameters["source_column"]))
        rule.parameters["reference_df"].select(named(rule.parameters["reference_column"]))
        return
    checks = _row_checks(df, rule)
    if checks:
        df.select(*[F.count_if(c) for c in checks])
    if rule.rule_type == "pattern":
        # A pattern is only compiled when it meets a value.
        df.sparkSession.range(1).select(F.rlike(F.lit("text"), F.lit(rule.parameters["pattern"]))).first()


def _measure_separately(df: DataFrame, rule: Rule) -> DataFrame:
    """(total, failed) of a rule that needs a grouping of its own."""
    if rule.rule_type == "uniqueness":
        return integrity.detect_duplicates(df, rule.target_columns).select(
            F.col("total_records").alias("total"), F.col("duplicate_count").alias("failed")
        )
    source, key = rule.parameters["source_column"], rule.parameters["reference_column"]
    values = df.groupBy(named(source).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parents = rule.parameters["reference_df"].select(named(key).alias("_parent")).distinct()
    matched = values.join(parents.withColumn("_hit", F.lit(True)), F.col("value") == F.col("_parent"), "left")
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("failed"),
    )


def _status(rule: Rule, total: Column, failed: Column) -> Column:
    if rule.rule_type == "datatype":
        rate = safe_rate(total - failed, total, 100.0)
        return F.when(failed == 0, "passed").when(rate >= 95, "warning").otherwise("failed")
    if rule.rule_type == "null_check":
        return F.when(total == 0, "warning").when(failed == 0, "passed").otherwise("failed")
    return F.when(failed == 0, "passed").otherwise("failed")


def _violations(rule: Rule, rate: Column, total: Column, failed: Column) -> Column:
    """Number of violated thresholds; thresholds on unknown metrics are skipped."""
    metrics = {
        "pass_rate": rate, "failed_records": failed.cast("double"), "total_records": total.cast("double")
    }
    violated = F.lit(0)
    for t in rule.thresholds:
        if t.metric in metrics:
            met = compare(metrics[t.metric], F.lit(t.operator), F.lit(t.value))
            violated = violated + F.when(met, 0).otherwise(1)
    return violated


def compare(actual: Column, operator: Column, value: Column) -> Column:
    """Threshold comparison with the operator given as text."""
    return (
        F.when(operator == ">", actual > value)
        .when(operator == ">=", actual >= value)
        .when(operator == "<", actual < value)
        .when(operator == "<=", actual <= value)
        .when(operator == "==", actual == value)
        .when(operator == "!=", actual != value)
        .otherwise(False)
    )


def _rule_struct(rule: Rule, status, total, failed, rate, message, errors) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.name).alias("validator_name"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.severity).alias("severity"),
        status.alias("status"),
        (status == "passed").alias("passed"),
        total.cast("bigint").alias("total_records"),
        failed.cast("bigint").alias("failed_records"),
        rate.cast("double").alias("pass_rate"),
        message.alias("message"),
        errors.alias("errors"),
    )


def _constant(rule: Rule, status: str, message: str) -> Column:
    errors = error_list(F.lit(message)) if status == "error" else error_list()
    zero = F.lit(0)
    return _rule_struct(rule, F.lit(status), zero, zero, F.lit(0.0), F.lit(message), errors)


def _measured(rule: Rule, total: Column, failed: Column) -> Column:
    rate = pass_rate(total, failed)
    violated = _violations(rule, rate, total, failed)
    status = F.when(violated > 0, "failed").otherwise(_status(rule, total, failed))
    message = F.concat(
        F.lit(f"{rule.rule_type}: "), failed.cast("string"), F.lit(" failed"),
        F.when(
            violated > 0, F.concat(F.lit(" | Threshold violations: "), violated.cast("string"))
        ).otherwise(""),
    )
    return _rule_struct(rule, status, total, failed, rate, message, error_list())


def run_rules(df: DataFrame, rules: Sequence[Rule], include_disabled: bool = False) -> DataFrame:
    """One result row per enabled rule.

    All rules that judge single cells share one aggregation of the table, so
    their number does not change the number of scans; uniqueness and reference
    rules add one pre-aggregated shuffle each. Rules that cannot run give an
    error row and do not stop the others.
    """
    fused: list[tuple[Rule, Column]] = []
    constants: list[Column] = []
    separate: list[DataFrame] = []
    for rule in rules:
        if not rule.enabled:
            if include_disabled:
                constants.append(_constant(rule, "passed", f"Rule {rule.rule_id} is disabled"))
            continue
        problem = _unusable(df, rule)
        if problem:
            constants.append(_constant(rule, "error", problem))
            continue
        checks = _row_checks(df, rule)
        if checks is None:
            measured = _measure_separately(df, rule)
            row = _measured(rule, F.col("total"), F.col("failed"))
            separate.append(measured.select(row.alias("r")).select("r.*"))
        else:
            fused.append((rule, sum((F.count_if(c) for c in checks), F.lit(0))))
    frames = []
    if fused:
        counts = df.agg(
            F.count(F.lit(1)).alias("total"), *[c.alias(f"_f{i}") for i, (_, c) in enumerate(fused)]
        )
        rows = [_measured(rule, F.col("total"), F.col(f"_f{i}")) for i, (rule, _) in enumerate(fused)]
        frames.append(counts.select(F.inline(F.array(*rows))))
    if constants:
        frames.append(df.sparkSession.range(1).select(F.inline(F.array(*constants))))
    frames += separate
    if not frames:
        raise ValueError("no rule to run")
    return reduce(DataFrame.unionByName, frames)


def threshold_results(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every threshold of a rule against its result row.

    ``thresholds``: (rule_id, metric, operator, value). Unknown metrics are
    skipped.
    """
    metrics = F.create_map(
        F.lit("pass_rate"), F.col("pass_rate"),
        F.lit("failed_records"), F.col("failed_records").cast("double"),
        F.lit("total_records"), F.col("total_records").cast("double"),
    )
    return (
        results.join(thresholds, "rule_id")
        .withColumn("actual", metrics[F.col("metric")])
        .filter(F.col("actual").isNotNull())
        .select(
            "rule_id", "metric", "operator", F.col("value").alias("expected"), "actual",
            compare(F.col("actual"), F.col("operator"), F.col("value")).alias("met"),
        )
    )


def rule_verdicts(evaluated: DataFrame) -> DataFrame:
    """Failed for a rule with any violated threshold."""
    return evaluated.groupBy("rule_id").agg(
        F.bool_and("met").alias("passed"), F.count_if(~F.col("met")).alias("violations")
    )


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed_rules"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
    )


# --- rule tables ----------------------------------------------------------------


def select_rules(
    rules: DataFrame,
    enabled: bool | None = None,
    rule_type: str | None = None,
    tag: str | None = None,
    rule_id: str | None = None,
) -> DataFrame:
    if enabled is not None:
        rules = rules.filter(F.col("enabled") == enabled)
    if rule_type is not None:
        rules = rules.filter(F.col("rule_type") == rule_type)
    if tag is not None:
        rules = rules.filter(F.array_contains("tags", tag))
    if rule_id is not None:
        rules = rules.filter(F.col("rule_id") == rule_id)
    return rules


def inventory(rules: DataFrame) -> DataFrame:
    """Totals of a rule table and the number of distinct tags."""
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("enabled").alias("enabled_rules"),
        F.count_if(~F.col("enabled")).alias("disabled_rules"),
    )


def distinct_tags(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")
