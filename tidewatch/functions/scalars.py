"""Column expressions shared by the operators (no Python UDFs)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from tidewatch.functions import fixed


def quoted(column: str) -> str:
    """The column name for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def named(column: str) -> Column:
    """The column called exactly ``column``, dots and spaces included."""
    return F.col(quoted(column))


def text_array(values: Iterable[str]) -> Column:
    """A constant list of texts. One expression, however long the list."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def sql_array(items: Iterable[str]) -> Column:
    """An array of SQL expressions, parsed in one go: wide tables plan quickly."""
    return F.expr(f"array({', '.join(items)})")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def fixed_text(value: Column, digits: int) -> Column:
    """Text with fixed decimals, rounded by the exact binary value (ties to even)."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int = 2) -> Column:
    """Rounding by the exact binary value: 0.575 is slightly below the tie and gives 0.57.

    ``F.round`` rounds the shortest decimal text of the value instead.
    """
    return fixed_text(value, digits).try_cast("double")


def safe_rate(part: Column, whole: Column, when_empty: float = 0.0) -> Column:
    """``part / whole`` in percent; ``when_empty`` if there is nothing to divide."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(when_empty))


def pass_rate(total: Column, failed: Column) -> Column:
    """Share of records that passed, in percent with 2 decimals; 0 when empty."""
    return round_exact(safe_rate(total - failed, total))


def lookup(key: Column, values: Mapping[str, object], default: Column) -> Column:
    """Constant map lookup as one expression (the map holds a handful of entries)."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], default) if pairs else default


def normalize_type(data_type: Column) -> Column:
    name = F.trim(F.lower(data_type))
    return lookup(name, fixed.TYPE_ALIASES, name)


def normalize_path(path: Column) -> Column:
    """Request paths with UUIDs and numeric segments replaced by ``:id``."""
    uuid = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.regexp_replace(F.regexp_replace(path, uuid, ":id"), r"/\d+", "/:id")


def metric_unit(name: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(lowered.rlike("duration|time|latency"), "Seconds")
        .when(lowered.rlike("size|bytes"), "Bytes")
        .when(lowered.rlike("count|records|rows"), "Count")
        .when(lowered.rlike("rate|percent"), "Percent")
        .otherwise("None")
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
        .when(score >= 60, "D").otherwise("F")
    )


def sla_band(compliance: Column) -> Column:
    return (
        F.when(compliance >= 95, "Excellent").when(compliance >= 80, "Good")
        .when(compliance >= 60, "Fair").otherwise("Poor")
    )


def health_band(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 60, "degraded").otherwise("unhealthy")


def validator_type(name: Column) -> Column:
    return F.trim(F.replace(F.lower(name), F.lit("validator"), F.lit("")))


def reason_is_retryable(reason: Column) -> Column:
    return F.lower(reason).rlike("|".join(fixed.RETRYABLE_REASONS))


def is_retryable(status: Column, count: Column, maximum: Column) -> Column:
    return status.isin("pending", "failed") & (count < maximum)


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def tag_key(name: Column, tags: Column) -> Column:
    """``name{k=v,...}`` with the tags sorted by key; just ``name`` without tags."""
    pairs = F.transform(
        F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.when(
        F.coalesce(F.size(tags), F.lit(0)) > 0,
        F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}")),
    ).otherwise(name)


def merge_metadata(old: Column, new: Column) -> Column:
    """Two string maps merged, the new value winning on a shared key."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    kept = F.map_filter(old, lambda key, _: ~F.map_contains_key(new, key))
    return F.map_concat(kept, new)


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON text with sorted keys and NULLs kept: the input of a record hash."""
    return F.to_json(
        F.struct(*[named(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}
    )


def record_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def batch_id(at: Column) -> Column:
    """``batch_<timestamp>_<8 hex>``; random, so never part of a repeatable result."""
    return F.concat(
        F.lit("batch_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"),
        F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8),
    )


def object_name(prefix: str, at: Column, name: Column) -> Column:
    """``<prefix><timestamp>_<uuid>_<name>``; random, see :func:`batch_id`."""
    return F.concat(
        F.lit(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"),
        F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("_"), name,
    )
