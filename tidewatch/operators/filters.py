"""Optional filters, paging, retention and text search over monitoring tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import named


def condition(column: str, op: str, value: Any) -> Column:
    c = named(column)
    if op == "eq":
        return c == F.lit(value)
    if op == "ge":
        return c >= F.lit(value)
    if op == "le":
        return c <= F.lit(value)
    if op == "in":
        return c.isin(*value)
    if op == "contains":
        return F.contains(F.lower(c), F.lit(str(value).lower()))
    if op == "eq_ignore_case":
        return F.upper(c) == str(value).upper()
    if op == "on_day":
        day = F.lit(value).cast("date")
        # A range of timestamps instead of a cast of the column: it reaches the scan.
        return (c >= day.cast("timestamp_ntz")) & (c < F.date_add(day, 1).cast("timestamp_ntz"))
    raise ValueError(f"unknown operator: {op}")


def apply_filters(df: DataFrame, *conditions: tuple[str, str, Any]) -> DataFrame:
    """Keep rows meeting every (column, op, value); a value of None is no condition."""
    for column, op, value in conditions:
        if value is not None:
            df = df.filter(condition(column, op, value))
    return df


def sort_page(
    df: DataFrame,
    sort_by: str,
    tie: Sequence[str],
    descending: bool = True,
    limit: int = 100,
    offset: int = 0,
    default: str = "created_at",
) -> DataFrame:
    """One page in a total order; an unknown sort column falls back to ``default``."""
    column = sort_by if sort_by in df.columns else default
    first = named(column).desc() if descending else named(column).asc()
    ties = [named(t).desc() if descending else named(t).asc() for t in tie if t != column]
    return df.orderBy(first, *ties).offset(offset).limit(limit)


def recent(df: DataFrame, ts: str, tie: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows (a per-task top-n, then a merge of those)."""
    return sort_page(df, ts, tie, True, n, 0, ts)


def oldest(df: DataFrame, ts: str, tie: Sequence[str], n: int) -> DataFrame:
    return sort_page(df, ts, tie, False, n, 0, ts)


def count_rows(df: DataFrame, name: str = "total_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """Total number of rows and whether a page after this one exists."""
    return count_rows(df).withColumn("has_more", F.lit(offset + limit) < F.col("total_count"))


def since_days(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.filter(named(ts) >= F.timestamp_add("DAY", F.lit(-days), as_of))


def since_midnight_days(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Like :func:`since_days`, counted from the midnight before ``as_of``."""
    midnight = as_of.cast("date").cast("timestamp_ntz")
    return since_days(df, ts, midnight, days)


def retention_split(df: DataFrame, ts: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, count of expired rows) for a table rewritten without old rows.

    Rows without a time are kept: they are not known to be old.
    """
    cutoff = F.timestamp_add("DAY", F.lit(-days), as_of)
    kept = df.filter((named(ts) >= cutoff) | named(ts).isNull())
    deleted = df.agg(F.count_if(named(ts) < cutoff).alias("deleted_count"))
    return kept, deleted


def retention_counts(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Kept and deleted rows of a retention run; rows without a time are kept."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), as_of)
    return df.agg(
        F.count_if(named(ts) < cutoff).alias("deleted_count"),
        F.count_if((named(ts) >= cutoff) | named(ts).isNull()).alias("kept_count"),
    )


def text_search(
    df: DataFrame, text: str, columns: Sequence[str], tags: str | None = None
) -> DataFrame:
    """Rows with the text in any column or tag, ignoring case."""
    needle = F.lit(text.lower())
    hits = [F.contains(F.lower(F.coalesce(named(c), F.lit(""))), needle) for c in columns]
    if tags:
        hits.append(F.exists(named(tags), lambda t: F.contains(F.lower(t), needle)))
    keep = hits[0]
    for hit in hits[1:]:
        keep = keep | hit
    return df.filter(keep)


def integrity_violations(
    df: DataFrame,
    dataset: str | None = None,
    validation_type: str | None = None,
    status: str | None = None,
    day: str | None = None,
) -> DataFrame:
    """Failed checks, narrowed by equality and by calendar day."""
    return apply_filters(
        df,
        ("dataset_name", "eq", dataset),
        ("validation_type", "eq", validation_type),
        ("status", "eq", status),
        ("created_at", "on_day", day),
    )


def log_search(
    df: DataFrame,
    level: str | None = None,
    logger: str | None = None,
    search: str | None = None,
    start: Any = None,
    end: Any = None,
) -> DataFrame:
    return apply_filters(
        df,
        ("level", "eq_ignore_case", level),
        ("logger", "contains", logger),
        ("message", "contains", search),
        ("timestamp", "ge", start),
        ("timestamp", "le", end),
    )


def filter_options(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """(field, value): distinct non-empty values of several columns.

    The columns are unpivoted and deduplicated on the map side, so a column
    with many values stays distributed.
    """
    rows = F.array(
        *[F.struct(F.lit(c).alias("field"), named(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(rows)).filter(F.length("value") > 0).distinct()
