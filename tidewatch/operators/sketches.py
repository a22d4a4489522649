"""Mergeable sketches of columns and of measured values, stored beside profiles and metrics.

A day's sketch is a few kilobytes per column, whatever the day's size. Days merge into
weeks and months, and hours into any window, without reading a row again. Counts,
sums, smallest and largest values are exact; distinct numbers and quantiles are estimates
within the bounds below. The exact operators stay for where that is not enough.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import named

#: log2 of the registers of a distinct-number sketch.
REGISTERS = 12
#: Size of a quantile sketch.
SIZE = 400
#: A distinct number is within this share of the truth in all but one of a thousand cases (3.3 standard errors).
DISTINCT_ERROR = 3.3 * 1.04 / math.sqrt(1 << REGISTERS)
#: The rank of a quantile is within this share of the rows in 99 of 100 cases, also after merging.
RANK_ERROR = 2.446 / SIZE**0.9433


def _distinct_input(field: T.StructField) -> Column:
    """The value as the sketch takes it; other types go by their text, -0.0 as 0.0."""
    if isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return named(field.name)
    if isinstance(field.dataType, (T.ByteType, T.ShortType)):
        return named(field.name).cast("int")
    value = named(field.name)
    return (value + F.lit(0.0) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else value).cast("string")


def _number(column: Column) -> Column:
    """A value that a quantile sketch can order: NaN is left out like NULL."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, row_count, null_count, distinct_sketch, value_count, value_sum, minimum, maximum, value_sketch), one row per column and group.

    One scan and one small shuffle: every task sends one sketch per column and group. The
    value fields are those of numeric columns, NULL for others. ``by`` are columns such as the day; their
    groups should be few against the rows.
    """
    fields = {f.name: f for f in df.schema.fields}
    columns = list(columns or [c for c in df.columns if c not in by])
    measures, entries = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        measures.append(F.count(named(c)).alias(f"c{i}"))
        measures.append(F.hll_sketch_agg(_distinct_input(fields[c]), REGISTERS).alias(f"d{i}"))
        shared = {"column_name": F.lit(c), "row_count": F.col("n"), "null_count": F.col("n") - F.col(f"c{i}"), "distinct_sketch": F.col(f"d{i}")}
        if isinstance(fields[c].dataType, T.NumericType):
            value = _number(named(c))
            measures += [F.count(value).alias(f"v{i}"), F.sum(value).alias(f"s{i}"), F.min(value).alias(f"l{i}"), F.max(value).alias(f"h{i}")]
            measures.append(F.kll_sketch_agg_double(value, SIZE).alias(f"q{i}"))
            own = [F.col(f"{k}{i}") for k in "vslhq"]
        else:
            own = [F.lit(None).cast(k) for k in ("bigint", "double", "double", "double", "binary")]
        shared |= dict(zip(("value_count", "value_sum", "minimum", "maximum", "value_sketch"), own))
        entries.append(F.struct(*[v.alias(k) for k, v in shared.items()]))
    grouped = df.groupBy(*[named(b) for b in by]).agg(*measures)
    return grouped.select(*[named(b) for b in by], F.inline(F.array(*entries)))


def merged_profiles(stored: DataFrame, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """Stored sketches put together per ``keys``: days to a month, parts to a whole. No data is read."""
    return stored.groupBy(*[named(k) for k in keys]).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.sum("value_count").alias("value_count"),
        F.sum("value_sum").alias("value_sum"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def quantile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))


def profile_estimates(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches as figures: ``unique_estimate``, ``mean`` and one ``p<percent>`` column per probability; NULL where a column has no numbers."""
    has_values = F.col("value_count") > 0
    figures = {"unique_estimate": F.hll_sketch_estimate("distinct_sketch"), "mean": F.when(has_values, F.col("value_sum") / F.col("value_count"))}
    figures |= {f"p{round(100 * p):02d}": F.when(has_values, quantile(F.col("value_sketch"), p)) for p in probabilities}
    return sketches.withColumns(figures).drop("distinct_sketch", "value_sketch")


def value_sketches(df: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "hour") -> DataFrame:
    """(keys, period, value_count, value_sum, minimum, maximum, value_sketch): measured values per key and hour (or ``width``).

    NULL values and NULL times are left out.
    """
    rows = df.select(*[named(k) for k in keys], F.date_trunc(width, named(ts)).alias("period"), _number(named(value)).alias("_v"))
    return rows.filter("_v IS NOT NULL AND period IS NOT NULL").groupBy(*[named(k) for k in keys], "period").agg(
        F.count("_v").alias("value_count"), F.sum("_v").alias("value_sum"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum"),
        F.kll_sketch_agg_double("_v", SIZE).alias("value_sketch"),
    )


def window_percentiles(
    stored: DataFrame, keys: Sequence[str], start: Column | None = None, end: Column | None = None, probabilities: Sequence[float] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """(keys, value_count, value_sum, minimum, maximum, p50, ...) over the stored periods from ``start`` up to, but not with, ``end``.

    The bounds should be those of periods: a period counts whole by its beginning.
    """
    rows = stored
    if start is not None:
        rows = rows.filter(F.col("period") >= start)
    if end is not None:
        rows = rows.filter(F.col("period") < end)
    merged = rows.groupBy(*[named(k) for k in keys]).agg(
        F.sum("value_count").alias("value_count"), F.sum("value_sum").alias("value_sum"), F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"), F.kll_merge_agg_double("value_sketch").alias("_sketch"),
    )
    return merged.withColumns({f"p{round(100 * p):02d}": quantile(F.col("_sketch"), p) for p in probabilities}).drop("_sketch")


def sliding_percentiles(stored: DataFrame, keys: Sequence[str], periods: int, probabilities: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, period, value_count, p50, ...) over each stored period and the ``periods`` - 1 before it, by time in hours.

    A key has one row per period, so its window is as long as its history and not as its data. Every
    period is sent to the windows it belongs to and merged there.
    """
    ends = F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))
    spread = stored.select("*", ends.alias("_later")).withColumn("_end", F.timestamp_add("HOUR", F.col("_later"), F.col("period")))
    merged = spread.groupBy(*[named(k) for k in keys], "_end").agg(
        F.sum("value_count").alias("value_count"), F.kll_merge_agg_double("value_sketch").alias("_sketch"),
        F.max(F.col("_later") == 0).alias("_own"),
    )
    rows = merged.filter("_own").withColumnRenamed("_end", "period")
    return rows.withColumns({f"p{round(100 * p):02d}": quantile(F.col("_sketch"), p) for p in probabilities}).drop("_sketch", "_own")


def rank_range(df: DataFrame, keys: Sequence[str], value: str, estimate: str) -> DataFrame:
    """(keys, low, high): the shares of a key's values below its ``estimate`` and not above it; the wanted probability lies between them, give or take the rank error.

    ``estimate`` is a column that is the same in all rows of a key.
    """
    return df.groupBy(*[named(k) for k in keys]).agg(
        (F.count_if(named(value) < named(estimate)) / F.count(named(value))).alias("low"),
        (F.count_if(named(value) <= named(estimate)) / F.count(named(value))).alias("high"),
    )
