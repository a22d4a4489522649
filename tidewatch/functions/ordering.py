"""Ordered work inside groups of any size.

A window over ``partitionBy(key).orderBy(ts)`` puts a whole group into one
task, which fails once one key holds a large share of the rows. The helpers
here cut the rows into slices along the order, as many as the shuffle is wide, run
the window inside (key, slice), and carry the running state from slice to
slice with a second window over one summary row per key and slice.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scalars import named
from tidewatch.session import written

SLICE = "_slice"
KEY = "_key"
#: Slices of the values among which an exact quantile is looked for; the profiler passes the middle fiftieth only.
QUANTILE_SLICES = 64


def slice_count(df: DataFrame) -> int:
    """Slices of the whole order: the shuffle width, which grows with the cluster and the data."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _edges(bounds: list[int] | None) -> list[float]:
    """Borders of buckets: one for each distinct bound, which holds that value alone, and those between."""
    inner = sorted({x for b in set(bounds or ()) for x in (float(b), math.nextafter(float(b), math.inf))})
    return [-math.inf, *inner, math.inf]


def _bucket(df: DataFrame, value: str, edges: list[float], name: str) -> DataFrame:
    """The bucket of a value by binary search; NULL is in the first."""
    number = f"{name}_double"
    prepared = df.withColumn(number, F.coalesce(F.col(value).cast("double"), F.lit(-math.inf)))
    if len(edges) < 3:
        return prepared.withColumn(name, F.lit(0)).drop(number)
    return Bucketizer(splits=edges, inputCol=number, outputCol=name).transform(prepared).drop(number)


def with_slices(
    df: DataFrame, keys: list[str], order: Column, tie: Column, slices: int | None = None
) -> DataFrame:
    """Add ``_key`` and ``_slice``, a number that sorts like (order, tie).

    ``order`` and ``tie`` must be BIGINT expressions and ``tie`` should be unique.
    Boundaries are quantiles of ``order``, so a slice holds about 1/n of all rows,
    also of those of one key. Rows equal to a boundary get a slice of their own, cut again by the
    quantiles of ``tie``: a single timestamp shared by a third of the rows is split as
    well. A row finds its slice by two binary searches.

    The rows are computed once and written; a second job takes the 2n quantiles from the two
    order columns of that table, and what the caller does with the slices reads it too. So this
    runs when the plan is built, and a lost executor changes no row's place.

    ``_key`` is a struct, in which NULL keys are equal to each other, so the
    windows and joins on (``_key``, ``_slice``) share one shuffle.
    """
    n = slices or slice_count(df)
    points = [i / n for i in range(1, n)]
    rows = written(df.select("*", order.alias("_o"), tie.alias("_t")), "ordered")
    found = rows.agg(F.percentile_approx("_o", points, 50 * n), F.percentile_approx("_t", points, 50 * n)).first()
    edges, ties = _edges(found[0]), _edges(found[1])
    keyed = rows.withColumn(KEY, F.struct(*[named(k) for k in keys]))
    placed = _bucket(_bucket(keyed, "_o", edges, "_below"), "_t", ties, "_within")
    # Odd buckets hold one value of the order, a boundary.
    singles = [i for i in range(len(edges) - 1) if i % 2]
    # Beyond 2^53 several integers share a double, and such a bucket is not cut again.
    exact = F.col("_o").between(-(1 << 53), 1 << 53)
    on_bound = exact & (F.col("_below").cast("long") % 2 == 1) if singles else F.lit(False)
    number = F.col("_below").cast("long") * len(ties) + F.when(on_bound, F.col("_within").cast("long")).otherwise(0)
    return placed.withColumn(SLICE, number).drop("_below", "_within")


def ordered_row_number(
    df: DataFrame, keys: list[str], order: Column, tie: Column, name: str = "row_number"
) -> DataFrame:
    """1, 2, 3, ... per key in (order, tie) order, for groups of any size."""
    sliced = with_slices(df, keys, order, tie)
    so_far = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(KEY, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(KEY, SLICE, F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(KEY, SLICE).orderBy("_o", "_t")
    ranked = sliced.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(offsets, [KEY, SLICE]).select(
        *[named(c) for c in df.columns], (F.col("_before") + F.col("_rank")).alias(name)
    )


def ordered_changes(
    df: DataFrame, keys: list[str], order: Column, tie: Column, value: str
) -> DataFrame:
    """Rows whose ``value`` differs from the previous row of the key, numbered per key.

    Adds ``version_number`` (1 for the first row of a key, then +1 per change)
    and ``previous_value``. Unchanged rows are dropped. ``value`` must not be NULL.
    """
    sliced = with_slices(df, keys, order, tie)
    inside = Window.partitionBy(KEY, SLICE).orderBy("_o", "_t")
    marked = sliced.withColumn("_lag", F.lag(named(value)).over(inside)).withColumn(
        "_inner", F.when(F.col("_lag") != named(value), 1).otherwise(0)
    )
    position = F.struct("_o", "_t")
    summary = marked.groupBy(KEY, SLICE).agg(
        F.min_by(named(value), position).alias("_first"),
        F.max_by(named(value), position).alias("_last"),
        F.sum("_inner").alias("_changes"),
    )
    across = Window.partitionBy(KEY).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    entered = summary.withColumn("_prev", F.lag("_last").over(across)).withColumn(
        "_enter",
        F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("_first")), 1).otherwise(0),
    )
    carried = entered.select(
        KEY,
        SLICE,
        "_prev",
        "_enter",
        F.coalesce(F.sum(F.col("_changes") + F.col("_enter")).over(before), F.lit(0)).alias("_base"),
    )
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = marked.withColumn("_run", F.sum("_inner").over(running)).join(carried, [KEY, SLICE])
    changed = F.when(F.col("_lag").isNull(), F.col("_enter")).otherwise(F.col("_inner")) == 1
    return joined.filter(changed).select(
        *[named(c) for c in df.columns],
        F.coalesce(F.col("_lag"), F.col("_prev")).alias("previous_value"),
        (F.col("_base") + F.col("_enter") + F.col("_run")).alias("version_number"),
    )


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row per key; ``order`` sorts the wanted row first."""
    return first_n_per_key(df, keys, 1, *order).drop("row_number")


def first_n_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per key with their ``row_number``.

    Spark turns ``row_number <= n`` into a limit per key before the shuffle
    (WindowGroupLimit, n up to 1000), so a hot key sends n rows per task.
    """
    w = Window.partitionBy(*[named(k) for k in keys]).orderBy(*order)
    return df.withColumn("row_number", F.row_number().over(w)).filter(F.col("row_number") <= n)


def exact_quantiles(
    histogram: DataFrame, group: str, value: str, count: str, p: float, name: str
) -> DataFrame:
    """Exact interpolated quantile per group from a (group, value, count) histogram.

    The histogram is already one row per distinct value, so hot values are one
    row. Ranks are found in two steps: counts per value slice, then a sort of
    only those slices that hold the wanted ranks. The broadcast sides have one
    row (bounds) and at most two rows (wanted slices) per group, so ``group``
    must be of bounded size, such as the columns of a table.
    """
    n = QUANTILE_SLICES
    points = [i / n for i in range(1, n)]
    bounds = histogram.groupBy(named(group).alias("_g")).agg(
        F.percentile_approx(named(value), points, 50 * n).alias("_bounds")
    )
    sliced = histogram.join(F.broadcast(bounds), named(group) == F.col("_g")).withColumn(
        SLICE, F.size(F.filter("_bounds", lambda b: b < named(value)))
    )
    weights = sliced.groupBy(named(group).alias("_g"), F.col(SLICE).alias("_s")).agg(
        F.sum(named(count)).alias("_w")
    )
    everything = Window.partitionBy("_g")
    upto = everything.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        weights.withColumn("_total", F.sum("_w").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn("_position", (F.col("_total") - 1) * F.lit(float(p)))
        .withColumn("_low", F.floor("_position"))
        .withColumn("_high", F.ceil("_position"))
        .filter(
            ((F.col("_low") >= F.col("_before")) & (F.col("_low") < F.col("_before") + F.col("_w")))
            | ((F.col("_high") >= F.col("_before")) & (F.col("_high") < F.col("_before") + F.col("_w")))
        )
    )
    inside = Window.partitionBy("_g", "_s").orderBy(named(value))
    ranked = (
        sliced.drop("_g")
        .join(F.broadcast(wanted), (named(group) == F.col("_g")) & (F.col(SLICE) == F.col("_s")))
        .withColumn("_end", F.col("_before") + F.sum(named(count)).over(inside))
        .withColumn("_start", F.col("_end") - named(count))
    )
    low = F.max(F.when((F.col("_low") >= F.col("_start")) & (F.col("_low") < F.col("_end")), named(value)))
    high = F.max(F.when((F.col("_high") >= F.col("_start")) & (F.col("_high") < F.col("_end")), named(value)))
    share = F.max(F.col("_position") - F.col("_low"))
    return ranked.groupBy(named(group)).agg((low + (high - low) * share).alias(name))
