"""Positions of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.text import unused_name
from tidewatch.session import written

_SHIFT = 33


def numbered(rows: DataFrame, group: list[str], order: list[Column], position: str, total: str) -> DataFrame:
    """``rows`` with ``position``, 0, 1, 2, ... in the order of ``order`` within ``group``, and ``total``, the rows of the group.

    Rows are sorted into ranges of (group, order), so that a group of any size is spread
    over tasks; rows equal in all of it are spread as well and take any order. Nulls come
    first and are a group of their own. Only one count per range and group is carried on.
    ``rows`` must give the same rows each time they are read, such as a written table.
    The result is a written table.
    """
    at, salt = unused_name(rows, "row_at"), unused_name(rows, "row_salt")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group] + [*order, F.col(salt).asc()]
    sorted_rows = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    placed = written(sorted_rows.drop(salt).withColumn(at, F.monotonically_increasing_id()), "sorted")
    # Ranges follow the order, so the rows of a group are consecutive in a range and ranges of a group follow each other.
    part = F.shiftright(at, _SHIFT).alias("_part")
    counts = placed.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.struct(*group, "_part").alias("_range"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_total"),
    )
    joined = placed.withColumn("_range", F.struct(*group, part)).join(offsets, "_range")
    return joined.select(*rows.columns, (F.col(at) + F.col("_shift")).alias(position), F.col("_total").alias(total))
