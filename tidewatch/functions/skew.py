"""Joins of rows with one result row per key, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import named

HOT_KEYS = 10_000


def _identity(keys: Sequence[str]) -> Column:
    """128 bits that stand for a key, however long its text is."""
    columns = [named(k) for k in keys]
    return F.struct(F.xxhash64(*columns).alias("low"), F.xxhash64(F.lit("high"), *columns).alias("high"))


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join (``inner`` or ``left``) of ``rows`` with ``per_key``: one row per key, with the ``count`` of its rows.

    AQE only splits a skewed side if the other side comes straight from a
    shuffle, not from an aggregation like ``per_key``. So hot keys are treated
    apart: fewer than 10 000 keys can hold more than a ten-thousandth of all
    rows each, so their entries are broadcast and rows with a hot key are never
    shuffled. An entry is 128 bits of the key and the values, never the key
    itself, so the broadcast is bounded in bytes as well. All other rows take an
    ordinary join. Both branches share the broadcast. NULL keys have no partner.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    # The join below would drop NULL keys of its own branch only, and Spark would then count the keys twice.
    for k in keys:
        per_key = per_key.filter(named(k).isNotNull())
    marked = per_key.withColumn("_total", total)
    is_hot = F.col(count) * HOT_KEYS > F.col("_total")
    values = [c for c in per_key.columns if c not in keys]
    hot = marked.filter(is_hot).select(
        _identity(keys).alias("_identity"), F.struct(*[named(v) for v in values]).alias("_hot")
    )
    columns = [named(c) for c in rows.columns]
    complete = F.lit(True)
    for k in keys:
        complete = complete & named(k).isNotNull()
    tagged = rows.withColumn("_identity", F.when(complete, _identity(keys)))
    by_broadcast = tagged.join(F.broadcast(hot), "_identity").select(*columns, "_hot.*")
    others = tagged.join(F.broadcast(hot), "_identity", "left").filter(F.col("_hot").isNull()).select(*columns)
    by_shuffle = others.join(marked.filter(~is_hot).drop("_total"), keys, how)
    return by_broadcast.unionByName(by_shuffle)
