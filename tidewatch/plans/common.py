"""Small helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# End of the test data: orders run to the summer of 2001, events through January 2024.
ORDERS_END = "2001-08-02 00:00:00"
EVENTS_END = "2024-01-31 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and lists as text, so that results compare across engines."""
    def shaped(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(f.name, digits).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(f.name, ";").alias(f.name)
        return F.col(f.name)

    return df.select(*[shaped(f) for f in df.schema.fields])


def verdict(df: DataFrame, *extra: str) -> DataFrame:
    """The comparable columns of validator results."""
    return tidy(
        df.select(
            *extra, "validator_name", "status", "passed", "total_records", "failed_records", "pass_rate",
            "message", "errors",
        )
    )
