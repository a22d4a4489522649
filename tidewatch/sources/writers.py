"""Writers: processed copies, partitioned output, exports and append-only tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import named


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def dated_path(prefix: str, year: int, month: int, day: int) -> str:
    return f"{prefix.rstrip('/')}/{year:04d}/{month:02d}/{day:02d}"


def write_partitioned(
    df: DataFrame, path: str, kind: str = "parquet", keys: Sequence[str] = (), mode: str = "append",
    max_records_per_file: int = 0,
) -> None:
    """Parquet or JSON, partitioned by ``keys``.

    Rows are spread by the keys and a random number before the write: a hot key
    is written by many tasks, and a rare one does not leave a file per task.
    AQE sizes the shuffle partitions.
    """
    if kind not in ("parquet", "json"):
        raise ValueError(f"Unsupported output format: {kind}")
    if keys:
        df = df.hint("rebalance", *[named(k) for k in keys])
    writer = df.write.mode(mode).format(kind)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    (writer.partitionBy(*keys) if keys else writer).save(path)


@dataclass(frozen=True)
class WriteReport:
    """What was measured while a table was written: rows, NULLs per column, and rows that failed each check."""

    path: str
    record_count: int
    nulls: dict[str, int]
    failed: dict[str, int]

    def rows(self, spark) -> DataFrame:
        """(kind, name, failed_records, total_records), one row per column and per check."""
        listed = [("nulls", c, n, self.record_count) for c, n in self.nulls.items()]
        listed += [("check", c, n, self.record_count) for c, n in self.failed.items()]
        return spark.createDataFrame(listed, "kind string, name string, failed_records bigint, total_records bigint")


class CheckFailed(ValueError):
    """A table was not kept because too many of its rows failed a check."""

    def __init__(self, report: WriteReport, names: list[str]):
        super().__init__(f"too many failed rows: {', '.join(f'{n} {report.failed[n]} of {report.record_count}' for n in names)}")
        self.report, self.names = report, names


def write_observed(
    df: DataFrame, path: str, kind: str = "parquet", keys: Sequence[str] = (), checks: dict[str, Column] | None = None,
    allowed: dict[str, float] | None = None, nulls: bool = True,
) -> WriteReport:
    """Write a new table and measure it in the same job; nothing is read again.

    ``checks`` are conditions that a good row meets; a NULL verdict is a failure. A check
    named in ``allowed`` may fail for that share of the rows: beyond it the folder is
    removed and ``CheckFailed`` raised, so that readers never meet a bad table under its name. The
    table is first written beside ``path`` and renamed once it has passed.

    The counts belong to the tasks that write: a task that is repeated counts once, as
    no shuffle follows the place where they are taken.
    """
    if kind not in ("parquet", "json"):
        raise ValueError(f"Unsupported output format: {kind}")
    checks, allowed = dict(checks or {}), dict(allowed or {})
    unknown = sorted(set(allowed) - set(checks))
    if unknown:
        raise ValueError(f"no such check: {', '.join(unknown)}")
    columns = df.columns if nulls else []
    measures = [F.count(F.lit(1)).alias("n")]
    measures += [F.count_if(named(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)]
    measures += [F.count_if(~F.coalesce(condition, F.lit(False))).alias(f"check_{i}") for i, condition in enumerate(checks.values())]
    spread = df.hint("rebalance", *[named(k) for k in keys]) if keys else df
    seen = Observation()
    spark, draft = df.sparkSession, f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    system, target, written_to = _file_system(spark, path, draft)
    if system.exists(target):
        raise ValueError(f"{path} exists already")
    writer = spread.observe(seen, *measures).write.format(kind)
    if kind == "json":
        writer = writer.option("ignoreNullFields", False)
    try:
        (writer.partitionBy(*keys) if keys else writer).save(draft)
        got = seen.get
        report = WriteReport(
            path, got["n"], {c: got[f"null_{i}"] for i, c in enumerate(columns)}, {c: got[f"check_{i}"] for i, c in enumerate(checks)}
        )
        failed = [c for c, share in allowed.items() if report.failed[c] > share * report.record_count]
        if failed:
            raise CheckFailed(report, failed)
        system.mkdirs(target.getParent())
        if not system.rename(written_to, target):
            raise ValueError(f"{path} exists already")
    finally:
        system.delete(written_to, True)
    return report


def _file_system(spark, *names: str):
    """The file system of the first path, and all paths."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), *paths


def ingest(df: DataFrame, path: str, kind: str = "parquet", n: int = 5, **more) -> tuple[WriteReport, DataFrame]:
    """Write arriving records once; the report of that write, and the first ``n`` written rows with the number of all rows.

    The rows are the first that a reader of the files meets, so no more than the beginning of a file is read.
    """
    report = write_observed(df, path, kind, **more)
    return report, df.sparkSession.read.schema(df.schema).format(kind).load(path).limit(n).withColumn("record_count", F.lit(report.record_count))


def header_label(column: str) -> str:
    return column[:1].upper() + column[1:].replace("_", " ")


def export_frame(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Text columns with readable headers: nested values as JSON, NULL as an empty text."""
    def text(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = F.to_json(named(field.name)) if nested else named(field.name).cast("string")
        return F.coalesce(value, F.lit(""))

    labels = labels or {}
    return df.select(
        *[text(f).alias(labels.get(f.name, header_label(f.name))) for f in df.schema.fields]
    )


def export_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Every field quoted, quotes doubled, one header per file."""
    (
        export_frame(df, labels).write.mode(mode)
        .option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "")
        .csv(path)
    )


def append(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Append rows to a monitoring table kept as Parquet."""
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def replace_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Write a rewritten table to a new path (never over the path it is read from)."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def metric_row(df: DataFrame, name: str, kind: str, value: Column, at: Column, **columns: Column) -> DataFrame:
    """Rows of the metrics table; fields not given are NULL."""
    optional = {
        "execution_time": "double", "dataset_name": "string", "validation_type": "string",
        "dag_id": "string", "task_id": "string",
    }
    return df.select(
        F.lit(name).alias("metric_name"),
        value.cast("double").alias("metric_value"),
        F.lit(kind).alias("metric_type"),
        at.alias("timestamp"),
        *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
    )


# Names and types of the standard metrics.
STANDARD_METRICS = {
    "validation_success": "counter",
    "validation_failure": "counter",
    "validation_warning": "counter",
    "ingestion_execution": "counter",
    "ingestion_success": "counter",
    "ingestion_failure": "counter",
    "validation_duration": "histogram",
    "ingestion_duration": "histogram",
    "api_request_duration": "histogram",
}


def ingest_preview(df: DataFrame, *order: Column, n: int = 5) -> DataFrame:
    """The first rows with the number of all rows next to them."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(*order).limit(n).withColumn("record_count", total.scalar())


def profile_rows(profile: DataFrame, profiled_by: str, at: Column) -> DataFrame:
    """Profile results as table rows, one per column, with status ``completed``."""
    return profile.withColumn("status", F.lit("completed")).withColumn(
        "error_message", F.lit(None).cast("string")
    ).withColumn("profiled_by", F.lit(profiled_by)).withColumn("profiled_at", at)


def failed_profile_row(spark, dataset_name: str, error: str, profiled_by: str, at: Column) -> DataFrame:
    """The row of a profiling run that could not finish."""
    return spark.range(1).select(
        F.lit(dataset_name).alias("dataset_name"), F.lit("failed").alias("status"),
        F.lit(error).alias("error_message"), F.lit(profiled_by).alias("profiled_by"), at.alias("profiled_at"),
    )
