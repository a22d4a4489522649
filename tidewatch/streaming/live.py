"""Live counters, hourly series and file ingestion with Structured Streaming.

Every micro-batch writes its own ``batch_id=<n>`` folder and overwrites it when
the batch is repeated after a failure, so results are neither lost nor doubled.
State and offsets live in the checkpoint folder on shared storage. ``compact``
turns finished batches into one snapshot beside the sink, so that reading the current
state does not grow with the age of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidewatch.functions.scalars import named


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", pattern: str = "*",
    files_per_batch: int = 1000,
) -> DataFrame:
    """A stream over files arriving in a folder."""
    return (
        spark.readStream.schema(schema).format(kind).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )


def _start(
    df: DataFrame, sink: str, checkpoint: str, mode: str, transform: Callable[[DataFrame], DataFrame],
    every: str | None,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_counters(
    events: DataFrame, keys: Sequence[str], value: str, sink: str, checkpoint: str, every: str | None = None,
    ts: str | None = None, period: str | None = None, late: str = "0 seconds",
) -> StreamingQuery:
    """Running count and sum per key; each batch writes the counters it changed.

    With ``ts`` and ``period`` counters run per key and period, and the state of a period
    goes once events are ``late`` beyond its end, so it does not grow with the age of
    the stream; ``current_state`` keyed by (period, keys) keeps them, and their sums are the totals.
    """
    columns: list[Column] = [named(k) for k in keys]
    if ts and period:
        events = events.withColumn(ts, named(ts).cast("timestamp")).withWatermark(ts, late)
        columns.insert(0, F.window(named(ts), period).alias("w"))
    totals = events.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"), F.sum(named(value)).alias("total"))
    if ts and period:
        totals = totals.select(F.col("w.start").cast("timestamp_ntz").alias("period"), *keys, "count", "total")
    return _start(totals, sink, checkpoint, "update", lambda d: d, every)


class _IdleCounter(StatefulProcessor):
    """Count and sum of one key since its state began; a timer ends the state once the key is idle."""

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "began bigint, last bigint, n bigint, total double")

    def _row(self, key, began: int, n: int, total: float, closed: bool) -> pd.DataFrame:
        values = dict(zip(self.keys, key)) | {"began": began, "count": n, "total": total, "closed": closed}
        return pd.DataFrame({k: [v] for k, v in values.items()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's names
        held = self.counts.get() if self.counts.exists() else None
        began, last, n, total = held if held is not None else (None, None, 0, 0.0)
        for frame in rows:
            # Spark hands computed columns over without their names: value, time, milliseconds come last.
            values, times = frame.iloc[:, -3], frame.iloc[:, -1]
            began = int(times.min()) if began is None else began
            last = int(times.max()) if last is None else max(last, int(times.max()))
            n, total = n + len(frame), total + float(values.sum())
        if held is not None:
            self.handle.deleteTimer(held[1] + self.idle_ms)
        # A key that only late rows have reached ends with the next watermark.
        self.handle.registerTimer(last + self.idle_ms)
        self.counts.update((began, last, n, total))
        yield self._row(key, began, n, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        began, last, n, total = self.counts.get()
        self.counts.clear()
        yield self._row(key, began, n, total, True)

    def close(self) -> None:
        pass


def expiring_counters(
    events: DataFrame, keys: Sequence[str], value: str, ts: str, sink: str, checkpoint: str,
    idle: str = "1 day", late: str = "1 hour", every: str | None = None,
) -> StreamingQuery:
    """Running count and sum per key whose state goes once the key had no event for ``idle``.

    A key's rows belong to the state that is open when they arrive, from its first event on
    (``began``); when the watermark, ``late`` behind the newest event, passes the last event by
    ``idle``, the state is dropped and the row closed. A key that comes back opens a new
    state, so the state kept is that of recently active keys, and the sums over all
    states of a key are its exact totals (``session_totals``). Rows are dropped if they are later
    than the watermark allows, NULL times as well; a NULL value adds nothing to the sum.

    One task handles a key's rows of a batch as a stream of Arrow batches. Needs the RocksDB state store, which
    is set for this stream.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    timed = events.filter(named(ts).isNotNull()).select(
        *[named(k) for k in keys], F.coalesce(named(value).cast("double"), F.lit(0.0)).alias("_value"),
        named(ts).cast("timestamp").alias("_at"), F.unix_millis(named(ts).cast("timestamp")).alias("_ms"),
    ).withWatermark("_at", late)
    idle_ms = spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).alias("ms")).first()[0]
    counted = timed.groupBy(*[named(k) for k in keys]).transformWithStateInPandas(
        _IdleCounter(list(keys), idle_ms), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", began bigint, count bigint, total double, closed boolean",
        "Update", "eventTime",
    )
    return _start(counted, sink, checkpoint, "update", lambda d: d, every)


def session_totals(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """(keys, count, total): sums over all states of ``expiring_counters``, open and closed."""
    states = current_state(spark, sink, [*keys, "began"], ["count", "total"])
    return states.groupBy(*[named(k) for k in keys]).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def stream_timeseries(
    points: DataFrame, ts: str, keys: Sequence[str], value: str, sink: str, checkpoint: str,
    retention: str = "24 hours", width: str = "1 hour", every: str | None = None,
) -> StreamingQuery:
    """Count and sum per key and hour; points later than the retention are dropped with their state."""
    # Watermarks need a timestamp with zone; the hours are handed back without one.
    hours = (
        points.withColumn(ts, named(ts).cast("timestamp")).withWatermark(ts, retention)
        .groupBy(F.window(named(ts), width).alias("w"), *[named(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("count"), F.sum(named(value)).alias("total"))
    )
    shaped = hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), *keys, "count", "total")
    return _start(shaped, sink, checkpoint, "update", lambda d: d, every)


def stream_ingest(
    files: DataFrame, validate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Validate every batch of arriving files and keep its result rows."""
    return _start(files, sink, checkpoint, "append", validate, every)


def _folders(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Finished ``<prefix>=<number>`` folders by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.listStatus(path) if files.exists(path) else []:
        name, child = status.getPath().getName(), status.getPath()
        if name.startswith(f"{prefix}=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
            found[int(name.split("=", 1)[1])] = child.toString()
    return found


def _newest(spark: SparkSession, sink: str, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, int]:
    """The newest values per key with their batch, from the last snapshot and the batches after it; the last batch."""
    snapshots, batches = _folders(spark, f"{sink}-snapshots", "upto"), _folders(spark, sink, "batch_id")
    upto = max(snapshots, default=-1)
    later = [path for n, path in batches.items() if n > upto]
    columns = [*keys, *values, "batch_id"]
    parts = [spark.read.parquet(snapshots[upto]).select(*columns)] if upto >= 0 else []
    if later:
        parts.append(spark.read.option("basePath", sink).parquet(*later).select(*columns))
    if not parts:
        raise ValueError(f"no finished batch in {sink}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    newest = rows.groupBy(*[named(k) for k in keys]).agg(
        *[F.max_by(v, "batch_id").alias(v) for v in values], F.max("batch_id").alias("batch_id")
    )
    return newest, max([upto, *batches])


def current_state(spark: SparkSession, sink: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The newest value per key over all batches written so far."""
    return _newest(spark, sink, keys, values)[0].drop("batch_id")


def compact(spark: SparkSession, sink: str, keys: Sequence[str], values: Sequence[str]) -> int:
    """Write the newest value per key as a snapshot and remove the batches and snapshots it replaces.

    Returns the last batch in it. A snapshot counts once it is complete, and
    batches after it are read beside it, so a failure at any point loses nothing.
    """
    rows, upto = _newest(spark, sink, keys, values)
    rows.write.mode("overwrite").parquet(f"{sink}-snapshots/upto={upto}")
    old = [p for n, p in _folders(spark, sink, "batch_id").items() if n <= upto]
    old += [p for n, p in _folders(spark, f"{sink}-snapshots", "upto").items() if n < upto]
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, old):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return upto


def retained(series: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """Points of the last ``hours`` hours before the newest one."""
    newest = series.agg(F.max(ts).alias("t")).scalar()
    recent: Column = named(ts) > F.timestamp_add("HOUR", F.lit(-hours), F.col("_newest"))
    return series.withColumn("_newest", newest).filter(recent).drop("_newest")
