"""Streams over several micro-batches: counters, their periods, and compaction of the sink."""

import datetime

from tidewatch.session import work_path
from tidewatch.streaming import live

SCHEMA = "k string, v double, ts timestamp_ntz"


def put(spark, folder, name, rows):
    spark.createDataFrame([(k, v, datetime.datetime(2024, 1, d)) for k, v, d in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(stream):
    stream.awaitTermination()
    assert stream.exception() is None


def test_counters_over_batches_and_compaction(spark):
    source, sink, checkpoint = (work_path(spark, n) for n in ("in", "out", "state"))
    total = {}
    for step in range(5):
        rows = [(f"k{i % (step + 2)}", float(i), 1 + step) for i in range(20 + step)]
        put(spark, source, f"part{step}", rows)
        for k, v, _ in rows:
            total[k] = (total.get(k, (0, 0))[0] + 1, total.get(k, (0, 0))[1] + v)
        events = live.file_stream(spark, f"{source}/*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        run(live.stream_counters(events, ["k"], "v", sink, checkpoint))
        if step in (1, 3):
            before = live._folders(spark, sink, "batch_id")
            upto = live.compact(spark, sink, ["k"], ["count", "total"])
            assert upto == max(before) and not live._folders(spark, sink, "batch_id")
        got = {r["k"]: (r["count"], r["total"]) for r in live.current_state(spark, sink, ["k"], ["count", "total"]).collect()}
        assert got == total
    assert list(live._folders(spark, f"{sink}-snapshots", "upto")) == [upto]


def test_counters_by_period_drop_old_state(spark):
    source, sink, checkpoint = (work_path(spark, n) for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for step, rows in enumerate([[("a", 1.0, 1), ("b", 2.0, 1)], [("a", 4.0, 5)], [("a", 8.0, 9), ("b", 1.0, 9)]]):
        put(spark, source, f"part{step}", rows)
        events = live.file_stream(spark, f"{source}/*", schema, files_per_batch=1)
        query = live.stream_counters(events, ["k"], "v", sink, checkpoint, ts="ts", period="1 day", late="1 day")
        run(query)
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0
    assert kept <= 2
    rows = live.current_state(spark, sink, ["period", "k"], ["count", "total"]).collect()
    assert sorted((r["period"].day, r["k"], r["count"], r["total"]) for r in rows) == [
        (1, "a", 1, 1.0), (1, "b", 1, 2.0), (5, "a", 1, 4.0), (9, "a", 1, 8.0), (9, "b", 1, 1.0)
    ]
