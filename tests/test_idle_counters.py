"""Counters whose state goes when a key is idle: over several batches, restarts and keys that come back."""

import datetime

from tidewatch.session import work_path
from tidewatch.streaming import live

SCHEMA = "k string, v double, ts timestamp_ntz"


def put(spark, folder, name, rows):
    spark.createDataFrame([(k, v, t and datetime.datetime(2024, 1, *t)) for k, v, t in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_state_goes_and_totals_stay(spark):
    source, sink, checkpoint = (work_path(spark, n) for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [("a", 1.0, (1, 0)), ("b", 2.0, (1, 1)), (None, 5.0, (1, 1)), ("a", None, (1, 2))],
        [("a", 4.0, (1, 20)), ("a", 1.5, (1, 3)), ("c", 1.0, (1, 21))],  # one row out of order, but in time
        [("c", 8.0, (5, 0))],  # a, b and the NULL key are idle now
        [("b", 16.0, (5, 1)), ("c", 1.0, (5, 1)), ("x", 1.0, None)],  # b comes back
        [("c", 1.0, (9, 0))],
        [("c", 1.0, (9, 1))],
    ]
    total, kept = {}, []
    for step, rows in enumerate(batches):
        put(spark, source, f"part{step}", rows)
        for k, v, t in rows:
            if t:
                n, s = total.get(k, (0, 0.0))
                total[k] = (n + 1, s + (v or 0.0))
        # Every step is a new start from the checkpoint.
        query = live.expiring_counters(live.file_stream(spark, f"{source}/*", schema, files_per_batch=1), ["k"], "v", "ts", sink, checkpoint, idle="1 day", late="1 hour")
        query.awaitTermination()
        assert query.exception() is None
        if query.lastProgress:
            kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = {r["k"]: (r["count"], r["total"]) for r in live.session_totals(spark, sink, ["k"]).collect()}
        assert got == total, step
    rows = live.current_state(spark, sink, ["k", "began"], ["count", "closed"]).collect()
    states = sorted((r["k"] or "", r["count"], r["closed"]) for r in rows)
    assert ("b", 1, True) in states and len([s for s in states if s[0] == "b"]) == 2 and ("a", 4, True) in states
    assert all(closed for k, _, closed in states if k != "c")
    assert kept[-1] < max(kept)
    # The sink can be compacted like that of the other counters.
    live.compact(spark, sink, ["k", "began"], ["count", "total"])
    assert {r["k"]: (r["count"], r["total"]) for r in live.session_totals(spark, sink, ["k"]).collect()} == total
