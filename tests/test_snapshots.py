"""Tables that change in one step, checked by file names and by failures in the middle."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import loads
from tidewatch.sources import snapshots as S

ROWS = [(f"b{i % 5}" if i % 11 else None, i, f"rec {i}") for i in range(100)]


@pytest.fixture
def store(spark, tmp_path):
    return S.Snapshots(spark, str(tmp_path / "store"))


def processed(spark, rows=ROWS):
    return spark.createDataFrame(rows, "batch_id string, id int, data string")


def listing(store, table):
    """Data files per partition of the last version."""
    parts = store.manifest()[table]["parts"]
    return {p: sorted(f for f in os.listdir(f"{store.root}/{folder}") if f.endswith(".parquet")) + [folder] for p, folder in parts.items()}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_write_and_read(spark, store):
    assert store.version() == 0 and store.manifest() == {}
    assert store.write("processed", processed(spark), F.col("batch_id")) == 1
    assert store.partitions("processed") == ["", "b0", "b1", "b2", "b3", "b4"]
    assert sorted(map(tuple, store.read("processed").collect()), key=str) == sorted(ROWS, key=str)
    assert ids(store.read("processed", partitions=["b1", "b9"])) == sorted(i for b, i, _ in ROWS if b == "b1")
    with pytest.raises(ValueError):
        store.read("absent")


def test_rollback_touches_one_partition(spark, store):
    store.write("processed", processed(spark), F.col("batch_id"))
    before, old = listing(store, "processed"), store.read("processed")
    S.roll_back(store, ["b2"], ["processed"])
    after = listing(store, "processed")
    assert "b2" not in after and after == {p: f for p, f in before.items() if p != "b2"}
    assert ids(store.read("processed")) == sorted(i for b, i, _ in ROWS if b != "b2")
    # The old state can still be read, and a repeated rollback changes nothing.
    assert ids(old) == ids(store.read("processed", version=1)) == list(range(100))
    S.roll_back(store, ["b2"], ["processed"])
    assert listing(store, "processed") == after


def test_rollback_of_several_tables_and_history(spark, store):
    history = spark.createDataFrame([(f"b{i}", "completed", None, None) for i in range(5)], "batch_id string, status string, error_message string, completed_at timestamp_ntz")
    S.load_batches(store, {"processed": processed(spark).filter("batch_id IS NOT NULL"), "history": history})
    before = listing(store, "history")
    S.roll_back(store, ["b1", "nowhere"], ["processed"], "history", F.lit("2024-01-01").cast("timestamp_ntz"))
    states = {r["batch_id"]: r["status"] for r in store.read("history").collect()}
    assert states == {"b0": "completed", "b1": "rolled_back", "b2": "completed", "b3": "completed", "b4": "completed"}
    assert {p for p, f in listing(store, "history").items() if f != before[p]} == {"b1"}
    assert "b1" not in store.partitions("processed")


def test_failed_write_leaves_the_old_state(spark, store):
    store.write("processed", processed(spark), F.col("batch_id"))
    bad = processed(spark).withColumn("data", F.when(F.col("id") == 57, F.raise_error(F.lit("disk"))).otherwise("new"))
    with pytest.raises(Exception, match="disk"):
        store.commit({"other": S.Replace(processed(spark), F.col("batch_id")), "processed": S.Replace(bad, F.col("batch_id"))})
    assert store.version() == 1 and set(store.manifest()) == {"processed"}
    assert sorted(map(tuple, store.read("processed").collect()), key=str) == sorted(ROWS, key=str)
    # What the failed commit left behind goes with the next vacuum, and nothing else.
    store.vacuum()
    assert ids(store.read("processed")) == list(range(100))


def test_two_writers_at_one_time(spark, store):
    store.write("processed", processed(spark), F.col("batch_id"))
    S.load_batches(store, {"processed": processed(spark, [("b7", 700, "x")])}, base=1)
    with pytest.raises(S.CommitConflict):
        S.load_batches(store, {"processed": processed(spark, [("b8", 800, "x")])}, base=1)
    assert store.version() == 2 and "b8" not in store.partitions("processed")
    S.load_batches(store, {"processed": processed(spark, [("b8", 800, "x")])})
    S.load_batches(store, {"processed": processed(spark, [("b8", 801, "x")])})  # the load repeated
    assert ids(store.read("processed", partitions=["b8"])) == [801]


def test_readers_never_see_a_mixture(spark, store):
    def state(n):
        return {"a": S.Replace(processed(spark, [("b", n, "a")] * 3), F.col("batch_id")), "c": S.Replace(processed(spark, [("b", n, "c")] * 2), F.col("batch_id"))}

    store.commit(state(0))
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            version = store.version()
            seen.append({r["id"] for t in ("a", "c") for r in store.read(t, version).collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 5):
        store.commit(state(n))
    done.set()
    reader.join()
    assert seen and all(len(x) == 1 for x in seen)


def test_patch_rewrites_buckets_with_updates_only(spark, store):
    history = spark.createDataFrame([(f"batch_{i}", "running", i) for i in range(300)], "batch_id string, status string, records_loaded int")
    partition = S.bucket("batch_id", 16)
    store.write("history", history, partition)
    before = listing(store, "history")
    updates = spark.createDataFrame(
        [("batch_7", "2024-01-01 00:00:00", "failed", None), ("batch_7", "2024-01-02 00:00:00", None, 70), ("unknown", "2024-01-01 00:00:00", "failed", 1)],
        "batch_id string, updated_at string, status string, records_loaded int",
    )
    S.patch(store, "history", updates, loads.upsert_history, partition)
    after = listing(store, "history")
    changed = {p for p in before if before[p] != after[p]}
    assert 1 <= len(changed) <= 2 and set(after) == set(before)
    rows = {r["batch_id"]: tuple(r)[1:] for r in store.read("history").collect()}
    assert len(rows) == 300 and rows["batch_7"] == ("failed", 70) and rows["batch_8"] == ("running", 8)


def test_expire_drops_days_unread(spark, store):
    days = spark.createDataFrame([(i, f"2024-01-{1 + i % 20:02d} {i % 24:02d}:00:00" if i % 13 else None) for i in range(200)], "id int, ts string")
    days = days.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    day = F.col("ts").cast("date").cast("string")
    store.write("logs", days, day)
    before = listing(store, "logs")
    cutoff = F.lit("2024-01-08 12:00:00").cast("timestamp_ntz")
    S.expire(store, "logs", "ts", cutoff, day)
    after = listing(store, "logs")
    assert set(after) == {"", *(f"2024-01-{d:02d}" for d in range(8, 21))}
    assert {p for p in after if after[p] != before[p]} == {"2024-01-08"}
    assert ids(store.read("logs")) == ids(days.filter(F.col("ts").isNull() | (F.col("ts") >= cutoff)))
    S.expire(store, "logs", "ts", cutoff, day)
    assert ids(store.read("logs")) == ids(days.filter(F.col("ts").isNull() | (F.col("ts") >= cutoff)))


def test_vacuum_keeps_the_last_versions(spark, store):
    for n in range(4):
        store.write("t", processed(spark, [("b", n, "x")]), F.col("batch_id"))
    assert len(store.vacuum(keep=2)) == 2
    assert [ids(store.read("t", version=v)) for v in (3, 4)] == [[2], [3]]
    assert store.vacuum(keep=2) == [] and store.version() == 4


def test_rewrite_refuses_rows_that_leave(spark, store):
    store.write("t", processed(spark), F.col("batch_id"))
    with pytest.raises(ValueError, match="left"):
        store.commit({"t": S.Rewrite(["b1"], lambda rows: rows.withColumn("batch_id", F.lit("b4")), F.col("batch_id"))})
    assert store.version() == 1


def test_odd_names_and_empty_tables(spark, store):
    rows = [("a/b=c d", 1, "x"), ("é漢", 2, "y"), ("", 3, "z"), (None, 4, "n")]
    store.write("t", processed(spark, rows), F.col("batch_id"))
    assert ids(store.read("t", partitions=["a/b=c d", "é漢"])) == [1, 2] and ids(store.read("t", partitions=[""])) == [3, 4]
    store.commit({"t": S.Drop(["a/b=c d", "é漢", ""])})
    assert store.read("t").collect() == [] and store.read("t").columns == ["batch_id", "id", "data"]
    store.write("none", processed(spark, []), F.col("batch_id"))
    assert store.read("none").collect() == []


def test_grouped_rollback_shuffles_rows_of_its_batches_only(spark, store, monkeypatch):
    rows = processed(spark, [(f"b{i % 500}" if i % 11 else None, i, f"rec {i}") for i in range(5000)])
    history = spark.createDataFrame([(f"b{i}", "completed", None, None) for i in range(500)], "batch_id string, status string, error_message string, completed_at timestamp_ntz")
    partition = S.bucket("batch_id", 4)
    store.commit({"processed": S.Replace(rows, partition), "history": S.Replace(history, partition)})
    through = []
    monkeypatch.setattr(S.Snapshots, "_folders", lambda self, df, *more, old=S.Snapshots._folders: through.append(df.count()) or old(self, df, *more))
    gone = {f"b{i}" for i in range(0, 500, 25)}
    S.roll_back_grouped(store, spark.createDataFrame([(b,) for b in [*gone, None]], "batch_id string"), ["processed"], "history", partition)
    assert ids(store.read("processed")) == [i for i in range(5000) if not i % 11 or f"b{i % 500}" not in gone]
    assert {r["batch_id"] for r in store.read("history").filter("status = 'rolled_back'").collect()} == gone and store.read("history").count() == 500
    # What the two steps give; all other rows are copied by the tasks that read them.
    assert through[0] < 100 and through[1] < 40
