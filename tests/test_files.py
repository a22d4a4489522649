import json

import pytest
from pyspark.sql import functions as F

from tidewatch.session import shared_folder, work_path
from tidewatch.sources import readers, writers
from tidewatch.streaming import live


def test_work_paths_lie_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert work_path(spark, "x").startswith(folder) and work_path(spark, "x") != work_path(spark, "x")


def test_csv_types_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,score\n1,"Smith, ""Al""",2.5\n2,,\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 'Smith, "Al"', 2.5), (2, None, None)]
    (tmp_path / "empty.csv").write_text("id,name\n")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "latin.csv").write_bytes("name\nJosé\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1").first().name == "José"


def test_whole_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2, "x": None}], indent=2))
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2


def test_dispatch_and_guard(spark):
    with pytest.raises(ValueError):
        readers.read_by_extension(spark, "data.xml")
    assert readers.check_file_type("a/b.CSV") == "csv"
    with pytest.raises(ValueError, match="csv, json"):
        readers.check_file_type("a.parquet")
    with pytest.raises(FileNotFoundError):
        readers.read_processed_or_raw(spark, "/nowhere/a.json", "/nowhere/b.csv")


def test_log_skips_malformed_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00", "level": "INFO", "logger": "a", "message": "x"}
    (tmp_path / "app.log").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"level": "ERROR"}) + "\n")
    rows = readers.read_json_log(spark, str(tmp_path / "app.log")).collect()
    assert [r.level for r in rows] == ["INFO", "ERROR"]


def test_contracts_survive_a_broken_file(spark, tmp_path):
    contract = {"name": "c", "dataset_name": "d", "schema_definition": {"columns": [{"name": "id", "data_type": "integer"}]}}
    (tmp_path / "good.json").write_text(json.dumps(contract, indent=1))
    (tmp_path / "bad.json").write_text('{"name": ')
    files = {r.file_path.rsplit("/", 1)[-1]: r.is_readable for r in readers.read_contract_files(spark, str(tmp_path)).collect()}
    assert files == {"good.json": True, "bad.json": False}
    (row,) = readers.load_contracts(spark, str(tmp_path)).collect()
    assert (row.column_name, row.required, row.nullable, row.version, row.is_active) == ("id", True, True, "1.0.0", True)


def test_rule_documents(spark, tmp_path):
    rules = [
        {"rule_id": " a ", "name": "A", "rule_type": "range", "severity": "WARNING"},
        {"rule_id": "", "name": "B", "rule_type": "range"},
        {"rule_id": "c", "name": "C", "rule_type": "range", "severity": "fatal"},
        {"rule_id": "d", "name": "D", "rule_type": "magic"},
    ]
    (tmp_path / "rules.json").write_text(json.dumps({"version": "1.0", "rules": rules}, indent=1))
    rows = readers.load_rules(spark, str(tmp_path / "rules.json")).collect()
    assert [(r.rule_id, r.severity, r.enabled, r.problem) for r in rows] == [
        ("a", "warning", True, None), ("", "error", True, "rule_id cannot be empty"),
        ("c", "fatal", True, "unknown severity"), ("d", "error", True, "unknown rule type"),
    ]


def test_export(spark):
    df = spark.createDataFrame([(1, 'say "hi"', None, ["a"])], "order_id int, note string, gap string, tags array<string>")
    path = work_path(spark, "export")
    writers.export_csv(df, path)
    lines = sorted({r.value for r in spark.read.text(path).collect()})
    assert lines == ['"1","say ""hi""","","[""a""]"', '"Order id","Note","Gap","Tags"']


def test_partitioned_write_splits_and_appends(spark):
    path = work_path(spark, "parts")
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    writers.write_partitioned(df, path, keys=["k"])
    writers.write_partitioned(df, path, keys=["k"])
    assert spark.read.parquet(path).groupBy("k").count().orderBy("k").collect()[1]["count"] == 668
    with pytest.raises(ValueError):
        writers.write_partitioned(df, path, "orc")
    assert writers.dated_path("processed/", 2024, 3, 9) == "processed/2024/03/09"


def test_object_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("id\n")
    (tmp_path / "b.json").write_text("{}")
    assert {r.name: r.size for r in readers.list_objects(spark, str(tmp_path)).collect()} == {"a.csv": 3, "b.json": 2}
    assert [r.name for r in readers.list_objects(spark, str(tmp_path), "*.csv").collect()] == ["a.csv"]


def test_stream_adds_up_over_batches(spark):
    folder, sink, offsets = (work_path(spark, x) for x in ("in", "out", "offsets"))
    schema = "k string, ts timestamp_ntz, v double"
    first = spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-01 00:10:00' AS ts, 1D AS v UNION ALL SELECT 'b', timestamp_ntz'2024-01-01 00:20:00', 2D")
    late = spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-03 05:00:00' AS ts, 5D AS v")

    def run():
        events = live.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
        live.stream_counters(events, ["k"], "v", sink, offsets).awaitTermination()

    first.write.mode("append").parquet(folder)
    run()
    late.write.mode("append").parquet(folder)
    run()
    run()
    state = live.current_state(spark, sink, ["k"], ["count", "total"]).collect()
    assert {r.k: (r["count"], r.total) for r in state} == {"a": (2, 6.0), "b": (1, 2.0)}


def test_stream_drops_points_beyond_the_retention(spark):
    folder, sink, offsets = (work_path(spark, x) for x in ("in", "out", "offsets"))
    schema = "k string, ts timestamp_ntz, v double"

    def run(ts):
        spark.sql(f"SELECT 'a' AS k, timestamp_ntz'{ts}' AS ts, 1D AS v").write.mode("append").parquet(folder)
        points = live.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
        live.stream_timeseries(points, "ts", ["k"], "v", sink, offsets).awaitTermination()

    for moment in ("2024-01-01 00:10:00", "2024-01-05 00:00:00", "2024-01-05 00:30:00", "2024-01-01 00:20:00"):
        run(moment)
    series = live.current_state(spark, sink, ["hour", "k"], ["count"])
    assert {str(r.hour): r["count"] for r in series.collect()} == {"2024-01-01 00:00:00": 1, "2024-01-05 00:00:00": 2}
    assert [str(r.hour) for r in live.retained(series, "hour").collect()] == ["2024-01-05 00:00:00"]


def test_failed_profiles_leave_a_row(spark):
    path = work_path(spark, "profiles")
    done = F.lit("2024-01-01").cast("timestamp_ntz")
    writers.append(writers.failed_profile_row(spark, "d", "no such file", "ann", done), path)
    (row,) = readers.read_table(spark, path).collect()
    assert (row.status, row.error_message, row.profiled_by) == ("failed", "no such file", "ann")


def test_unreachable_shared_folder_is_refused(spark, monkeypatch):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Cluster)


def _tide_rows(spark):
    return spark.createDataFrame([(i, None if i % 10 == 3 else f"pier {i % 4}", float(i)) for i in range(200)], "id int, pier string, level double").repartition(3)


def test_written_and_measured_in_one_job(spark, tmp_path):
    path = str(tmp_path / "a" / "tides")
    tracker, group = spark.sparkContext.statusTracker(), "observed-write"
    spark.sparkContext.setJobGroup(group, group)
    report = writers.write_observed(_tide_rows(spark), path, checks={"high": F.col("level") >= 20, "pier": F.col("pier") != "pier 1"})
    # The rows are computed once: one job, or one more for the map stage that AQE runs on its own.
    assert 1 <= len(tracker.getJobIdsForGroup(group)) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert report.record_count == 200 and report.nulls == {"id": 0, "pier": 20, "level": 0}
    expected = sum(i % 10 == 3 or i % 4 == 1 for i in range(200))
    assert report.failed == {"high": 20, "pier": expected}
    assert spark.read.parquet(path).count() == 200
    assert {(r["kind"], r["name"]): r["failed_records"] for r in report.rows(spark).collect()}[("nulls", "pier")] == 20


def test_table_that_fails_its_check_is_not_kept(spark, tmp_path):
    path = str(tmp_path / "tides")
    with pytest.raises(writers.CheckFailed, match="high 20 of 200") as caught:
        writers.write_observed(_tide_rows(spark), path, checks={"high": F.col("level") >= 20}, allowed={"high": 0.05})
    assert caught.value.report.record_count == 200 and list(tmp_path.iterdir()) == []
    bad = _tide_rows(spark).withColumn("level", F.when(F.col("id") == 77, F.raise_error(F.lit("disk"))).otherwise(F.col("level")))
    with pytest.raises(Exception, match="disk"):
        writers.write_observed(bad, path)
    assert list(tmp_path.iterdir()) == []
    writers.write_observed(_tide_rows(spark), path, checks={"high": F.col("level") >= 20}, allowed={"high": 0.1})
    with pytest.raises(ValueError, match="exists"):
        writers.write_observed(_tide_rows(spark), path)
    with pytest.raises(ValueError, match="no such check"):
        writers.write_observed(_tide_rows(spark), path + "2", allowed={"low": 0.1})


def test_ingest_reports_what_it_wrote(spark, tmp_path):
    report, preview = writers.ingest(_tide_rows(spark), str(tmp_path / "json"), "json", keys=["pier"])
    assert report.record_count == 200 and {r["record_count"] for r in preview.collect()} == {200} and preview.count() == 5
    empty, none = writers.ingest(_tide_rows(spark).limit(0), str(tmp_path / "empty"))
    assert empty.record_count == 0 and none.collect() == []
