"""Growing files: every line comes once, whatever the ranges, and unfinished lines wait."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import growing as G
from tidewatch.session import work_path


def lines_of(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["line"]) for r in df.collect())


def expected(contents, before=None):
    """Complete lines behind the offsets by plain Python."""
    out = []
    for name, raw in contents.items():
        at = 0
        for line in raw.split(b"\n")[:-1]:
            if at >= (before or {}).get(name, 0):
                out.append((name, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("width", [1, 7, 64 << 20])
def test_growing_folder(spark, tmp_path, width):
    draw = random.Random(width)
    contents, offsets = {"a.log": b"", "b.log": b""}, {}
    for step in range(4):
        before = {k.rsplit("/", 1)[1]: v for k, v in offsets.items()}
        for name in list(contents):
            contents[name] += "".join(draw.choice(["tide é\n", "\n", "漢字 line\r\n", "unfini", "x" * 9 + "\n"]) for _ in range(step * 3)).encode()
        if step == 2:
            contents["c.log"] = b"new file\nwith an open end"
        for name, raw in contents.items():
            (tmp_path / name).write_bytes(raw)
        (tmp_path / "_hidden").write_text("no\n")
        found, offsets = G.read_new_lines(spark, str(tmp_path), offsets, width)
        assert lines_of(found) == expected(contents, before)
        # The same rows again, although the files have grown by then.
        (tmp_path / "a.log").write_bytes(contents["a.log"] + b"later\n")
        assert lines_of(found) == expected(contents, before)
        (tmp_path / "a.log").write_bytes(contents["a.log"])
    again, same = G.read_new_lines(spark, str(tmp_path), offsets, width)
    assert again.collect() == [] and same == offsets


def test_replaced_and_missing_files(spark, tmp_path):
    file = tmp_path / "a.log"
    file.write_text("one\ntwo\nthree\n")
    _, offsets = G.read_new_lines(spark, str(tmp_path))
    file.write_text("new\n")
    found, offsets = G.read_new_lines(spark, f"file://{tmp_path}", offsets)
    assert lines_of(found) == [("a.log", 0, "new")]
    file.unlink()
    found, offsets = G.read_new_lines(spark, str(tmp_path), offsets)
    assert found.collect() == [] and offsets == {}
    assert G.read_new_lines(spark, str(tmp_path / "absent"))[0].collect() == []


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", work_path(spark, "lines"), work_path(spark, "offsets")
    folder.mkdir()
    file, every = folder / "app.log", []
    for step in range(3):
        rows = [f"batch {step} line {i}" for i in range(20)]
        every += rows
        with file.open("a") as out:
            out.write("\n".join(rows) + "\n")
        query = G.stream_lines(spark, str(folder), 100).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        assert sorted(r["line"] for r in spark.read.parquet(sink).collect()) == sorted(every)


def test_json_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-02T03:04:05", "level": "INFO", "logger": "tide", "message": "up"}
    (tmp_path / "a.log").write_text(json.dumps(good) + "\n{broken\n\n" + json.dumps(good | {"level": None}) + "\n")
    found = G.json_lines(G.read_new_lines(spark, str(tmp_path))[0])
    assert sorted((r["level"] or "", r["message"]) for r in found.collect()) == [("", "up"), ("INFO", "up")]
    assert found.filter(F.col("timestamp") == F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).count() == 2
