"""Indexed searches give the rows of a full scan and read fewer files."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.filters import text_search
from tidewatch.sources.textindex import TextIndex, pieces_of


def rows_of(n):
    """Twelve files; a few words occur in one or two of them."""
    words = ["tide", "Harbour", "MOORING", "été", "ÀÉÎ", "lock gate", "100%"]
    return [(i, f"{words[i % 7]} log {i}", None if i % 5 == 0 else f"note {i}", ["Quay", f"berth {i}"] if i % 3 else None) for i in range(n)]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "a table+1")
    for at in range(12):
        rows = [(i, t + (" Rare Vessel" if i == 17 else ""), n, g) for i, t, n, g in rows_of(96) if i % 12 == at]
        spark.createDataFrame(rows, "id int, text string, note string, tags array<string>").coalesce(1).write.mode("append").parquet(path)
    return path


def scan(spark, path, text):
    return sorted(r["id"] for r in text_search(spark.read.parquet(path), text, ["text", "note"], "tags").collect())


def test_same_rows_and_fewer_files(spark, table, tmp_path):
    index = TextIndex(spark, table, str(tmp_path / "index"), ["text", "note"], "tags")
    assert len(index.candidates("rare vessel")) == 12  # nothing is indexed yet
    assert index.update() == 12 and index.update() == 0
    for text in ("rare vessel", "VESSEL", "harbour log 1", "lock gate", "àéî", "été", "berth 17", "QUAY", "note 9", "100%", "absent words", "ta", "", "log 17 rare"):
        assert sorted(r["id"] for r in index.search(text).collect()) == scan(spark, table, text), text
    assert len(index.candidates("rare vessel")) == 1 and index.candidates("absent words") == []
    assert len(index.search("Rare Vessel").inputFiles()) == 1
    assert len(index.candidates("note")) == 12


def test_files_that_come_change_and_go(spark, table, tmp_path):
    index = TextIndex(spark, table, str(tmp_path / "index"), ["text", "note"], "tags")
    index.update()
    spark.createDataFrame([(500, "a Rare Vessel again", None, None)], "id int, text string, note string, tags array<string>").coalesce(1).write.mode("append").parquet(table)
    assert len(index.candidates("rare vessel")) == 2
    assert sorted(r["id"] for r in index.search("rare vessel").collect()) == [17, 500]
    assert index.update() == 1 and len(index.candidates("rare vessel")) == 2
    # A file is replaced by another under its name, and one goes.
    old = index.candidates("log 17 ")[0]
    other = str(tmp_path / "other")
    spark.createDataFrame([(17, "something else", None, None)], "id int, text string, note string, tags array<string>").coalesce(1).write.parquet(other)
    new = next(f for f in os.listdir(other) if f.endswith(".parquet"))
    folder, name = os.path.split(old)
    if os.path.exists(f"{folder}/.{name}.crc"):
        os.remove(f"{folder}/.{name}.crc")
    os.replace(f"{other}/{new}", old)
    assert sorted(r["id"] for r in index.search("rare vessel").collect()) == [500]
    assert sorted(r["id"] for r in index.search("something else").collect()) == [17]
    os.remove(index.candidates("again")[0])
    assert index.search("rare vessel").collect() == [] and index.update() == 1


def test_tables_without_text(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None), (2, "")], "id int, text string").write.parquet(path)
    index = TextIndex(spark, path, str(tmp_path / "index"), ["text"])
    assert index.update() > 0 and index.update() == 0
    assert index.search("abc").collect() == [] and index.search("abc").columns == ["id", "text"]
    assert pieces_of("ab") == set() and pieces_of("abcd") == {"abc", "bcd"}
