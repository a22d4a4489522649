"""An index of three-letter pieces for searches in text columns of Parquet tables.

The index says in which files a piece occurs. A search reads the entries of its own
pieces, takes the files that have all of them, and looks at the text itself in those files only,
so its rows are always those of a full scan. Files that came or changed after the
index was written have no valid entry and are simply read, until ``update`` adds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.scalars import named
from tidewatch.operators.filters import text_search

#: Letters in a piece.
PIECE = 3
#: (file, piece) pairs that a task holds before it hands them over.
HELD = 200_000


def pieces_of(text: str) -> set[str]:
    """All runs of ``PIECE`` characters."""
    return {text[i : i + PIECE] for i in range(len(text) - PIECE + 1)}


def _all_text(columns: Sequence[str], tags: str | None) -> Column:
    """The searched columns of a row, lowered as the search lowers them; what crosses their borders only adds pieces."""
    parts = [F.coalesce(F.lower(named(c)), F.lit("")) for c in columns]
    if tags:
        parts.append(F.lower(F.coalesce(F.array_join(named(tags), "\n"), F.lit(""))))
    return F.concat_ws("\n", *parts)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, stamp): the Parquet files below ``path``; the stamp changes when a file does."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(_tail(F.col("path")).alias("file"), _stamp(F.col("length"), F.col("modificationTime")).alias("stamp"))


def _tail(path: Column) -> Column:
    """A path without its scheme, which listings and readers write in different ways, in plain characters."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), F.lit("+"), F.lit("%2B")))


def _stamp(size: Column, modified: Column) -> Column:
    return F.concat_ws("-", size.cast("string"), F.unix_millis(modified).cast("string"))


def _entries(rows: DataFrame) -> DataFrame:
    """(piece, file, stamp), each once, of rows (file, stamp, text)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], set[str]] = {}
        size = 0
        for batch in batches:
            for file, stamp, text in zip(*(batch[c].to_pylist() for c in ("file", "stamp", "text"))):
                seen = held.setdefault((file, stamp), set())
                size -= len(seen)
                seen |= pieces_of(text)
                size += len(seen)
                if size > HELD:
                    yield from handed(held)
                    held, size = {}, 0
        yield from handed(held)

    def handed(held: dict[tuple[str, str], set[str]]) -> Iterator[pa.RecordBatch]:
        for (file, stamp), pieces in held.items():
            n = len(pieces)
            columns = [pa.array(list(pieces), pa.string()), pa.array([file] * n, pa.string()), pa.array([stamp] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "file", "stamp"])

    return rows.mapInArrow(cut, "piece string, file string, stamp string").distinct()


class TextIndex:
    """The index of some text columns of the Parquet table at ``path``, kept at ``index``."""

    def __init__(self, spark: SparkSession, path: str, index: str, columns: Sequence[str], tags: str | None = None):
        self.spark, self.path, self.index, self.columns, self.tags = spark, path.rstrip("/"), index.rstrip("/"), list(columns), tags

    def _stored(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.index}/pieces")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema("piece string, file string, stamp string").parquet(folder.toString())

    def _missing(self) -> DataFrame:
        """Files without a valid entry. The empty piece marks a file as indexed, also one without text."""
        stored, files = self._stored(), files_of(self.spark, self.path)
        if stored is None:
            return files
        return files.join(stored.filter("piece = ''").select("file", "stamp"), ["file", "stamp"], "left_anti")

    def update(self) -> int:
        """Index the files that are new or have changed; returns their number.

        Only they are read. Entries are sorted by piece, so that a search reads a few row groups.
        """
        missing = [(r["file"], r["stamp"]) for r in self._missing().collect()]
        if not missing:
            return 0
        stamps = self.spark.createDataFrame(missing, "file string, stamp string")
        rows = self._read([f for f, _ in missing])
        texts = rows.select(_tail(F.col("_metadata.file_path")).alias("file"), _all_text(self.columns, self.tags).alias("text"))
        found = _entries(texts.join(F.broadcast(stamps), "file").select("file", "stamp", "text"))
        marks = stamps.select(F.lit("").alias("piece"), "file", "stamp")
        every = found.unionByName(marks)
        every.repartitionByRange("piece").sortWithinPartitions("piece", "file").write.mode("append").parquet(f"{self.index}/pieces")
        return len(missing)

    def _read(self, files: list[str]) -> DataFrame:
        """Files by their plain paths, in the file system of the table."""
        scheme = self.path.split("://", 1)
        if len(scheme) == 1:
            return self.spark.read.parquet(*files)
        # A plain path begins with the authority of the table's address, if that has one.
        return self.spark.read.parquet(*[f"{scheme[0]}://{f if f'{scheme[0]}:///' in self.path else f[1:]}" for f in files])

    def candidates(self, text: str) -> list[str]:
        """Files in which all pieces of ``text`` occur, and those that have no valid entry."""
        wanted = sorted(pieces_of(text.lower()))
        files, stored = files_of(self.spark, self.path), self._stored()
        if stored is None or not wanted:
            return sorted(r["file"] for r in files.collect())
        hits = stored.filter(F.col("piece").isin(wanted)).groupBy("file", "stamp").agg(F.count_distinct("piece").alias("n"))
        full = hits.filter(F.col("n") == len(wanted)).select("file", "stamp")
        current = files.join(full, ["file", "stamp"], "left_semi").select("file").unionByName(self._missing().select("file"))
        return sorted({r["file"] for r in current.collect()})

    def search(self, text: str) -> DataFrame:
        """The rows with ``text`` in any of the columns or tags, ignoring case, as ``text_search`` finds them in the whole table."""
        files = self.candidates(text)
        rows = self._read(files) if files else self.spark.read.parquet(self.path).limit(0)
        return text_search(rows, text, self.columns, self.tags)
