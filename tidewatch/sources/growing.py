"""Log files that grow: each read takes the lines that were added since the last one.

A Spark data source whose partitions are ranges of bytes, for reads and for streams. How
far a file has been read is its offset, the byte behind the last complete line; a line
that is still being written waits for the next read. Files are opened by address
(``file``, ``hdfs``, ``s3``, ``gs``) on the executors, which must all reach them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewatch.sources.readers import LOG_SCHEMA

NAME = "growing_lines"
SCHEMA = "file string, at bigint, line string"
#: Bytes of a range, and bytes that are read at a time.
RANGE, STEP = 64 << 20, 1 << 20
#: Lines in a batch that is handed to Spark.
_LINES = 8192


class Range(InputPartition):
    """Lines of a file that begin in [start, end); ``first`` is where reading of the file began, always the beginning of a line."""

    def __init__(self, file: str, start: int, end: int, first: int, last: int):
        self.file, self.start, self.end, self.first, self.last = file, start, end, first, last


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the files at or below a path, hidden ones left out."""
    system, inner = _opened(path)
    root = system.get_file_info(inner)
    if root.type == pafs.FileType.NotFound:
        return {}
    infos = [root] if root.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return {i.path: i.size for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))}


def _complete(system: pafs.FileSystem, file: str, low: int, size: int) -> int:
    """The byte behind the last line end between ``low`` and ``size``; ``low`` without one."""
    with system.open_input_file(file) as stream:
        high = size
        while high > low:
            start = max(low, high - STEP)
            at = stream.read_at(high - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


def latest_offsets(path: str, before: dict[str, int]) -> dict[str, int]:
    """How far each file can be read now. A file that is shorter than it was has been replaced; a file that is gone is forgotten."""
    system, _ = _opened(path)
    return {
        file: before[file] if size == before.get(file) else _complete(system, file, before[file] if 0 <= before.get(file, -1) <= size else 0, size)
        for file, size in _files(path).items()
    }


def ranges_between(before: dict[str, int], after: dict[str, int], width: int = RANGE) -> list[Range]:
    """Ranges of about ``width`` bytes of what was added."""
    found = []
    for file, end in sorted(after.items()):
        first = before.get(file, 0) if before.get(file, 0) <= end else 0
        found += [Range(file, start, min(start + width, end), first, end) for start in range(first, end, width)]
    return found


def _read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _opened(path)
    with system.open_input_file(part.file) as stream:
        at, rest, lines, places = part.start, b"", [], []
        # A line that began before the range belongs to the range before; so the byte in front decides.
        skipping = part.start > part.first and stream.read_at(1, part.start - 1) != b"\n"
        begin = at
        while at < part.last and (begin < part.end or skipping):
            data = stream.read_at(min(STEP, part.last - at), at)
            if not data:
                break
            at += len(data)
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                if skipping:
                    skipping = False
                elif begin < part.end:
                    lines.append(piece.removesuffix(b"\r").decode(errors="replace"))
                    places.append(begin)
                begin += len(piece) + 1
            while len(lines) >= _LINES:
                yield _batch(part.file, places[:_LINES], lines[:_LINES])
                lines, places = lines[_LINES:], places[_LINES:]
        if lines:
            yield _batch(part.file, places, lines)


def _batch(file: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], ["file", "at", "line"])


class GrowingLines(DataSource):
    """Options: ``path``; ``from`` and ``to``, offsets as JSON (reads only); ``range``, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("range", RANGE))
        self.before, self.after = json.loads(options.get("from", "{}")), json.loads(options.get("to", "null"))

    def partitions(self) -> list[Range]:
        after = latest_offsets(self.path, self.before) if self.after is None else self.after
        return ranges_between(self.before, after, self.width) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read_range(self.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("range", RANGE))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = latest_offsets(self.path, self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = end
        return ranges_between(start, end, self.width)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def read_new_lines(spark: SparkSession, path: str, before: dict[str, int] | None = None, width: int = RANGE) -> tuple[DataFrame, dict[str, int]]:
    """(file, at, line) of the lines added behind the offsets ``before``, and the offsets to give to the next read.

    The rows stay the same however often the frame is computed, also while files grow.
    Store the offsets once the rows are safe: then no line is lost, and none comes twice after a success.
    """
    spark.dataSource.register(GrowingLines)
    before = dict(before or {})
    after = latest_offsets(path, before)
    reader = spark.read.format(NAME).option("path", path).option("range", width)
    return reader.option("from", json.dumps(before)).option("to", json.dumps(after)).load(), after


def stream_lines(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """A stream of (file, at, line); the stream's checkpoint keeps the offsets."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", path).option("range", width).load()


def json_lines(lines: DataFrame, schema: str = LOG_SCHEMA) -> DataFrame:
    """The records of JSON lines; malformed lines are left out, as ``read_json_log`` does."""
    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim("line") != "").select(parsed.alias("r"))
    return rows.filter(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")
