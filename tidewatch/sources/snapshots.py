"""Tables that change in one step: folders of Parquet files, and a manifest that says which of them count.

A commit writes new folders first and then one manifest file, under the next version number,
by a rename that fails if the number is taken. So a reader sees the old or the new
state of all tables in a commit, a failed write leaves the old one, and of two writers at one time
the second is told. A partition that does not change keeps its folder: rolling back a
batch or patching a few rows rewrites the partitions concerned only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import named
from tidewatch.operators.hashfilter import MAYBE, build_slices, maybe_among
from tidewatch.session import written

#: Column of a partition's name in a written folder; not part of the table.
PART = "_part"
#: The name of the partition of rows whose partition text is NULL or empty.
NO_NAME = "_none"
#: Digits of a version in the name of its manifest.
_DIGITS = 12


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that this commit started from."""


class Snapshots:
    """Tables below one folder of any file system that Spark can reach.

    A table's partitions are named by a text that is an expression of a row. The manifest
    lists one folder per partition, which is all that the driver holds.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- reading -------------------------------------------------------------------

    def version(self) -> int:
        """The last committed version; 0 before the first commit."""
        return max((int(name.removesuffix(".json")) for name in self._names("versions") if name.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {"schema": ..., "parts": {partition: folder}}} of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._open(f"versions/{version:0{_DIGITS}d}.json")
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def partitions(self, table: str, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version).get(table, {"parts": {}})["parts"])

    def read(self, table: str, version: int | None = None, partitions: Iterable[str] | None = None) -> DataFrame:
        """A table as of a version, or only some of its partitions, whose files alone are read.

        The rows do not change when others commit, until ``vacuum`` removes their folders.
        """
        found = self.manifest(version).get(table)
        if found is None:
            raise ValueError(f"no table {table} in {self.root}")
        return self._rows(found, found["parts"] if partitions is None else set(partitions) & set(found["parts"]))

    def _rows(self, found: dict, names: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        folders = [f"{self.root}/{found['parts'][n]}" for n in sorted(names)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing -------------------------------------------------------------------

    def commit(self, changes: dict[str, "Change"], base: int | None = None) -> int:
        """All changes, or none of them, as the version after ``base`` (by default the last one); returns its number."""
        base = self.version() if base is None else base
        state = self.manifest(base)
        for table, change in changes.items():
            state[table] = change.applied(self, state.get(table))
        self._publish(base + 1, state)
        return base + 1

    def write(self, table: str, df: DataFrame, partition: Column, base: int | None = None) -> int:
        """Replace a whole table."""
        return self.commit({table: Replace(df, partition)}, base)

    def _folders(self, df: DataFrame, partition: Column, untouched: DataFrame | None = None) -> dict[str, str]:
        """Write rows by partition in one job: {partition: folder}. A hot partition is written by many tasks.

        Rows of ``untouched`` come from the files of their partitions, so the tasks that read them write them, without a shuffle.
        """
        text = partition.cast("string")
        # A name is hex text, so that any value makes a folder.
        name = F.when(text.isNull() | (text == ""), NO_NAME).otherwise(F.concat(F.lit("x"), F.hex(text.cast("binary"))))
        data = f"data/{uuid.uuid4().hex}"
        placed = df.select("*", name.alias(PART)).hint("rebalance", F.col(PART))
        if untouched is not None:
            placed = untouched.select("*", name.alias(PART)).unionByName(placed)
        placed.write.partitionBy(PART).parquet(f"{self.root}/{data}")
        found = {}
        for folder in self._names(data):
            if folder.startswith(f"{PART}="):
                raw = folder.removeprefix(f"{PART}=")
                found["" if raw == NO_NAME else bytes.fromhex(raw[1:]).decode()] = f"{data}/{folder}"
        return found

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions lists, and older manifests; returns the folders removed.

        Call it when no commit is under way, as its folders are not listed yet.
        """
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {folder for v in kept for found in self.manifest(v).values() for folder in found["parts"].values()}
        gone = []
        for write in self._names("data"):
            for part in self._names(f"data/{write}"):
                folder = f"data/{write}/{part}"
                if part.startswith(f"{PART}=") and folder not in used:
                    self._delete(folder)
                    gone.append(folder)
        for name in self._names("versions"):
            if name.endswith(".json") and int(name.removesuffix(".json")) not in kept:
                self._delete(f"versions/{name}")
        return gone

    # --- files ---------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        system = self._system(path)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def _open(self, name: str):
        path = self._path(name)
        return self._system(path).open(path)

    def _delete(self, name: str) -> None:
        path = self._path(name)
        self._system(path).delete(path, True)

    def _publish(self, version: int, state: dict) -> None:
        """The manifest under its final name in one step, if no other has that name."""
        jvm = self.spark._jvm
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{version:0{_DIGITS}d}.json")
        system = self._system(draft)
        stream = system.create(draft)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        system.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Exception as error:  # noqa: BLE001  py4j wraps the file system's own exception
            if system.exists(final):
                system.delete(draft, False)
                raise CommitConflict(f"version {version} of {self.root} exists already") from error
            raise


class Change:
    """What a commit does to one table."""

    def applied(self, store: Snapshots, found: dict | None) -> dict:
        raise NotImplementedError


def _described(df: DataFrame) -> dict:
    """The schema as Parquet files give it back: every column may be NULL."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]).jsonValue()


class Replace(Change):
    """The whole table anew."""

    def __init__(self, df: DataFrame, partition: Column):
        self.df, self.partition = df, partition

    def applied(self, store, found):
        return {"schema": _described(self.df), "parts": store._folders(self.df, self.partition)}


class Drop(Change):
    """Some partitions go; nothing is read or written. Names that do not exist change nothing, so it may be repeated."""

    def __init__(self, partitions: Iterable[str]):
        self.gone = {p or "" for p in partitions}

    def applied(self, store, found):
        found = found or {"schema": T.StructType().jsonValue(), "parts": {}}
        return {**found, "parts": {p: f for p, f in found["parts"].items() if p not in self.gone}}


class Rewrite(Change):
    """``step(rows)`` in place of the rows of some partitions; all others keep their files.

    Rows whose partition changes move to it only if that is one of ``partitions``. ``split(rows)`` may
    give two parts of them, of which the first is kept as it is and only the second goes through the step.
    """

    def __init__(self, partitions: Iterable[str], step, partition: Column, split=None):
        self.names, self.step, self.partition, self.split = {p or "" for p in partitions}, step, partition, split

    def applied(self, store, found):
        if found is None:
            raise ValueError("no such table")
        old = store._rows(found, self.names & set(found["parts"]))
        same, rest = self.split(old) if self.split else (None, old)
        new = store._folders(self.step(rest).select(*[named(c) for c in old.columns]), self.partition, same)
        strange = set(new) - self.names
        if strange:
            raise ValueError(f"rows left their partitions: {sorted(strange)[:5]}")
        return {**found, "parts": {p: f for p, f in found["parts"].items() if p not in self.names} | new}


class Add(Change):
    """New rows in partitions that the table does not have yet, such as the batches of a load.

    A partition that exists already is replaced, so that a load may be repeated.
    """

    def __init__(self, df: DataFrame, partition: Column):
        self.df, self.partition = df, partition

    def applied(self, store, found):
        if found is None:
            return Replace(self.df, self.partition).applied(store, None)
        names = [f["name"] for f in found["schema"]["fields"]]
        return {**found, "parts": found["parts"] | store._folders(self.df.select(*[named(n) for n in names]), self.partition)}


# --- operations of the loads ---------------------------------------------------------------


def load_batches(store: Snapshots, rows: dict[str, DataFrame], batch: str = "batch_id", base: int | None = None) -> int:
    """Rows of several tables, partitioned by batch, in one commit: all tables have the batches, or none has."""
    return store.commit({table: Add(df, F.col(batch)) for table, df in rows.items()}, base)


def roll_back(store: Snapshots, batches: Sequence[str], tables: Sequence[str], history: str | None = None, at: Column | None = None) -> int:
    """Batches go from all ``tables`` in one commit, without reading a row; in ``history`` they become ``rolled_back``.

    ``history`` is partitioned by batch as well. Repeating it changes nothing more.
    """
    changes: dict[str, Change] = {t: Drop(batches) for t in tables}
    if history:
        moment = F.col("completed_at") if at is None else at

        def marked(rows: DataFrame) -> DataFrame:
            return rows.withColumns(
                {"status": F.lit("rolled_back"), "error_message": F.lit("Batch manually rolled back"), "completed_at": moment}
            )

        changes[history] = Rewrite(set(batches) & set(store.partitions(history)), marked, F.col("batch_id"))
    return store.commit(changes)


def _concerned(store: Snapshots, table: str, keys: DataFrame, partition: Column, new: bool = False) -> set[str]:
    """Partitions of a table that hold rows with one of the keys, where ``partition`` names a row's partition by its key alone.

    With ``new`` also those that the table does not have yet. Only names, at most one per partition, come to the driver.
    """
    names = {r[0] or "" for r in keys.select(partition.cast("string").alias("p")).distinct().collect()}
    return names if new else names & set(store.partitions(table))


def _split_by(keys: DataFrame, key: str):
    """For ``Rewrite``: rows whose key is certainly not among ``keys``, and the others.

    A filter of the keys tells, which is at most 16 MB and so broadcast; beyond some ten million keys it only lets more
    rows through to the second part.
    """
    bits = written(build_slices(keys, key), "key-filter")

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        if rows.schema[key].dataType != keys.schema[key].dataType:
            return rows.limit(0), rows
        found = maybe_among(rows, bits, key)
        return tuple(found.filter(c).select(*[named(c) for c in rows.columns]) for c in (~F.col(MAYBE), F.col(MAYBE)))

    return split


def roll_back_grouped(
    store: Snapshots, batches: DataFrame, tables: Sequence[str], history: str | None, partition: Column, at: Column | None = None
) -> int:
    """``roll_back`` for tables whose partitions hold many batches each: only partitions with one of ``batches`` (batch_id) are rewritten.

    Rows of batches that certainly stay are copied without a shuffle; the join sees the others only.
    Rows without a batch stay. Repeating it changes nothing more.
    """
    wanted = written(batches.select("batch_id").filter("batch_id IS NOT NULL").distinct(), "rolled-back")
    split = _split_by(wanted, "batch_id")
    changes: dict[str, Change] = {
        t: Rewrite(_concerned(store, t, wanted, partition), lambda rows: rows.join(wanted, "batch_id", "left_anti"), partition, split) for t in tables
    }
    if history:
        moment = F.col("completed_at") if at is None else at
        hit = F.col("_hit").isNotNull()
        values = {"status": F.lit("rolled_back"), "error_message": F.lit("Batch manually rolled back"), "completed_at": moment}

        def marked(rows: DataFrame) -> DataFrame:
            known = rows.join(wanted.withColumn("_hit", F.lit(True)), "batch_id", "left")
            return known.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})

        changes[history] = Rewrite(_concerned(store, history, wanted, partition), marked, partition, split)
    return store.commit(changes)


def patch(store: Snapshots, table: str, updates: DataFrame, step, partition: Column, insert: bool = False) -> int:
    """``step(rows, updates)`` for the partitions that hold a key of ``updates``; the others keep their files.

    ``partition`` names a row's partition by its key alone, so the updates say which partitions
    change. With ``insert`` a step may add keys, also in partitions that are new.
    """
    names = _concerned(store, table, updates, partition, insert)
    return store.commit({table: Rewrite(names, lambda rows: step(rows, updates), partition)})


def expire(store: Snapshots, table: str, column: str, cutoff: Column, day: Column) -> int:
    """Rows older than ``cutoff`` go. Days before it go whole and unread; only the day of the cutoff is rewritten.

    The table is partitioned by ``day``, the date of ``column`` as text; rows without a time stay.
    """
    last = store.spark.range(1).select(cutoff.cast("date").cast("string")).first()[0]
    days = store.partitions(table)
    older = [d for d in days if d and d < last]
    split = [d for d in days if d == last]
    keep = F.col(column).isNull() | (F.col(column) >= cutoff)
    state = store.version()
    if split:
        # Both steps are one change of the table, so one commit.
        return store.commit({table: _Both(Drop(older), Rewrite(split, lambda rows: rows.filter(keep), day))}, state)
    return store.commit({table: Drop(older)}, state)


class _Both(Change):
    def __init__(self, *changes: Change):
        self.changes = changes

    def applied(self, store, found):
        for change in self.changes:
            found = change.applied(store, found)
        return found


def bucket(key: str, n: int = 64) -> Column:
    """The partition of a key in a table that is patched by key: one of ``n`` texts."""
    return F.pmod(F.xxhash64(named(key)), F.lit(n)).cast("string")
