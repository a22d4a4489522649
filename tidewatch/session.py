"""Spark session and shared-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every expression costs milliseconds each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _machine_local(folder: str) -> bool:
    """A path below a temporary folder of one machine."""
    path = "/" + folder.removeprefix("file:").strip("/") + "/"
    return folder.startswith(("/", "file:")) and path.startswith(("/tmp/", "/var/tmp/", tempfile.gettempdir() + "/"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a session whose executors run on this machine may use a temporary
    folder; on a cluster a machine-local folder would lose data with its host,
    so such a setting is refused there.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if folder:
        if not local and _machine_local(folder):
            raise ValueError(f"spark.checkpoint.dir is {folder}, a temporary folder of one machine")
        return folder.rstrip("/")
    if local:
        # The setting cannot be changed in a running session, so the path is kept here.
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="tidewatch-")
        return _local_folder
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written table, removed when Python ends."""
    path = f"{shared_folder(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_all)
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again when an executor is lost."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Rows go to Python by batches of at most ``size`` bytes in the steps that are computed inside; results are the same.

    Of a batch there is a copy in the JVM and, while the next one is read, two in the worker, so that Spark's 64 MB are 400 MB of an executor with two cores.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(*tables: DataFrame) -> None:
    """Remove the folders of ``written`` tables that nothing reads any more, and let Spark drop the shuffles of finished steps.

    Spark's cleaner removes the shuffle files of plans that the driver has forgotten, which it
    notices only when its memory is collected; a job of many steps would else keep the files of all of them.
    """
    if tables:
        settle(tables[0].sparkSession, 0)
    for table in tables:
        files = table.inputFiles()
        for spark, path in [x for x in _written if files and x[1].rsplit("/", 1)[1] in files[0]]:
            _remove(spark, path)
            _written.remove((spark, path))


def settle(spark: SparkSession, seconds: float = 1.0) -> None:
    """Let Spark drop the shuffles of the jobs done so far; for jobs of many large steps.

    Right after a job its plan is still held by events on their way to listeners, hence the wait.
    What one collection frees holds more, which only a second one frees.
    """
    for _ in range(2):
        time.sleep(seconds / 2)
        gc.collect()
        spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _release_all() -> None:
    """At the end of the process, while its session still lives."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the session or its folder is already gone
            continue
    _written.clear()
