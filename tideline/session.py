"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# By application: the folder named for it where the setting is unset, and what was written.
_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}
# By frame that ``materialise`` returned and that is still in use.
_lock = Lock()
# By application and setting: threads that write, and the setting before the first of them.
_inside: dict[tuple[str, str], tuple[int, str]] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(
    cores: int | str = 8, app_name: str = "tideline", folder: str | None = None
) -> SparkSession:
    """A session for tests and the bench on one machine, with a folder for written tables."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SETTING, folder or tempfile.mkdtemp(prefix="tideline-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def name_folder(spark: SparkSession, folder: str) -> None:
    """Use ``folder`` where the session has no setting; every executor must reach it."""
    _folders[spark.sparkContext.applicationId] = folder


def ready(spark: SparkSession) -> SparkSession:
    """For entry points: a session of one machine that names no folder gets one of its own.

    A cluster's session is left as it is, and fails at its first written table if no folder is
    named: a temporary folder of one machine is not seen by the others.
    """
    app = spark.sparkContext
    local = app.master == "local" or app.master.startswith("local[")
    if local and app.applicationId not in _folders and not spark.conf.get(SETTING, None):
        name_folder(spark, tempfile.mkdtemp(prefix="tideline-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``, or what was named."""
    folder = spark.conf.get(SETTING, None) or _folders.get(spark.sparkContext.applicationId)
    if not folder:
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path below the shared folder that nothing uses yet; ``release`` removes it."""
    path = f"{shared_folder(spark)}/tideline/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def _set(spark: SparkSession, name: str, default: str, value: str):
    """``name`` is ``value`` inside; as set before once no thread is inside."""
    key = (spark.sparkContext.applicationId, name)
    with _lock:
        inside, before = _inside.get(key, (0, spark.conf.get(name, default)))
        _inside[key] = (inside + 1, before)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            inside, before = _inside.pop(key)
            if inside > 1:
                _inside[key] = (inside - 1, before)
            else:
                spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of queries that are made and run inside go when each has ended.

    Else they stay until the driver's memory is collected, which a driver with little to do puts off.
    """
    return _set(spark, CLEANUP, "false", "true")


def _batches(spark: SparkSession, rows: int | None):
    """Tasks hand Python at most ``rows`` rows at once, or fewer where the session says so."""
    now = int(spark.conf.get(BATCH_ROWS, "10000"))
    if rows is None or 0 < now <= rows:
        return nullcontext()
    return _set(spark, BATCH_ROWS, "10000", str(rows))


def materialise(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, keeps column pruning and filter pushdown for the readers,
    and survives the loss of any executor. Shuffle files of the write go when it has ended:
    nothing reads them again, and a chain of writes would pile them up. ``batch_rows`` bounds the
    rows that a task hands Python at once, for rows of many bytes.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with shuffles_dropped(spark), _batches(spark, batch_rows):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def discard(written: DataFrame) -> None:
    """Remove a table that ``materialise`` returned; no frame may read it any more."""
    path, spark = _paths.pop(written), written.sparkSession
    _written[spark.sparkContext.applicationId].remove(path)
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Remove what this application wrote below the shared folder; returns the number of paths.

    Frames that read these tables cannot be used afterwards: write results first, and forget
    stages that are held (``plans.stages.forget_stages``).
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)
