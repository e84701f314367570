"""Intermediate tables in the folder that the driver and all executors share.

``cut`` writes a table below ``spark.checkpoint.dir`` and reads it again: the
lineage ends there, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that exist: path -> (session, owner or None).
_written: dict[str, tuple[SparkSession, str | None]] = {}
_owner: list[str | None] = [None]


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a local one only where none is set (single-machine sessions)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="authorloom-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark)}/authorloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, _owner[-1])
    return path


@contextlib.contextmanager
def owned(owner: str):
    """Folders made meanwhile belong to ``owner``, so that ``free`` can delete them together."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def free(owner: str, *still_read: DataFrame) -> None:
    """Delete the owner's folders, except those that ``still_read`` is yet to read."""
    files = [f for df in still_read for f in df.inputFiles()]
    for path, (spark, whose) in list(_written.items()):
        name = path.rpartition("/")[2]  # holds a unique number
        if whose == owner and not any(name in f for f in files):
            delete(spark, path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that a task gathers into one file, for narrow rows and for rows with a text.
NARROW_ROWS, TEXT_ROWS = 250_000, 8_000


def sized(df: DataFrame, rows: int, per_file: int = NARROW_ROWS) -> DataFrame:
    """At most one partition for every ``per_file`` of the ``rows`` expected.

    Keeps small results of many shuffle partitions from becoming as many small
    files; merges partitions without a shuffle, and does nothing at scale.
    """
    return df.coalesce(max(1, -(-rows // per_file)))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries that run meanwhile delete their shuffle files when they end: for results that are not computed again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; ``rows``: about how many it has at most."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        (df if rows is None else sized(df, rows)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, (spark, _) in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM has gone first
            return
