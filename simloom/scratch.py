"""Tables that end a lineage, in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: Paths of the tables made in each open scope, the innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Only where that is unset and everything runs in one process, as in local tests, a temporary folder
    of this machine takes its place. On a cluster executors would each write to their own disk, so an
    unset folder is an error there.
    """
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="simloom-")
        base = _own
    return base.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes with the scope that it was made in."""
    path = f"{shared_folder(spark)}/simloom-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """df written and read again. Iterations store each round, so that a lost executor costs no recomputation of all rounds."""
    spark = df.sparkSession
    path = path or scratch_folder(spark)
    df.write.mode(mode).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._simloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    jvm = spark._jvm  # Spark has no public call for this
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_simloom_path", None)
        if path:
            remove(table.sparkSession, path)
            for made in _scopes:
                if path in made:
                    made.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at its end, also if it fails, but for those given to the yielded function.

    What is kept belongs to the scope around it, if there is one.
    """
    made: list[str] = []
    kept: list[str] = []
    _scopes.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._simloom_path)
        return table

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.pop()
        for path in made:
            if path not in kept:
                remove(spark, path)
        if _scopes:
            _scopes[-1].extend(p for p in kept if p in made)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made within hand Arrow batches of at most so many rows to Python; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
