"""Session settings the engine relies on, and the folder shared by all executors."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

#: The folder that everything written inside a `scratch` block goes under.
_OWNED: ContextVar[str | None] = ContextVar("headwise_scratch", default=None)
_MARKED = re.compile(r"-[0-9a-f]{32}$")


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on. Sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`, else one in the warehouse.

    Both are places that the driver and all executors see. There is no fallback to a
    folder of one machine: what one executor wrote there another could not read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, or under that of the `scratch` block this is called in."""
    return f"{_OWNED.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder that holds all scratch written inside the block, by any operator, and is gone after it.

        with scratch(spark, "dedup"):
            exact_duplicates(docs).write.parquet(target)

    Frames that read such scratch must have been used by the end of the block. The folder goes
    when the block fails, too; what a lost driver leaves is found by `sweep_scratch`.
    """
    folder = scratch_path(spark, name)
    token = _OWNED.set(folder)
    try:
        yield folder
    finally:
        _OWNED.reset(token)
        _delete(spark, folder)


def sweep_scratch(spark: SparkSession, older_than_hours: float = 7 * 24.0) -> list[str]:
    """Delete what lost drivers left in the shared folder; the names of the folders gone.

    Only folders that carry a mark as given by `scratch_path` are touched, and only when nothing under
    them has been written for that long: choose more hours than the longest job takes. Folders
    that hold a catalog table's rows or a stream's checkpoint don't belong in the shared folder.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(shared_folder(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    before = (time.time() - older_than_hours * 3600) * 1000
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and _MARKED.search(name) and _newest(files, status) < before:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def _newest(files, status) -> int:
    """When a folder, or anything in it, was last written."""
    latest, waiting = 0, [status]
    while waiting:
        entry = waiting.pop()
        latest = max(latest, entry.getModificationTime())
        if entry.isDirectory():
            waiting += files.listStatus(entry.getPath())
    return latest


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write a frame as Parquet and read it back: cuts lineage, survives executor loss.

    Where disk is shorter than time, name a `compression` that packs more closely than the session's.
    """
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(observation: Observation, metric: str) -> int:
    """A count that an observation took; none where Spark found an input empty and left the observed step out.

    Spark then has a row without metrics, which its conversion to Python refuses with an assertion.
    Any other error is raised.
    """
    try:
        return observation.get[metric]
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName() != "java.lang.AssertionError":
            raise
        return 0


def saved_lookup(df: DataFrame, path: str) -> DataFrame:
    """A lookup written once.

    Written Parquet carries its size in bytes, so Spark knows what a join with it would
    broadcast, and does so up to `spark.sql.autoBroadcastJoinThreshold`.
    """
    return materialise(df, path)
