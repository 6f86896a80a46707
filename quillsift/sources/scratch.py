"""Intermediate tables, written once into the cluster's shared folder and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders made and tables written, by application.
_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in the session's spark.checkpoint.dir, or the one given to setCheckpointDir(). Where neither is set, a new
    temporary one, in local mode only: the executors of a cluster do not share the driver's disk, so there it is an
    error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillsift-")
    return _own[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted by release() or at the end of the driver process."""
    path, app = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(release, spark)
    _written[app].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once into Parquet in the shared folder and read again: later steps start from files that
    outlive any executor. The files stay until discard(), release() or the end of the driver process."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark, df._written_to)
        _written[spark.sparkContext.applicationId].remove(df._written_to)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make(), written; of the tables that it wrote on the way none is kept."""
    app = spark.sparkContext.applicationId
    before = len(_written.get(app, []))
    out = written(make(), label)
    for path in _written[app][before:-1]:
        _delete(spark, path)
    del _written[app][before:-1]
    return out


def release(spark: SparkSession) -> None:
    """Deletes what written() left for this application, unless its session has ended: its gateway is closed then, and
    the folder's owner cleans up."""
    if spark.sparkContext._jsc is not None:
        for path in _written.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
