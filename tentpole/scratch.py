"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths made by this process and not deleted yet, with the session that made them.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a local master (tests) gets a folder in the warehouse;
    a cluster is asked for one, since executors cannot see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tentpole_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`. It is deleted at the end of the process, or by :func:`released`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, unlike a cache or a local checkpoint. The
    path is kept on the returned frame for :func:`dropped`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tentpole_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`saved` that nobody reads any more."""
    _delete(df.sparkSession, df._tentpole_path)


def made() -> set[str]:
    """The paths that exist now, to be told apart from later ones by :func:`released`."""
    return set(_made)


def released(before: set[str], but: set[str] = frozenset()) -> None:
    """Delete all paths made since ``before`` was taken, but for those in ``but``. Frames that read them must be written by then."""
    for path in [p for p in _made if p not in before and p not in but]:
        _delete(_made[path], path)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; nothing else can be done at the end of the process
            return
