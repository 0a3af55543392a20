"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: On ``file:`` Hadoop starts a process (chmod) for every file and folder it makes, and until that has begun
#: it counts as a second JVM of the same size. So no side files: pages carry their checksums, and a table is
#: only read once its write has returned. Other file systems have neither the processes nor the side files.
_WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "parquet.page.write-checksum.enabled": "true"}
_READ = {"parquet.page.verify-checksum.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), one
    of our own. A cluster without the setting is an error, as its machines share no folder of theirs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cytoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/cytoloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    A lost executor then costs a re-read, not a recomputation, and Python stages with side
    effects are not run twice.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**_WRITE).parquet(path)
    out = spark.read.options(**_READ).schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave and nothing will read again."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            spark = df.sparkSession
            _delete(spark, path)
            _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this session wrote; results not yet consumed become unreadable."""
    for owner, path in list(_made):
        if owner is spark:
            _delete(spark, path)
            _made.remove((owner, path))


@atexit.register
def _cleanup_all() -> None:
    for owner in {id(s): s for s, _ in _made}.values():
        try:
            cleanup(owner)
        except Exception:  # the session has already stopped
            pass
