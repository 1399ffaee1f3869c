"""Intermediate tables that several later steps read.

A staged table is written once to the shared folder the cluster names in ``spark.checkpoint.dir`` and read
back: lineage is cut, a lost executor re-reads files instead of recomputing, later scans prune columns, and
the optimizer knows the real size before it picks a join. A cluster must name that folder; only a session on one machine
(tests) may do without and gets a private temporary folder that is removed when the process ends.

The shuffle files that a staged table came from are no longer needed. Spark's cleaner removes them when the driver's JVM has
collected what refers to them, which a driver with little to do may never get to, so it is asked to every few seconds.
"""

import tempfile
import time
import uuid

from pyspark.sql import DataFrame

_private: list[tempfile.TemporaryDirectory] = []
_collected = 0.0
#: Seconds between requests to the driver's collector.
COLLECT = 5.0


def folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if shared is None:
        if not _private:
            _private.append(tempfile.TemporaryDirectory(prefix="wayline-"))
        shared = _private[0].name
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def _collect(spark) -> None:
    global _collected
    if time.monotonic() - _collected > COLLECT:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def stage(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _collect(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A join side that must be shuffled, not broadcast.

    Before it runs, Spark judges a side by the size of its files and columns. That misses rows copied to cells or pieces, values made
    by an expression, and compression: a few megabytes of files may be a gigabyte of rows, gathered whole on the driver.
    """
    return df.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if root.startswith((folder(spark), f"file://{folder(spark)}", f"file:{folder(spark)}")):
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
