"""Intermediate tables in the shared folder that the cluster names.

A table written and read again cuts the lineage: a lost executor costs only the tasks that it ran, and
every executor and the driver see the same files. The folder comes from ``spark.checkpoint.dir``; only
where that is unset and the master is local (tests, a laptop) is a temporary one made. Tables stay until
:func:`release`, which is also called when the driver's Python ends, as the frames that read them are lazy.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FEW_ROWS = 2_000_000
#: Vectored reads keep a direct buffer as large as a column chunk for each thread that ever read one, outside the heap.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}
_own: str | None = None
_written: list[str] = []
_releases = 0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own where none is configured."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors and the driver share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    return _own


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it back.

    Where the caller has counted that it has no more than ``rows`` rows, and these are few, it is written by no
    more tasks than there are cores: a file costs some milliseconds, however small it is.
    """
    spark = df.sparkSession
    if rows is not None and rows <= FEW_ROWS:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/loomspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).options(**PLAIN_READS).parquet(path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written and spark.sparkContext._jsc is not None:
        release(spark)


def releases() -> int:
    """How often all tables were deleted: what holds on to one is out of date when it grows."""
    return _releases


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete every table that :func:`materialize` wrote in this process, but those whose labels begin as in ``keep``; frames that read them can be used no more."""
    global _releases
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    _releases += not keep
    kept = [p for p in _written if p.rpartition("/")[2].startswith(keep)] if keep else []
    for written in _written:
        if written not in kept:
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)
    _written[:] = kept
