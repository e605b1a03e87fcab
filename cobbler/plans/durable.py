"""Cutting lineage in a way that survives the loss of an executor.

Everything iterative in this library goes through ``cut``: the frame is written to the
shared folder that ``spark.checkpoint.dir`` names and read back.  Where the session names
none (tests, a laptop) a temporary folder is set once per context.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Tables written by this process and not yet dropped; lazily read results may still need them.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only if none is configured and the master is local."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(conf)
        return conf
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cobbler-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Evaluates ``df`` once into a Parquet table of the shared folder and gives a frame that reads it.

    A table rather than ``checkpoint()``: columns are pruned and compressed on the way back, and the
    new plan starts from a file scan, so that the constraints of former rounds, which a checkpointed
    plan hands on and which multiply with every join, end here too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cobbler/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_leave, spark)
    _WRITTEN.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def cut_counted(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """``cut``, and how many of the rows hold the SQL condition ``which``: counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(which)).alias("n")))
    return out, seen.get["n"]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table written by this process that is still there: for the end of a session, once all results are read."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _leave(spark: SparkSession) -> None:
    """At the end of the process: its tables go, unless the session went before."""
    try:
        drop_all(spark)
    except Exception:  # noqa: BLE001  the gateway may be gone; the folder's owner cleans up then
        _WRITTEN.clear()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a round of an iteration."""
    return written(df, "round")


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` or ``cut`` gave, once nothing will read them again."""
    for df in frames:
        _WRITTEN.discard(df._written)
        _delete(df.sparkSession, df._written)
