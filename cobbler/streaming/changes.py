"""Append-on-change over a stream of readings (an extension: the reference has no streaming).

Each micro-batch is reduced to its changes per key, compared with the table of latest values and
appended; the table's next version is written beside it, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobbler.operators.upsert import only_changes


def late_free(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The stream with exact repeats inside the watermark dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])


def change_writer(path: str, keys: list[str], time: str, value: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends to ``path`` the rows at which a key's value changes; one folder per batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        steps = only_changes(batch, keys, [F.col(time)], value)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        if there:
            old = spark.read.schema(T.StructType([*steps.schema.fields, T.StructField("epoch", T.LongType())])).parquet(path).where(F.col("epoch") < epoch)
            latest = old.groupBy(*keys).agg(F.max_by(value, time).alias("_latest"), F.lit(True).alias("_known"))
            first = steps.groupBy(*keys).agg(F.min(time).alias("_first"))
            j = steps.join(latest, keys, "left").join(first, keys)
            same = F.col("_known") & (F.col(time) == F.col("_first")) & F.col(value).eqNullSafe(F.col("_latest"))
            steps = j.where(~F.coalesce(same, F.lit(False))).select(steps.columns)
        steps.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
