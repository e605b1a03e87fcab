"""The best representative of each duplicate group, field by field, in one aggregation.

For every field the greatest struct (sound, source priority, time, tie breakers, value) of the
group wins; all fields are decided in one pass over the group, with partial maxima before the
shuffle, so a group that holds a third of all rows costs one row per task.

Defined results.  Null values are never sound.  A field of which the group has no sound value is
null.  Null times are older than any; among equal times the smallest source id wins.  Repeated rows
change nothing.  Rows with a null group key belong to no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(df: DataFrame, key: str, source: str, time: str, fields: dict[str, Column], priority: Column | None = None) -> DataFrame:
    """One row per key: ``n_sources`` and, for each field, a struct (value, source, time) or null.

    ``fields`` gives the soundness of each named column; ``priority`` ranks trust in a row's source.
    """
    priority = F.lit(0) if priority is None else priority
    # columns of the input cannot clash with the names used here: only these are carried
    carried = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        *[
            F.when(
                F.coalesce(sound, F.lit(False)) & F.col(f).isNotNull(),
                F.struct(priority.alias("priority"), F.col(time).alias("time"), (-F.col(source)).alias("order"), F.col(f).alias("value")),
            ).alias(f"_f{i}")
            for i, (f, sound) in enumerate(fields.items())
        ],
    )
    best = carried.groupBy("_key").agg(
        # two sources are two different ids: minimum and maximum tell, without a distinct count
        F.min("_source").alias("_low"),
        F.max("_source").alias("_high"),
        *[F.max(f"_f{i}").alias(f"_f{i}") for i in range(len(fields))],
    )
    return best.select(
        F.col("_key").alias(key),
        (F.col("_low") < F.col("_high")).alias("several"),
        *[F.when(F.col(f"_f{i}").isNotNull(), F.struct(F.col(f"_f{i}.value").alias("value"), (-F.col(f"_f{i}.order")).alias("source"), F.col(f"_f{i}.time").alias("time"))).alias(f) for i, f in enumerate(fields)],
    )
