"""Keyed writes on files without row-level updates: each gives the table's next version as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str]) -> bool:
    """Does no key occur twice?"""
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows with their keys, but for the columns in ``keep``; other rows stay."""
    cols = old.columns
    o = old.select(*keys, F.struct(*cols).alias("o"))
    n = new.select(*keys, F.struct(*cols).alias("n"))
    j = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("n").isNull() | (F.lit(c in keep) & F.col("o").isNotNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return j.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in cols])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not there yet are added."""
    return old.unionByName(new.select(old.columns).join(old.select(*keys), keys, "left_anti"))


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(old.columns))


def delete_where_absent(old: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys nothing uses go."""
    return old.join(used.select(*keys), keys, "left_semi")


def appended_changes(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of ``new`` whose value differs from the latest of their key."""
    latest = old.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_latest"))
    return new.join(latest, keys, "left").where(~F.col(value).eqNullSafe(F.col("_latest")) | F.col("_latest").isNull()).drop("_latest")


def only_changes(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The rows of each key at which the value changes."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumns({"_before": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return d.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` as ``new`` has them for its keys (once each); nulls in ``new`` and other rows change nothing."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    d = old.join(n, keys, "left")
    return d.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def not_since(df: DataFrame, group: list[str], keys: list[str], time: str, run: Column, latest: int) -> DataFrame:
    """(group, keys) of what was last seen before its group's ``latest``-th latest run; groups with fewer runs have none."""
    from pyspark.sql import Window

    runs = df.select(*group, run.alias("_run")).distinct()
    since = runs.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_run").desc()))).where(F.col("_n") == latest).drop("_n")
    seen = df.groupBy(*group, *keys).agg(F.max(time).alias("_seen"))
    return seen.join(since, group).where("_seen < _run").select(*group, *keys)


#: Characters of a search that the log of misses keeps.
MISS_CHARS = 200


def missed(df: DataFrame, text: str) -> DataFrame:
    """(text, misses): blank searches are no misses; others are trimmed and cut to ``MISS_CHARS``."""
    from cobbler.functions.text import BLANK

    said = F.left(F.btrim(F.regexp_replace(text, f"{BLANK}+", " ")), F.lit(MISS_CHARS))
    return df.select(said.alias(text)).where(F.col(text) != "").groupBy(text).agg(F.count("*").alias("misses"))


def swapped(df: DataFrame, folder: str) -> None:
    """Writes ``df`` beside ``folder`` and puts it in its place by renames, so readers see the old table or the new one.

    A job that dies while writing leaves the old table as it was.
    """
    spark = df.sparkSession
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fresh, gone = f"{folder}.fresh", f"{folder}.gone"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(fresh)
    fs.delete(path(gone), True)
    if fs.exists(path(folder)) and not fs.rename(path(folder), path(gone)):
        raise OSError(f"can't move {folder}")
    if not fs.rename(path(fresh), path(folder)):
        fs.rename(path(gone), path(folder))
        raise OSError(f"can't move {fresh}")
    fs.delete(path(gone), True)
