"""Constraints that files don't enforce, as counts of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations"))


def missing_parents(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many rows name a parent that isn't there; null names none."""
    known = parent.select(F.col(parent_key).alias(key))
    return df.where(F.col(key).isNotNull()).select(key).join(known, key, "left_anti").agg(F.count("*").alias("violations"))


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """How many rows hold a value that isn't allowed; null is allowed."""
    return df.where(~F.col(column).isin(allowed)).agg(F.count("*").alias("violations"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, violations), one row per check."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("check"), "violations") for n, d in checks.items()])
