"""Consolidating pairwise matches into groups: minimum labels with pointer jumping.

Each round, every vertex that still has an edge takes the smallest label among itself and its
neighbours (one aggregation, combined before the shuffle, so a vertex that stands in a third of
all pairs costs one row per task).  The labels so chosen form a forest; pointer jumping shortens
it until every vertex points to a root.  Edges are then rewritten to the roots, loops and repeats
fall away, and the round's result is checkpointed as a table of the shared folder.  It ends when no edge is left, that is when
no label changes.  The forests of all rounds are composed from the last to the first at the end,
so settled vertices are not carried through the rounds.

Joins on labels may meet a hot label; the sides joined to have one row per key, so adaptive
skew splitting divides the hot side over tasks.

Defined results.  An id that stands in a row without a usable link is a group of its own.  Null
ids are no ids; self pairs and repeated or reversed pairs change nothing; ties cannot arise, as
the label is the smallest id.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.plans.durable import cut, cut_counted, drop_written


def _jump(hooks: DataFrame) -> DataFrame:
    """hooks: x -> m, m < x.  Follows m until it is no x any more; each pass doubles the steps taken."""
    table, moved = cut(hooks), 1
    while moved:
        to = table.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        further, moved = cut_counted(table.join(to, "m", "left").select("x", F.coalesce("mm", "m").alias("m"), F.col("mm").isNotNull().alias("moved")), "moved")
        drop_written(table)
        table = further
    return table


def group_pairs(pairs: DataFrame, a: str, b: str, linked: Column | None = None) -> DataFrame:
    """(id, group_id) of every id in ``a`` or ``b``; rows link their ids where ``linked`` holds and both are there."""
    both = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), (F.lit(True) if linked is None else F.coalesce(linked, F.lit(False))).alias("on"))
    vertices = both.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    edges, left = cut_counted(both.where("on and a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while left:
        # both directions in one pass; the smallest label each vertex hears of
        heard = edges.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("a").alias("m")), F.struct(F.col("a").alias("x"), F.col("b").alias("m")))).alias("e")).groupBy("e.x").agg(F.min("e.m").alias("m"))
        roots = _jump(heard.where("m < x"))
        rounds.append(roots)
        moved = edges.join(roots.select(F.col("x").alias("a"), F.col("m").alias("ma")), "a", "left").select("b", F.coalesce("ma", "a").alias("a"))
        moved = moved.join(roots.select(F.col("x").alias("b"), F.col("m").alias("mb")), "b", "left").select("a", F.coalesce("mb", "b").alias("b"))
        before = edges
        edges, left = cut_counted(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        drop_written(before)
    if not rounds:
        return vertices.select("id", F.col("id").alias("group_id"))
    final = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        on = earlier.join(final.select(F.col("x").alias("m"), F.col("m").alias("mm")), "m", "left").select("x", F.coalesce("mm", "m").alias("m"))
        both = cut(on.unionByName(final.select("x", "m")))
        drop_written(earlier, final)
        final = both
    return vertices.join(final.select(F.col("x").alias("id"), "m"), "id", "left").select("id", F.coalesce("m", "id").alias("group_id"))
