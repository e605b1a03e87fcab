"""Products rebuilt from clusters of listings: leads, slugs that outlive a rebuild, aliases, brands, figures.

Everything is an aggregation by cluster or by slug with constant memory a group, joined back by key;
no step walks clusters in order.  Whoever comes first in the order of claims (most votes, then the
least listing) is found by one minimum for each slug.

Defined results.  Null slugs, brands and models are unknown: they have no vote, and the slug of a
product without a name is its number alone.  Among equal votes the least slug wins.  Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.functions.text import fold_lower, slugify
from cobbler.functions.titles import GOODS

#: A folded model that only names the goods.
PLACEHOLDER = rf"^\s*(?:(?:{'|'.join(GOODS)})(?:\s+|$))*$"


def placeholder(model: Column | str) -> Column:
    return fold_lower(model).rlike(PLACEHOLDER)


def planned(members: DataFrame) -> DataFrame:
    """(cluster, anchor, brand, model, inherited, votes, minted) of ``members`` (cluster, id, brand, model, prior).

    The lead gives brand and model: no placeholder if there is another, then the shortest model, then the least id.
    """
    lead = F.min_by(F.struct("brand", "model"), F.struct(F.coalesce(placeholder("model"), F.lit(True)), F.length("model"), F.col("id")))
    named = members.groupBy("cluster").agg(F.min("id").alias("anchor"), lead.alias("l"))
    votes = members.where("prior is not null").groupBy("cluster", "prior").agg(F.count("*").alias("n"))
    best = votes.groupBy("cluster").agg(F.min_by(F.struct("prior", "n"), F.struct(-F.col("n"), F.col("prior"))).alias("v"))
    minted = F.concat_ws("-", F.nullif(slugify(F.concat_ws(" ", "l.brand", "l.model")), F.lit("")), F.col("anchor").cast("string"))
    d = named.join(best, "cluster", "left")
    return d.select("cluster", "anchor", "l.brand", "l.model", F.col("v.prior").alias("inherited"), F.coalesce("v.n", F.lit(0)).alias("votes"), minted.alias("minted"))


def _claim() -> Column:
    return F.struct(-F.col("votes"), F.col("anchor"))


def claimed(plan: DataFrame) -> DataFrame:
    """``plan`` with ``slug``: the inherited one for the strongest claim to it, else the minted one, with as many "-x" as it needs to be free."""
    ends = F.regexp_extract("slug", r"((?:-x)*)$", 1)
    wins = plan.where("inherited is not null").groupBy(F.col("inherited").alias("slug")).agg(F.min_by("cluster", _claim()).alias("winner"))
    held = wins.select(F.regexp_replace("slug", r"(?:-x)*$", "").alias("stem"), (F.length(ends) / 2).cast("int").alias("k")).groupBy("stem").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    d = plan.join(wins.select(F.col("slug").alias("inherited"), "winner"), "inherited", "left").join(held.withColumnRenamed("stem", "minted"), "minted", "left")
    # the least number of "-x" that no inherited slug has; one more than there are slugs always is
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("ks"), F.lit(0)).cast("int")), F.coalesce("ks", F.array().cast("array<int>"))))
    minted = F.when(F.col("ks").isNull(), F.col("minted")).otherwise(F.concat("minted", F.repeat(F.lit("-x"), free)))
    return d.select(*plan.columns, F.when(F.col("winner") == F.col("cluster"), F.col("inherited")).otherwise(minted).alias("slug"))


def aliases(members: DataFrame, products: DataFrame) -> DataFrame:
    """(alias, cluster): slugs that listings had and no product has any more, each for the product with the strongest claim."""
    d = members.where("prior is not null").select("cluster", "prior").distinct().join(products.select("cluster", "votes", "anchor"), "cluster")
    retired = d.join(products.select(F.col("slug").alias("prior")), "prior", "left_anti")
    return retired.groupBy(F.col("prior").alias("alias")).agg(F.min_by("cluster", _claim()).alias("cluster"))


def brand_names(listings: DataFrame) -> DataFrame:
    """(slug, name): one brand a slug, as the listing of least id writes it; ``listings``: id, brand."""
    d = listings.select("id", "brand", slugify("brand").alias("slug")).where("slug <> ''")
    return d.groupBy("slug").agg(F.min_by("brand", "id").alias("name"))


def cluster_figures(members: DataFrame) -> DataFrame:
    """One row over ``members`` (cluster, shop_id, code): products of several listings and their listings, those of several codes and shops, and listings alone."""
    by = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("shop_id").alias("s1"), F.max("shop_id").alias("s2"), F.min(F.nullif("code", F.lit(""))).alias("c1"), F.max(F.nullif("code", F.lit(""))).alias("c2"))
    many = F.col("n") > 1
    return by.agg(
        F.count_if(many).alias("merged"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("grouped"), F.count_if(many & (F.col("c1") < F.col("c2"))).alias("mixed_codes"),
        F.count_if(many & (F.col("s1") < F.col("s2"))).alias("several_shops"), F.count_if(~many).alias("singles"),
    )


def join_methods(clusters: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, method): by which kind of link each listing stands in its cluster, the weakest of those that hold; 'fuzzy' for one alone.

    ``clusters``: id, cluster; ``edges``: a, b, method, confidence; ``sets``: id, kind, value, confidence, as for
    ``matching.guarded_clusters``.  A link holds if both its ends came into one cluster.
    """
    of = lambda c: clusters.select(F.col("id").alias(c), F.col("cluster").alias(f"in_{c}"))
    held = edges.join(of("a"), "a").join(of("b"), "b").where("in_a = in_b").select(F.explode(F.array("a", "b")).alias("id"), "method", "confidence")
    placed = sets.join(clusters, "id")
    several = placed.groupBy("kind", "value", "cluster").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("kind", "value", "cluster")
    both = placed.join(several, ["kind", "value", "cluster"], "left_semi").select("id", F.col("kind").alias("method"), "confidence").unionByName(held)
    # of equal confidence the name comes last
    weakest = both.groupBy("id").agg(F.min_by("method", F.struct("confidence", F.col("method") != "fuzzy", "method")).alias("method"))
    return clusters.select("id").join(weakest, "id", "left").select("id", F.coalesce("method", F.lit("fuzzy")).alias("method"))
