"""The queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobbler.llm.canonical import map_values
from cobbler.llm.components import group_pairs
from cobbler.llm.confusables import lookalike_pairs
from cobbler.llm.languages import fit_scores, language_cases, language_stretches
from cobbler.llm.mixing import mix, shares
from cobbler.llm.same_product import product_pairs, same_product
from cobbler.llm.search_cards import sound_model, sound_picture, sound_title
from cobbler.llm.sql import SQL
from cobbler.llm.survivorship import survivors
from cobbler.llm.tokenizing import encode
from cobbler.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of listings that match_result joins by a method."""
    pairs = table(spark, sf, "match_result")
    linked = F.trim(F.regexp_replace("match_method", r"\s+", " ")) != ""
    return group_pairs(pairs, "offer_id_a", "offer_id_b", linked).select(F.col("id").alias("offer_id"), "group_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The listed brand that each listing's brand means, 0 for none."""
    brands = table(spark, sf, "brand").select("brand_id", "brand_name", "aliases")
    return map_values(table(spark, sf, "normalized_offer"), "offer_id", "brand", "title", brands).select("offer_id", F.col("entry").alias("brand_id"))


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The brand values that mean no listed brand, and how many listings bear each."""
    none = p2_found(spark, sf).where("brand_id = 0").select("offer_id")
    return table(spark, sf, "normalized_offer").select("offer_id", "brand").join(none, "offer_id").groupBy("brand").agg(F.count("*").alias("listings"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The product group of every listing."""
    offers = table(spark, sf, "normalized_offer").select(F.col("offer_id").alias("id"), "title", "brand", "model", "sku", "gender")
    codes = table(spark, sf, "match_candidate").select(F.col("offer_id").alias("id"), "gtins")
    groups = same_product(offers, codes, table(spark, sf, "brand").select("brand_id", "brand_name", "aliases"))
    return groups.select(F.col("id").alias("offer_id"), "group_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of listings that sell the same product."""
    pairs = product_pairs(p4_groups(spark, sf).withColumnRenamed("offer_id", "id"))
    return pairs.select(F.col("a").alias("offer_id_a"), F.col("b").alias("offer_id_b"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of listings whose titles or search texts look alike but differ."""
    offers = table(spark, sf, "normalized_offer")
    return lookalike_pairs(offers, "offer_id", ["title", "search_doc"]).select("field_name", F.col("id_a").alias("offer_id_a"), F.col("id_b").alias("offer_id_b"))


P7_FIELDS = ("title", "image_url", "model")


def p7_record(spark: SparkSession, sf: str) -> DataFrame:
    """One surviving record per product."""
    cards = table(spark, sf, "search_result").where(F.col("offer_id").isNotNull())
    sound = {"title": sound_title("title", "product_slug"), "image_url": sound_picture("image_url"), "model": sound_model("model", "product_slug", "brand")}
    return survivors(cards, "product_id", "offer_id", "checked_at", sound)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The listing whose value survives, by product and field."""
    best = p7_record(spark, sf).where("several")
    long = best.select("product_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.source").alias("offer_id")) for f in P7_FIELDS])))
    return long.where("offer_id is not null")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How many times each text of a target source is used."""
    targets = table(spark, sf, "mix_target").select("source", "target_share", "max_repeats")
    return mix(table(spark, sf, "documents"), targets, "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of the mix."""
    targets = table(spark, sf, "mix_target").select("source", "target_share", "max_repeats")
    return shares(p9_mix(spark, sf).withColumnRenamed("doc_id", "id"), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a missing or wrong language label, and the languages of mixed ones."""
    docs = table(spark, sf, "documents")
    return language_cases(docs, "doc_id", "text", "lang", fit_scores(docs, "doc_id", "text", "lang")).select("doc_id", "kind", "lang")


def p10_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of one language, with offsets and confidence."""
    docs = table(spark, sf, "documents")
    return language_stretches(docs, "doc_id", "text", fit_scores(docs, "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_unmatched, p4_found, p4_groups, p5_found, p7_found, p7_record, p8_ids, p9_mix, p9_shares, p10_found, p10_stretches)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
