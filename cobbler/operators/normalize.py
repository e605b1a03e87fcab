"""Parsed listings to normalized ones: sizes on the EU scale, prices in minor units, names in one form.

Listings and their sizes stay in long form, so a listing of any number of size rows is one group of an
aggregation with constant memory.  What can't be stored is not dropped: it comes out with an ``error``.

Defined results.  A null or unreadable price, and a listing without a readable EU size, are errors.  A
size row without a readable EU size is left out.  Of several rows of one EU size the first in stock
gives label, barcode and US and UK sizes, else the first.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.functions.money import parse_price
from cobbler.functions.size import convert_size, parse_eu_size
from cobbler.functions.text import search_text, slugify
from cobbler.functions.titles import BRAND_NAMES, cleaned_models


def number_or_null(raw: Column | str) -> Column:
    """decimal(4,1) of a label that is a number of one or two digits with one decimal at most."""
    c = F.regexp_replace(F.trim(F.col(raw) if isinstance(raw, str) else raw), "^([^,]*),", "$1.")
    return F.when(c.rlike(r"^\d{1,2}(\.\d)?$"), c.try_cast("decimal(4,1)"))


def shown_brand(brand: Column | str) -> Column:
    """The one name a brand is stored under."""
    b = F.col(brand) if isinstance(brand, str) else brand
    names = F.create_map(*[F.lit(x) for pair in BRAND_NAMES.items() for x in pair])
    return F.when(b != "", F.coalesce(names[search_text(b)], b)).otherwise(b)


def normalized_sizes(sizes: DataFrame, offers: DataFrame) -> DataFrame:
    """(offer_id, size_eu, size_raw, size_us, size_uk, in_stock, gtin), one row for each EU size of a listing.

    ``sizes``: offer_id, position, raw, eu_raw, us_raw, uk_raw, in_stock, gtin; ``offers``: offer_id, brand, gender.
    The shop's own US and UK sizes go before converted ones; conversion knows the brand as the shop wrote it.
    """
    read = sizes.withColumn("size_eu", parse_eu_size("eu_raw")).where("size_eu is not null")
    stocked = F.coalesce("in_stock", F.lit(False))
    first = F.min_by(F.struct("raw", "us_raw", "uk_raw", "gtin"), F.struct(~stocked, F.col("position")))
    merged = read.groupBy("offer_id", "size_eu").agg(F.bool_or(stocked).alias("in_stock"), first.alias("f"))
    d = merged.join(offers.select("offer_id", "brand", "gender"), "offer_id", "left").withColumn("c", convert_size("size_eu", "gender", "brand"))
    own = lambda k: F.coalesce(number_or_null(F.col(f"f.{k}_raw")), F.col(f"c.{k}")).alias(f"size_{k}")
    return d.select("offer_id", "size_eu", F.col("f.raw").alias("size_raw"), own("us"), own("uk"), "in_stock", F.col("f.gtin").alias("gtin"))


def normalized_offers(offers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(offer_id, brand, model, slug, price, original_price, in_stock, search_doc, error) of each parsed listing.

    ``offers``: offer_id, title, brand, sku, price_raw, original_price_raw; ``sizes`` as ``normalized_sizes`` gives them.
    """
    stock = sizes.groupBy("offer_id").agg(F.bool_or("in_stock").alias("in_stock"))
    d = offers.withColumns({"price": parse_price(F.col("price_raw")), "old": parse_price(F.col("original_price_raw")), "model": cleaned_models(F.col("title"), F.col("brand")), "shown": shown_brand("brand")}).join(stock, "offer_id", "left")
    error = F.when(F.col("price").isNull(), "no price").when(F.col("in_stock").isNull(), "no sizes")
    kept = lambda *c: F.concat_ws(" ", *[F.nullif(F.col(x), F.lit("")) for x in c])
    return d.select(
        "offer_id", F.col("shown").alias("brand"), "model", slugify(kept("shown", "model")).alias("slug"), "price", F.when(F.col("old") > F.col("price"), F.col("old")).alias("original_price"),
        F.coalesce("in_stock", F.lit(False)).alias("in_stock"), search_text(kept("shown", "model", "sku")).alias("search_doc"), error.alias("error"),
    )
