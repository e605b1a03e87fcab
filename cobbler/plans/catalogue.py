"""The catalogue's relations as lazily planned DataFrames over the tables of a folder.

offer, offer_size, product and price_point are projections of the listing tables; a product is what
shares one manufacturer code, and its id the smallest listing id with that code.  Folded columns are
made here once, so that both sides of every comparison read the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobbler.functions.text import family_key
from cobbler.sources.tables import table

#: Fixed value: what a manufacturer's code with its colour suffix looks like once separators are gone.
CODE = r"([A-Z]{3}[0-9]{7})$"


@dataclass(frozen=True)
class Catalogue:
    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def shop(self) -> DataFrame:
        return self.raw("shop").select("shop_id", F.col("slug").alias("shop_slug"), "shop_name", F.col("is_active").alias("active"))

    @cached_property
    def coded(self) -> DataFrame:
        """Listings with their manufacturer code ('' for none)."""
        code = F.coalesce(F.regexp_extract(F.upper(F.regexp_replace("sku", "[^A-Za-z0-9]", "")), CODE, 1), F.lit(""))
        return self.raw("normalized_offer").select(
            "offer_id", "shop_id", "external_id", "url", "title", F.col("brand").alias("raw_brand"), "model", "sku", "gender", "image_url",
            F.col("price_minor").alias("price"), F.col("original_price_minor").alias("old_price"), "currency", "in_stock", "first_seen_at", "last_seen_at", code.alias("code"),
        )

    @cached_property
    def product(self) -> DataFrame:
        """One row per code; brand and model are those of the listing with the shortest model, then the lowest id."""
        lead = F.struct(F.length("model"), F.col("offer_id"))
        c = self.coded.where("code <> '' and model is not null")
        out = c.groupBy("code").agg(F.min("offer_id").alias("product_id"), F.min_by(F.struct("raw_brand", "model"), lead).alias("lead"))
        return out.select("code", "product_id", F.col("lead.raw_brand").alias("brand_name"), F.col("lead.model").alias("product_model")).withColumn("family", family_key("brand_name", "product_model"))

    @cached_property
    def offer(self) -> DataFrame:
        """Listings with the product they belong to and the group they count as."""
        # listings without a code would all meet at one join key
        plain = self.product.columns[1:]
        with_code = self.coded.where("code <> ''").join(self.product, "code", "left")
        o = with_code.unionByName(self.coded.where("code = ''").select("*", *[F.lit(None).cast(self.product.schema[c].dataType).alias(c) for c in plain]))
        group = F.coalesce(F.concat(F.lit("p"), F.col("product_id").cast("string")), F.concat(F.lit("o"), F.col("offer_id").cast("string")))
        name = F.coalesce("product_model", "title")
        return o.withColumns({"group_key": group, "name": name, "brand": F.coalesce("brand_name", "raw_brand")})

    @cached_property
    def offer_size(self) -> DataFrame:
        """One row per listing and EU size in range; in stock if any of its rows is."""
        s = self.raw("normalized_size").where("size_eu between 15 and 52")
        return s.groupBy("offer_id", "size_eu").agg(F.bool_or("in_stock").alias("size_in_stock"))

    @cached_property
    def stocked(self) -> DataFrame:
        """(offer_id, size_eu) of in-stock rows, repeats and all: enough for existence and sets, without an aggregation."""
        return self.raw("normalized_size").where("in_stock and size_eu between 15 and 52").select("offer_id", "size_eu")

    @cached_property
    def live(self) -> DataFrame:
        """In-stock listings of active shops."""
        return self.offer.where("in_stock").join(self.shop.where("active"), "shop_id")

    @cached_property
    def sold(self) -> DataFrame:
        """In-stock listings of active shops, for what needs no product."""
        return self.coded.where("in_stock").join(self.shop.where("active"), "shop_id")


#: The same relations in SQL, as common table expressions for the queries' checks.
def catalogue_sql(fold_lower) -> str:
    fam = f"trim(regexp_replace({fold_lower("coalesce(lead.b, '') || ' ' || lead.m")}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"""
shops AS (SELECT shop_id, slug AS shop_slug, shop_name, is_active AS active FROM shop),
coded AS (
  SELECT offer_id, shop_id, external_id, url, title, brand AS raw_brand, model, sku, gender, image_url, price_minor AS price,
    original_price_minor AS old_price, currency, in_stock, first_seen_at, last_seen_at,
    coalesce(regexp_extract(upper(regexp_replace(sku, '[^A-Za-z0-9]', '', 'g')), '{CODE}', 1), '') AS code
  FROM normalized_offer),
lead_row AS (
  SELECT code, min(offer_id) AS product_id, arg_min(struct_pack(b := raw_brand, m := model), (length(model), offer_id)) AS lead
  FROM coded WHERE code <> '' AND model IS NOT NULL GROUP BY code),
product AS (SELECT code, product_id, lead.b AS brand_name, lead.m AS product_model, {fam} AS family FROM lead_row),
offer AS (
  SELECT c.*, p.product_id, p.brand_name, p.product_model, p.family,
    coalesce('p' || p.product_id, 'o' || c.offer_id) AS group_key, coalesce(p.product_model, c.title) AS name, coalesce(p.brand_name, c.raw_brand) AS brand
  FROM coded c LEFT JOIN product p USING (code)),
offer_size AS (SELECT offer_id, size_eu, bool_or(in_stock) AS size_in_stock FROM normalized_size WHERE size_eu BETWEEN 15 AND 52 GROUP BY ALL),
live AS (SELECT o.*, s.shop_slug, s.shop_name FROM offer o JOIN shops s ON s.shop_id = o.shop_id AND s.active WHERE o.in_stock)
"""
