"""Size-first search over the catalogue: filters before grouping, the page before its lists.

Filters apply to listings; groups (a product, or a listing without one) are counted and sorted; only
the page's groups get their size and shop lists.  The total is its own scalar aggregate, so no
unpartitioned window is needed.  Shops are a small fixed table that Catalyst broadcasts by its size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobbler.functions.text import fold_lower, folded, spaced, words
from cobbler.functions.trigram import similarity, word_similarity
from cobbler.plans.catalogue import Catalogue
from cobbler.plans.durable import written

PAGE = 48
#: Word similarity from which the second, typo-tolerant pass accepts a title.
FUZZY = 0.4
KIDS_BELOW = 36


# Names of the parameters in an address, the orders and audiences they may name, and the sizes they may give.
PARAMETERS = {"sizes": "velicina", "query": "q", "brands": "brend", "shops": "prodavnica", "genders": "pol", "on_sale": "akcija", "sort": "sort", "page": "strana"}
SORTS = {"najnovije": "newest", "najjeftinije": "cheapest", "najskuplje": "dearest", "snizenje": "discount", "abecedno": "alphabetical"}
AUDIENCES, SIZE_RANGE = ("men", "women", "unisex", "kids"), (15, 52)


@dataclass(frozen=True)
class Search:
    sizes: tuple[float, ...] = ()
    query: str = ""
    brands: tuple[str, ...] = ()
    shops: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    on_sale: bool = False
    family: str | DataFrame | None = None
    without_product: int | DataFrame | None = None
    kids: bool = False
    fuzzy: bool = False
    sort: str | None = None
    page: int = 1
    limit: int = PAGE

    @classmethod
    def from_parameters(cls, given: dict[str, str]) -> Search:
        """A search by the parameters of an address; what is no value of a parameter is left out."""
        said = {k: (given.get(name) or "").strip() for k, name in PARAMETERS.items()}
        listed = lambda k: tuple(dict.fromkeys(x.strip() for x in said[k].split(",") if x.strip()))
        sizes = {float(x) for x in listed("sizes") if re.fullmatch(r"\d{1,2}(\.\d{1,2})?", x)}
        page = int(said["page"]) if re.fullmatch(r"\d{1,9}", said["page"]) else 1
        return cls(
            sizes=tuple(sorted(x for x in sizes if SIZE_RANGE[0] <= x <= SIZE_RANGE[1])), query=said["query"], brands=listed("brands"), shops=listed("shops"),
            genders=tuple(g for g in listed("genders") if g in AUDIENCES), on_sale=said["on_sale"] == "1", sort=SORTS.get(said["sort"]), page=max(1, page),
        )

    @property
    def wants_kids(self) -> bool:
        return self.kids or "kids" in self.genders or any(s < KIDS_BELOW for s in self.sizes)

    @property
    def tokens(self) -> list[str]:
        return [t for t in self.query.split() if t]


def size_condition(sizes: tuple[float, ...], col: str = "size_eu") -> Column:
    """A whole size takes in its halves and thirds, a fraction only itself."""
    dec = lambda x: F.lit(f"{x:.2f}").cast("decimal(4,2)")
    one = lambda s: (F.col(col) >= dec(s)) & (F.col(col) < dec(s + 1)) if float(s).is_integer() else F.col(col) == dec(s)
    return reduce(lambda a, b: a | b, map(one, sizes))


def _folded_literals(values: list[str]) -> Column:
    return F.array(*[folded(F.lit(v)) for v in values])


def candidates(cat: Catalogue, p: Search) -> DataFrame:
    """The listings that pass every filter; family and product may be given as frames of one row."""
    d = cat.live
    sizes = cat.stocked
    if p.on_sale:
        d = d.where("old_price > price")
    if p.shops:
        d = d.where(F.col("shop_slug").isin(list(p.shops)))
    if p.genders:
        d = d.where(F.col("gender").isNull() | F.col("gender").isin(list(p.genders)))
    if p.brands:
        d = d.where(F.array_contains(F.array(*[fold_lower(F.lit(b)) for b in p.brands]), fold_lower("raw_brand")))
    if isinstance(p.family, DataFrame):
        d = d.join(F.broadcast(p.family.toDF("family")), "family", "left_semi")
    elif p.family is not None:
        d = d.where(F.col("family") == p.family)
    if isinstance(p.without_product, DataFrame):
        d = d.join(F.broadcast(p.without_product.toDF("product_id")), "product_id", "left_anti")
    elif p.without_product is not None:
        d = d.where(F.col("product_id").isNull() | (F.col("product_id") != p.without_product))
    if p.fuzzy:
        d = d.where(word_similarity(words(F.lit(p.query)), spaced("title")) >= FUZZY)
    elif p.tokens:
        title = folded("title")
        d = d.where(reduce(lambda a, b: a & b, [F.contains(title, folded(F.lit(t))) for t in p.tokens]))
    if p.sizes:
        d = d.join(sizes.where(size_condition(p.sizes)).select("offer_id"), "offer_id", "left_semi")
    elif not p.wants_kids:  # chosen sizes are adults' sizes here, or kids would be wanted
        d = d.join(sizes.where(F.col("size_eu") >= KIDS_BELOW).select("offer_id"), "offer_id", "left_semi")
    return d


def grouped(cand: DataFrame) -> DataFrame:
    """One row per group, with the cheapest listing as its face."""
    dec = lambda c: F.col(c).cast("decimal(12,0)")
    none = F.lit("0").cast("decimal(25,13)")
    discount = F.when(F.col("old_price") > F.col("price"), (dec("old_price") - dec("price")) / dec("old_price")).otherwise(none)
    face = F.struct("offer_id", "title", "name", "brand", "price", "old_price", "image_url", "product_id", "brand_name", "product_model")
    return cand.groupBy("group_key").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count_distinct("shop_id").alias("shop_count"), F.min("first_seen_at").alias("first_seen"),
        F.max(discount).alias("best_discount"), F.min_by(face, F.struct("price", "offer_id")).alias("face"),
    )


def _order(p: Search) -> list[Column]:
    tail = [F.col("min_price").asc(), F.col("shop_count").desc(), F.col("group_key").asc()]
    kind = p.sort or ("relevance" if p.query else "newest")
    if kind == "cheapest":
        return tail
    if kind == "dearest":
        return [F.col("min_price").desc(), F.col("group_key").asc()]
    if kind == "alphabetical":
        return [fold_lower("face.name").asc_nulls_last(), *tail]
    if kind == "discount":
        return [F.col("best_discount").desc(), *tail]
    if kind == "newest":
        return [F.col("first_seen").desc_nulls_last(), *tail]
    asked = F.lit(p.query)
    brand, model = (F.coalesce(F.col(f"face.{c}"), F.lit("")) for c in ("brand_name", "product_model"))
    # separators count for nothing when names are compared as a whole
    exact = (folded(model) == folded(asked)) | (folded(F.concat(brand, model)) == folded(asked))
    return [F.when(exact, 0).otherwise(1).asc(), F.round(similarity(scored_name("face"), kept_words(asked)), 1).desc(), *tail]


def kept_words(x: Column) -> Column:
    """The folded text with its letters, digits and blanks; other signs leave nothing behind."""
    return F.regexp_replace(fold_lower(x), "[^a-z0-9 ]", "")


#: Fixed value: the word for the goods that shops put into titles.
GOODS_WORD = " patike "


def scored_name(face: str) -> Column:
    """What a result is called when it is scored: the product's brand and model, else the listing's title without the word for the goods."""
    product = F.btrim(F.concat_ws(" ", F.coalesce(F.col(f"{face}.brand_name"), F.lit("")), F.coalesce(F.col(f"{face}.product_model"), F.lit(""))))
    said = F.when(product != "", product).otherwise(F.col(f"{face}.title"))
    return F.btrim(F.replace(F.concat(F.lit(" "), kept_words(said), F.lit(" ")), F.lit(GOODS_WORD), F.lit(" ")))


def page(groups: DataFrame, p: Search) -> DataFrame:
    """The groups of one page; sort and limit become one top-k step."""
    out = groups.orderBy(*_order(p))
    return (out.offset((p.page - 1) * p.limit) if p.page > 1 else out).limit(p.limit)


def with_lists(cat: Catalogue, pages: DataFrame, cand: DataFrame) -> DataFrame:
    """Sizes ascending and shops by their cheapest listing, of the page's groups only; the page and its members are found once."""
    pages = written(pages, "page")
    members = written(cand.select("group_key", "offer_id", "shop_slug", "price").join(pages.select("group_key"), "group_key", "left_semi"), "members")
    sizes = members.join(cat.stocked, "offer_id").groupBy("group_key").agg(F.array_sort(F.collect_set("size_eu")).alias("sizes"))
    shops = members.groupBy("group_key", "shop_slug").agg(F.min("price").alias("p")).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("p", "shop_slug"))).alias("s"))
    shops = shops.select("group_key", F.transform("s", lambda x: x["shop_slug"]).alias("shops"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = pages.join(sizes, "group_key", "left").join(shops, "group_key", "left")
    return out.withColumns({"sizes": none(F.col("sizes"), "array<decimal(4,2)>"), "shops": none(F.col("shops"), "array<string>")})


def card(groups: DataFrame) -> DataFrame:
    """The columns of a result card."""
    on_sale = F.col("face.old_price") > F.col("face.price")
    percent = F.when(on_sale, F.round((F.col("face.old_price") - F.col("face.price")) / F.col("face.old_price") * 100, 0).cast("int"))
    return groups.select("group_key", F.col("face.offer_id").alias("offer_id"), F.col("face.name").alias("name"), F.col("face.brand").alias("brand"), "min_price", "max_price", "shop_count", percent.alias("discount_percent"))


def search(cat: Catalogue, p: Search) -> DataFrame:
    """One page of cards."""
    return card(page(grouped(candidates(cat, p)), p))


def total(cat: Catalogue, p: Search) -> DataFrame:
    """Groups in all, whatever the page."""
    return candidates(cat, p).agg(F.count_distinct("group_key").alias("total"))


def facet_brands(cat: Catalogue, p: Search) -> DataFrame:
    """Groups per brand; the brand's own filter is left out, its label is the least shouting spelling of the whole catalogue."""
    key = fold_lower("raw_brand").alias("brand_key")
    labels = cat.coded.where("raw_brand is not null").select(key, "raw_brand").groupBy("brand_key").agg(F.min_by("raw_brand", F.struct(F.col("raw_brand") == F.upper("raw_brand"), F.col("raw_brand"))).alias("label"))
    counts = candidates(cat, replace(p, brands=())).where("raw_brand is not null").groupBy(key).agg(F.count_distinct("group_key").alias("groups"))
    return counts.join(labels, "brand_key").select("label", "groups")


def brand_chips(facets: DataFrame, chosen: list[str], most: int) -> DataFrame:
    """(label, groups, place) of ``facets`` (label, groups): chosen brands first, with 0 where they are missing, then by groups and label."""
    spark = facets.sparkSession
    key = fold_lower("label")
    picked = spark.createDataFrame([(c, 0) for c in dict.fromkeys(chosen)], "label string, groups long").withColumn("key", key)
    d = facets.withColumn("key", key)
    every = d.unionByName(picked.join(d.select("key"), "key", "left_anti").select(d.columns)).join(F.broadcast(picked.select("key", F.lit(0).alias("picked"))), "key", "left")  # as many as were chosen
    order = [F.coalesce("picked", F.lit(1)), F.col("groups").desc(), F.col("label")]
    top = every.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("label", "groups", "place")


def suggestions(cat: Catalogue, query: str, fuzzy: bool = False, limit: int = 8) -> DataFrame:
    """Model families that match the query, best first; a blank query matches none."""
    live = cat.live.where("product_id is not null and product_model <> ''").select("product_id", "shop_id", "brand_name", "product_model", "family")
    folded_family = F.regexp_replace("family", "-", "")
    if fuzzy:
        keep = word_similarity(words(F.lit(query)), F.regexp_replace("family", "-", " ")) >= FUZZY
    else:
        keep = reduce(lambda a, b: a & b, [F.contains(folded_family, folded(F.lit(t))) for t in query.split()], F.lit(bool(query.split())))
    score = similarity(words(F.concat(F.coalesce("brand_name", F.lit("")), F.lit(" "), F.col("product_model"))), words(F.lit(query)))
    by = live.where(keep).withColumn("score", score).groupBy("family").agg(
        F.min("brand_name").alias("brand"), F.min_by("product_model", F.struct(F.length("product_model"), F.col("product_model"))).alias("model"),
        F.count_distinct("product_id").alias("colourways"), F.count_distinct("shop_id").alias("shops"), F.max("score").alias("score"),
    )
    return by.orderBy(F.col("score").desc(), F.col("colourways").desc(), F.col("model").asc(), F.col("family").asc()).limit(limit)
