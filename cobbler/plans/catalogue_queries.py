"""Queries of the catalogue operators, each beside SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobbler.functions.text import BLANK, DOUBLE, FOLDED, MARKED, TYPED, TYPOGRAPHIC, _upper_folded, fold_diacritics, fold_lower, folded, search_text, slugify, spaced, words
from cobbler.functions.trigram import similarity, text_similarity, word_similarity
from cobbler.operators import search as S
from cobbler.plans.catalogue import Catalogue, catalogue_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Catalogue], DataFrame]], Callable[[Catalogue], DataFrame]]:
    """Registers a function of a catalogue under its name, with its SQL."""

    def keep(f: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(Catalogue(spark, sf))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- SQL for the folds ------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fl(x: str) -> str:
    out = f"translate(lower({x}), {_q(MARKED + TYPOGRAPHIC)}, {_q(FOLDED + TYPED)})"
    for a, b in DOUBLE.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


def fd(x: str) -> str:
    return f"regexp_replace({fl(x)}, '[^a-z0-9]+', '', 'g')"


def wd(x: str) -> str:
    return f"trim(regexp_replace({fl(x)}, '[^a-z0-9]+', ' ', 'g'))"


def sp(x: str) -> str:
    return f"regexp_replace({fl(x)}, '[^a-z0-9]', ' ', 'g')"


def tri(x: str) -> str:
    """Ordered trigrams of each run."""
    return f"flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+') if w <> ''])"


def sim(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({tri(a)}, {tri(b)}))::double / nullif(len(list_distinct(list_concat({tri(a)}, {tri(b)}))), 0), 0)"


BASE = catalogue_sql(fl)
GROUP = """
grouped AS (
  SELECT group_key, min(price) AS min_price, max(price) AS max_price, count(DISTINCT shop_id) AS shop_count, min(first_seen_at) AS first_seen,
    max(CASE WHEN old_price > price THEN (old_price - price)::double / old_price ELSE 0 END) AS best_discount,
    arg_min(struct_pack(offer_id := offer_id, name := name, brand := brand, price := price, old_price := old_price, title := title, brand_name := brand_name, product_model := product_model), (price, offer_id)) AS face
  FROM cand GROUP BY group_key)"""
CARD = """SELECT group_key, face.offer_id AS offer_id, face.name AS name, face.brand AS brand, min_price, max_price, shop_count,
  CASE WHEN face.old_price > face.price THEN round((face.old_price - face.price)::double / face.old_price * 100)::int END AS discount_percent"""
ADULT = "offer_id IN (SELECT offer_id FROM offer_size WHERE size_in_stock AND size_eu >= 36)"
TAIL = "min_price, shop_count DESC, group_key"


def search_sql(where: str = "true", order: str = f"first_seen DESC NULLS LAST, {TAIL}", kids: bool = False, limit: str = "LIMIT 48") -> str:
    return f"WITH {BASE}, cand AS (SELECT * FROM live WHERE ({where}){'' if kids else f' AND {ADULT}'}), {GROUP} {CARD} FROM grouped ORDER BY {order} {limit}"


def sized(cond: str) -> str:
    return f"offer_id IN (SELECT offer_id FROM offer_size WHERE size_in_stock AND ({cond}))"


def _search(name: str, p: S.Search, sql: str) -> None:
    def run(cat: Catalogue) -> DataFrame:
        return S.search(cat, p)

    run.__name__ = name
    query(sql)(run)


# --- search -----------------------------------------------------------------------------------

_search("search_size44_cheapest", S.Search(sizes=(44.0,), sort="cheapest"), search_sql(sized("size_eu >= 44 AND size_eu < 45"), TAIL))
_search("search_fractional_size", S.Search(sizes=(42.5,), sort="cheapest"), search_sql(sized("size_eu = 42.5"), TAIL))
_search("search_multi_size", S.Search(sizes=(41.0, 44.67), sort="cheapest"), search_sql(sized("size_eu >= 41 AND size_eu < 42 OR size_eu = 44.67"), TAIL))
_search("search_adults_only", S.Search(sort="cheapest"), search_sql("true", TAIL))
_search("search_kids_included", S.Search(sort="cheapest", kids=True), search_sql("true", TAIL, kids=True))
_search("search_small_size_means_kids", S.Search(sizes=(30.0,), sort="cheapest"), search_sql(sized("size_eu >= 30 AND size_eu < 31"), TAIL, kids=True))
_search("search_sale", S.Search(on_sale=True, sort="cheapest"), search_sql("old_price > price", TAIL))
_search("search_shop_in", S.Search(shops=("peta-noder", "djon-patu", "hodaj-zomon"), sort="cheapest"), search_sql("shop_slug IN ('peta-noder', 'djon-patu', 'hodaj-zomon')", TAIL))
_search("search_brand_folded", S.Search(brands=("SKEKE sport", "tilkison"), sort="cheapest"), search_sql(f"{fl('raw_brand')} IN ('skeke sport', 'tilkison')", TAIL))
_search("search_gender_null_kept", S.Search(genders=("women",), sort="cheapest"), search_sql("gender IS NULL OR gender IN ('women')", TAIL))
_search("search_tokens", S.Search(query="Skeke-Sport pro", sort="cheapest"), search_sql(f"contains({fd('title')}, 'skekesport') AND contains({fd('title')}, 'pro')", TAIL))
_search("search_sort_newest", S.Search(), search_sql())
_search("search_sort_dearest", S.Search(sort="dearest"), search_sql(order="min_price DESC, group_key"))
_search("search_sort_discount", S.Search(sort="discount"), search_sql(order=f"best_discount DESC, {TAIL}"))
_search("search_sort_alphabetical", S.Search(sort="alphabetical"), search_sql(order=f"{fl('face.name')} NULLS LAST, {TAIL}"))
_kept = lambda x: f"regexp_replace({fl(x)}, '[^a-z0-9 ]', '', 'g')"
_scored_name = f"trim(replace(' ' || {_kept("coalesce(nullif(trim(coalesce(face.brand_name, '') || ' ' || coalesce(face.product_model, '')), ''), face.title)")} || ' ', ' patike ', ' '))"
_search(
    "search_sort_relevance",
    S.Search(query="skeke sport runner"),
    search_sql(
        " AND ".join(f"contains({fd('title')}, '{t}')" for t in ("skeke", "sport", "runner")),
        f"CASE WHEN {fd("coalesce(face.product_model, '')")} = 'skekesportrunner' OR {fd("coalesce(face.brand_name, '') || coalesce(face.product_model, '')")} = 'skekesportrunner' THEN 0 ELSE 1 END, round({sim(_scored_name, _q('skeke sport runner'))}, 1) DESC, {TAIL}",
    ),
)
_search("search_page_deep", S.Search(sort="cheapest", page=9), search_sql("true", TAIL, limit="LIMIT 48 OFFSET 384"))
_search("search_fuzzy_title", S.Search(query="skekee sprt", fuzzy=True, sort="cheapest"), None)

_first_family = "(SELECT family FROM product WHERE product_id = (SELECT min(product_id) FROM product))"


@query(search_sql(f"family = {_first_family}", TAIL, kids=True))
def search_model_family(cat: Catalogue) -> DataFrame:
    """All colours of the family of the first product, whatever the sizes."""
    return S.search(cat, S.Search(family=_first(cat).select("family"), kids=True, sort="cheapest"))


def _first(cat: Catalogue) -> DataFrame:
    """The product of least id, one row."""
    return cat.product.agg(F.min_by(F.struct("family", "product_id"), "product_id").alias("f")).select("f.*")


@query(search_sql(f"family = {_first_family} AND (product_id IS NULL OR product_id <> (SELECT min(product_id) FROM product))", TAIL, kids=True))
def search_exclude_product(cat: Catalogue) -> DataFrame:
    """The other colours of that family."""
    first = _first(cat)
    return S.search(cat, S.Search(family=first.select("family"), without_product=first.select("product_id"), kids=True, sort="cheapest"))


@query(f"WITH {BASE}, cand AS (SELECT * FROM live WHERE {ADULT}) SELECT count(DISTINCT group_key) AS total FROM cand")
def search_total(cat: Catalogue) -> DataFrame:
    return S.total(cat, S.Search())


_LISTS = f"""WITH {BASE}, cand AS (SELECT * FROM live WHERE {sized('size_eu >= 44 AND size_eu < 45')} AND {ADULT}), {GROUP},
page AS (SELECT * FROM grouped ORDER BY {TAIL} LIMIT 48),
member AS (SELECT c.* FROM cand c JOIN page USING (group_key))"""


def _listed(cat: Catalogue) -> DataFrame:
    p = S.Search(sizes=(44.0,), sort="cheapest")
    cand = S.candidates(cat, p)
    return S.with_lists(cat, S.page(S.grouped(cand), p), cand)


@query(f"{_LISTS} SELECT group_key, string_agg(DISTINCT size_eu::varchar, ',' ORDER BY size_eu::varchar) AS sizes FROM member JOIN offer_size USING (offer_id) WHERE size_in_stock GROUP BY group_key")
def group_sizes(cat: Catalogue) -> DataFrame:
    """In-stock sizes of the groups of a page."""
    return _listed(cat).select("group_key", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


@query(f"{_LISTS}, s AS (SELECT group_key, shop_slug, min(price) AS p FROM member GROUP BY ALL) SELECT group_key, string_agg(shop_slug, ',' ORDER BY p, shop_slug) AS shops FROM s GROUP BY group_key")
def group_shops(cat: Catalogue) -> DataFrame:
    """Shops of the groups of a page, cheapest first."""
    return _listed(cat).select("group_key", F.array_join("shops", ",").alias("shops"))


@query(
    f"""WITH {BASE}, label AS (SELECT {fl('raw_brand')} AS k, arg_min(raw_brand, (raw_brand = upper(raw_brand), raw_brand)) AS label FROM offer WHERE raw_brand IS NOT NULL GROUP BY 1),
    c AS (SELECT {fl('raw_brand')} AS k, count(DISTINCT group_key) AS groups FROM live WHERE raw_brand IS NOT NULL AND old_price > price AND {ADULT} GROUP BY 1) SELECT label, groups FROM c JOIN label USING (k)"""
)
def facet_brands(cat: Catalogue) -> DataFrame:
    return S.facet_brands(cat, S.Search(brands=("Skeke Sport",), on_sale=True))


@query(
    f"""WITH {BASE}, label AS (SELECT {fl('raw_brand')} AS k, arg_min(raw_brand, (raw_brand = upper(raw_brand), raw_brand)) AS label FROM offer WHERE raw_brand IS NOT NULL GROUP BY 1),
    c AS (SELECT {fl('raw_brand')} AS k, count(DISTINCT group_key) AS groups FROM live WHERE raw_brand IS NOT NULL AND old_price > price AND {ADULT} GROUP BY 1),
    f AS (SELECT label, k, groups FROM c JOIN label USING (k) UNION ALL SELECT v, {fl('v')}, 0 FROM (VALUES ('Skeke Sport'), ('No Such Brand')) t(v) WHERE {fl('v')} NOT IN (SELECT k FROM c))
    SELECT label, groups, row_number() OVER (ORDER BY k NOT IN ('skeke sport', 'no such brand'), groups DESC, label) AS place FROM f QUALIFY place <= 30"""
)
def facet_chips(cat: Catalogue) -> DataFrame:
    """The first thirty brand chips (a top-k report): chosen ones first, also those that nothing matches."""
    chips = S.brand_chips(S.facet_brands(cat, S.Search(on_sale=True)), ["Skeke Sport", "No Such Brand"], 30)
    return chips.select("label", "groups", "place")


@query(f"WITH {BASE} SELECT DISTINCT size_eu FROM live JOIN offer_size USING (offer_id) WHERE size_in_stock")
def available_sizes(cat: Catalogue) -> DataFrame:
    return cat.sold.select("offer_id").join(cat.stocked, "offer_id").select("size_eu").distinct()


@query(f"WITH {BASE} SELECT shop_slug, shop_name FROM shops WHERE active AND shop_id IN (SELECT shop_id FROM offer WHERE in_stock)")
def available_shops(cat: Catalogue) -> DataFrame:
    return cat.shop.where("active").join(cat.coded.where("in_stock").select("shop_id"), "shop_id", "left_semi").select("shop_slug", "shop_name")


@query(
    f"""WITH {BASE}, s AS (SELECT offer_id, string_agg(size_eu::varchar, ',' ORDER BY size_eu) AS sizes FROM offer_size WHERE size_in_stock GROUP BY 1)
    SELECT product_id, offer_id, shop_slug, price, coalesce(sizes, '') AS sizes, row_number() OVER (PARTITION BY product_id ORDER BY price, shop_slug, offer_id) AS place
    FROM live LEFT JOIN s USING (offer_id) WHERE product_id IS NOT NULL"""
)
def product_offers(cat: Catalogue) -> DataFrame:
    """Every product's listings, cheapest first, with their sizes."""
    from pyspark.sql import Window

    sizes = cat.offer_size.where("size_in_stock").groupBy("offer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("size_eu")), lambda x: x.cast("string")), ",").alias("sizes"))
    w = Window.partitionBy("product_id").orderBy("price", "shop_slug", "offer_id")
    d = cat.live.where("product_id is not null").join(sizes, "offer_id", "left")
    return d.select("product_id", "offer_id", "shop_slug", "price", F.coalesce("sizes", F.lit("")).alias("sizes"), F.row_number().over(w).alias("place"))


@query(f"WITH {BASE} SELECT product_id, max(price) - min(price) AS spread, arg_min(offer_id, (price, offer_id)) AS cheapest, arg_max(offer_id, (price, offer_id)) AS dearest, max(last_seen_at) AS checked_at FROM live WHERE product_id IS NOT NULL GROUP BY 1")
def product_spread(cat: Catalogue) -> DataFrame:
    key = F.struct("price", "offer_id")
    return cat.live.where("product_id is not null").groupBy("product_id").agg((F.max("price") - F.min("price")).alias("spread"), F.min_by("offer_id", key).alias("cheapest"), F.max_by("offer_id", key).alias("dearest"), F.max("last_seen_at").alias("checked_at"))


@query(f"WITH {BASE} SELECT p.product_id, count(l.offer_id) AS offers, min(l.price) AS min_price FROM product p LEFT JOIN live l ON l.product_id = p.product_id GROUP BY 1")
def product_stock(cat: Catalogue) -> DataFrame:
    """Every product with its listings in stock; one that nobody has still returns."""
    return cat.product.select("product_id").join(cat.live.select("product_id", "offer_id", "price"), "product_id", "left").groupBy("product_id").agg(F.count("offer_id").alias("offers"), F.min("price").alias("min_price"))


_scored = wd("coalesce(brand_name, '') || ' ' || product_model")


@query(
    f"""WITH {BASE}, s AS (SELECT *, {sim(_scored, _q('runner 5'))} AS sc FROM live WHERE product_id IS NOT NULL AND product_model <> '' AND contains(replace(family, '-', ''), 'runner') AND contains(replace(family, '-', ''), '5'))
    SELECT family, min(brand_name) AS brand, arg_min(product_model, (length(product_model), product_model)) AS model, count(DISTINCT product_id) AS colourways, count(DISTINCT shop_id) AS shops, max(sc) AS score
    FROM s GROUP BY family ORDER BY score DESC, colourways DESC, model, family LIMIT 8"""
)
def suggest_exact(cat: Catalogue) -> DataFrame:
    return S.suggestions(cat, "runner 5")


@query()
def suggest_fuzzy(cat: Catalogue) -> DataFrame:
    return S.suggestions(cat, "runer skekke", fuzzy=True)


# --- text -------------------------------------------------------------------------------------


@query(f"SELECT offer_id, {fl('title')} AS lowered, {fd('title')} AS folded, {wd('title')} AS words, {sp('title')} AS spaced, replace({wd('title')}, ' ', '-') AS slug FROM normalized_offer")
def fold_text(cat: Catalogue) -> DataFrame:
    return cat.coded.select("offer_id", fold_lower("title").alias("lowered"), folded("title").alias("folded"), words("title").alias("words"), spaced("title").alias("spaced"), slugify("title").alias("slug"))


@query(f"WITH {BASE} SELECT code, product_id, family FROM product")
def family_keys(cat: Catalogue) -> DataFrame:
    return cat.product.select("code", "product_id", "family")


@query(f"SELECT offer_id, {sim('title', 'search_doc')} AS score FROM normalized_offer")
def trgm_similarity(cat: Catalogue) -> DataFrame:
    return cat.raw("normalized_offer").select("offer_id", similarity("title", "search_doc").alias("score"))


def _whole(x: str) -> str:
    return f"[substr('  ' || {x} || ' ', i, 3) for i in range(1, length({x}) + 2)]"


_t, _m = (f"trim(regexp_replace({fl(c)}, '{BLANK}+', ' ', 'g'))" for c in ("title", "model"))


@query(f"SELECT offer_id, coalesce(len(list_intersect({_whole(_t)}, {_whole(_m)}))::double / nullif(len(list_distinct(list_concat({_whole(_t)}, {_whole(_m)}))), 0), 0) AS score FROM normalized_offer WHERE title IS NOT NULL AND model IS NOT NULL")
def domain_similarity(cat: Catalogue) -> DataFrame:
    """Whole-text trigrams, punctuation kept."""
    return cat.coded.where("title is not null and model is not null").select("offer_id", text_similarity(search_text("title"), search_text("model")).alias("score"))


@query()
def trgm_word_similarity(cat: Catalogue) -> DataFrame:
    """The best stretch of every title for a query; null without a title."""
    return cat.coded.select("offer_id", word_similarity(F.lit("dratundo"), words("title")).alias("score"))


def _fold_case(x: str) -> str:
    out = f"translate({x}, {_q(MARKED + MARKED.replace('ı', '').upper())}, {_q(FOLDED + _upper_folded())})"
    for a, b in DOUBLE.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


@query(f"SELECT offer_id, {_fold_case('brand')} AS plain FROM normalized_offer WHERE brand IS NOT NULL")
def fold_brand_case(cat: Catalogue) -> DataFrame:
    """Accents of every brand dropped with the case kept."""
    return cat.coded.where("raw_brand is not null").select("offer_id", fold_diacritics("raw_brand").alias("plain"))


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    from cobbler.plans import domain_queries, rebuild_queries  # noqa: F401  register their own

    return QUERIES, SQL


def queries() -> dict[str, Query]:
    return dict(_all()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_all()[1])
