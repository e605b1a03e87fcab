"""Queries of the domain functions, histories, keyed writes, matching and page sources, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobbler.functions import display
from cobbler.functions import money as M
from cobbler.functions import size as Z
from cobbler.functions.text import fold_lower, search_text, slugify, words
from cobbler.functions.titles import SYNONYMS, cleaned_models, expanded
from cobbler.operators import matching, upsert, validate
from cobbler.plans.catalogue import Catalogue
from cobbler.plans.catalogue_queries import BASE, fl, query, wd
from cobbler.sources import pages

from cobbler.functions.text import BLANK as _B  # noqa: E402

# --- sizes ------------------------------------------------------------------------------------

_RAW = "trim(regexp_replace(regexp_replace(lower(size_raw), 'eur?\\b|europe|velicina|veličina|br\\.?', '', 'g'), '^([^,]*),', '\\1.'))"
_PARSED = f"""CASE WHEN regexp_full_match({_RAW}, '\\d{{1,2}}[\\s-]\\d/\\d')
  THEN round(regexp_extract({_RAW}, '^(\\d{{1,2}})', 1)::int + regexp_extract({_RAW}, '(\\d)/(\\d)$', 1)::double / nullif(regexp_extract({_RAW}, '(\\d)/(\\d)$', 2)::int, 0), 2)
  WHEN regexp_full_match({_RAW}, '\\d{{1,2}}(\\.\\d)?') AND try_cast({_RAW} AS double) BETWEEN 15 AND 52 THEN try_cast({_RAW} AS double) END::decimal(4,2)"""


@query(f"SELECT size_id, size_raw, {_PARSED} AS eu FROM normalized_size")
def parse_size(cat: Catalogue) -> DataFrame:
    return cat.raw("normalized_size").select("size_id", "size_raw", Z.parse_eu_size("size_raw").alias("eu"))


def _table(rows: list[tuple[float, float, float]], lower: bool = False) -> str:
    return ", ".join(f"({eu}, {us}, {uk - 0.5 * lower})" for eu, us, uk in rows)


_HALF = "CASE WHEN lo.e = hi.e THEN lo.{k} ELSE round((lo.{k} + (s.e - lo.e) / (hi.e - lo.e) * (hi.{k} - lo.{k})) * 2) / 2 END"


@query(
    f"""WITH t(kind, e, us, uk) AS (SELECT 'men', * FROM (VALUES {_table(Z.MEN)}) UNION ALL SELECT 'women', * FROM (VALUES {_table(Z.WOMEN)}) UNION ALL SELECT 'nike', * FROM (VALUES {_table(Z.MEN, True)})),
    s AS (SELECT DISTINCT s.size_eu::double AS e, o.gender, CASE WHEN o.gender = 'women' THEN 'women' ELSE 'men' END AS kind FROM normalized_size s JOIN normalized_offer o USING (offer_id) WHERE size_eu IS NOT NULL),
    b AS (SELECT s.e, s.gender, s.kind, k, max(CASE WHEN t.e <= s.e THEN t.e END) AS lo, min(CASE WHEN t.e >= s.e THEN t.e END) AS hi
      FROM s, (VALUES ('plain'), ('nike')) v(k) JOIN t ON t.kind = CASE WHEN v.k = 'nike' AND coalesce(s.gender, 'men') = 'men' THEN 'nike' ELSE s.kind END GROUP BY ALL),
    c AS (SELECT s.e, s.gender, s.k, {_HALF.format(k='us')} AS us, {_HALF.format(k='uk')} AS uk FROM b s
      LEFT JOIN t lo ON lo.e = s.lo AND lo.kind = CASE WHEN s.k = 'nike' AND coalesce(s.gender, 'men') = 'men' THEN 'nike' ELSE s.kind END
      LEFT JOIN t hi ON hi.e = s.hi AND hi.kind = lo.kind)
    SELECT e AS eu, gender, k AS brand, us::decimal(4,1) AS us, uk::decimal(4,1) AS uk FROM c"""
)
def convert_size(cat: Catalogue) -> DataFrame:
    """US and UK sizes of every EU size and audience, for brands with and without a table of their own."""
    sizes = cat.raw("normalized_size").where("size_eu is not null").select("offer_id", F.col("size_eu").cast("double").alias("eu"))
    d = sizes.join(cat.coded.select("offer_id", "gender"), "offer_id").select("eu", "gender").distinct()
    d = d.select("eu", "gender", F.explode(F.array(F.lit("plain"), F.lit("nike"))).alias("brand"))
    return d.withColumn("c", Z.convert_size("eu", "gender", "brand")).select("eu", "gender", "brand", "c.us", "c.uk")


@query(
    """SELECT DISTINCT size_eu, floor(size_eu)::int || CASE (size_eu * 100)::int % 100 WHEN 0 THEN '' WHEN 50 THEN '½' WHEN 33 THEN '⅓' WHEN 67 THEN '⅔' ELSE substr(printf('%.2f', size_eu::double), -3) END AS shown,
    CASE WHEN size_eu IN (44, 42.5) THEN 'exact' WHEN size_eu > 44 AND size_eu < 45 THEN 'near' END AS match FROM normalized_size WHERE size_eu IS NOT NULL"""
)
def format_size(cat: Catalogue) -> DataFrame:
    return cat.raw("normalized_size").where("size_eu is not null").select("size_eu").distinct().select("size_eu", Z.format_size("size_eu").alias("shown"), Z.size_match("size_eu", [44.0, 42.5]).alias("match"))


@query(
    f"""WITH {BASE}, s AS (SELECT offer_id, list(size_eu::double ORDER BY size_eu) AS l FROM offer_size GROUP BY 1),
    h AS (SELECT offer_id, l, list_slice([x for x in l if x in (41, 42.5) or (x > 41 and x < 42)], 1, 5) AS hits FROM s)
    SELECT offer_id, array_to_string(list_sort(list_concat(hits, list_slice([x for x in l if not list_contains(hits, x)], 1, greatest(0, 5 - len(hits))))), ',') AS chips FROM h"""
)
def size_chips(cat: Catalogue) -> DataFrame:
    """Five sizes of every listing: those that match first, filled up with the smallest."""
    by = cat.offer_size.groupBy("offer_id").agg(F.collect_list("size_eu").alias("s"))
    return by.select("offer_id", F.array_join(F.transform(Z.size_chips("s", [41.0, 42.5], 5), lambda x: x.cast("string")), ",").alias("chips"))


@query(f"WITH {BASE} SELECT size_eu, count(*) AS offers FROM live JOIN offer_size USING (offer_id) WHERE size_in_stock GROUP BY 1 ORDER BY offers DESC, size_eu LIMIT 5")
def size_popularity(cat: Catalogue) -> DataFrame:
    d = cat.sold.select("offer_id").join(cat.offer_size.where("size_in_stock"), "offer_id")
    return d.groupBy("size_eu").agg(F.count("*").alias("offers")).orderBy(F.col("offers").desc(), "size_eu").limit(5)


@query(f"WITH {BASE}, s AS (SELECT DISTINCT product_id, size_eu FROM live JOIN offer_size USING (offer_id) WHERE size_in_stock AND product_id IS NOT NULL) SELECT product_id, size_eu, (SELECT count(*) FROM s b WHERE b.product_id = a.product_id AND b.size_eu < a.size_eu) AS below FROM s a")
def sizes_below(cat: Catalogue) -> DataFrame:
    """How many smaller sizes each size of a product has."""
    from pyspark.sql import Window

    d = cat.live.where("product_id is not null").join(cat.offer_size.where("size_in_stock"), "offer_id").select("product_id", "size_eu").distinct()
    return d.withColumn("below", (F.row_number().over(Window.partitionBy("product_id").orderBy("size_eu")) - 1).cast("long"))


@query(f"WITH {BASE} SELECT product_id, count(DISTINCT shop_id) AS shops, count(*) AS offers FROM live WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT shop_id) > 1 AND max(price) > min(price)")
def multi_shop_products(cat: Catalogue) -> DataFrame:
    by = cat.live.where("product_id is not null").groupBy("product_id").agg(F.count_distinct("shop_id").alias("shops"), F.count("*").alias("offers"), F.max("price").alias("hi"), F.min("price").alias("lo"))
    return by.where("shops > 1 and hi > lo").select("product_id", "shops", "offers")


# --- money and names --------------------------------------------------------------------------

_PRICE = "(price_minor // 100)::varchar || ',' || lpad((price_minor % 100)::varchar, 2, '0')"


@query(f"SELECT offer_id, {_PRICE} || CASE currency WHEN 'BAM' THEN ' KM' WHEN 'EUR' THEN ' €' END AS shown, price_minor::bigint AS read_back, CASE WHEN currency = 'EUR' THEN price_minor::bigint ELSE round(price_minor / 1.95583)::bigint END AS eur, CASE WHEN original_price_minor > price_minor THEN round((original_price_minor - price_minor)::double / original_price_minor * 100)::int END AS off FROM normalized_offer")
def money_round_trip(cat: Catalogue) -> DataFrame:
    """Prices shown, read back from what is shown, in euro cents, and the percent off."""
    shown = M.format_price("price", "currency")
    return cat.coded.select("offer_id", shown.alias("shown"), M.parse_price(shown).alias("read_back"), M.to_eur_minor("price", "currency").alias("eur"), M.discount_percent("price", "old_price").alias("off"))


_SYN = " ".join(f"WHEN '{k}' THEN ['{k}', {', '.join(repr(x) for x in v if x != k)}]" for k, v in SYNONYMS.items())


@query(f"SELECT offer_id, array_to_string(list_distinct(flatten([CASE w {_SYN} ELSE [w] END for w in string_split(trim(regexp_replace({fl('title')}, '{_B}+', ' ', 'g')), ' ') if w <> '']).list_sort()), ' ') AS terms FROM normalized_offer WHERE title IS NOT NULL".replace("list_distinct(flatten(", "list_sort(list_distinct(flatten(").replace("]).list_sort()), ' ')", "]))), ' ')"))
def expand_queries(cat: Catalogue) -> DataFrame:
    """The words of every title with what they also mean, sorted."""
    return cat.coded.where("title is not null").select("offer_id", F.array_join(F.array_sort(expanded("title")), " ").alias("terms"))


@query("SELECT offer_id, CASE WHEN h <> '' THEN h || CASE WHEN t <> '' THEN '-' || t ELSE '' END END AS code FROM (SELECT offer_id, regexp_extract(upper(sku), '\\b([A-Z]{1,3}\\d{4,6})[\\s-]?(\\d{2,3})?\\b', 1) AS h, regexp_extract(upper(sku), '\\b([A-Z]{1,3}\\d{4,6})[\\s-]?(\\d{2,3})?\\b', 2) AS t FROM normalized_offer)")
def style_codes(cat: Catalogue) -> DataFrame:
    p = r"\b([A-Z]{1,3}\d{4,6})[\s-]?(\d{2,3})?\b"
    h, t = (F.regexp_extract(F.upper("sku"), p, k) for k in (1, 2))
    return cat.coded.select("offer_id", F.when(h != "", F.concat(h, F.when(t != "", F.concat(F.lit("-"), t)).otherwise(""))).alias("code"))


@query()
def clean_models(cat: Catalogue) -> DataFrame:
    """Model names out of every title."""
    return cat.coded.select("offer_id", cleaned_models(F.col("title"), F.col("raw_brand")).alias("model"))


# --- histories and keyed writes ---------------------------------------------------------------

_READ = "SELECT shop_id, external_id, observed_at, ingested_at, price_minor FROM offer_snapshot WHERE price_minor IS NOT NULL"


@query(f"WITH r AS ({_READ}), l AS (SELECT shop_id, external_id, observed_at, arg_max(price_minor, (ingested_at, price_minor)) AS price FROM r GROUP BY ALL), s AS (SELECT *, lag(price) OVER (PARTITION BY shop_id, external_id ORDER BY observed_at) AS p FROM l) SELECT shop_id, external_id, count(*) FILTER (p IS NOT NULL AND p <> price) AS changes, count(*) AS readings FROM s GROUP BY ALL")
def price_changes(cat: Catalogue) -> DataFrame:
    """How often each listing's price changed: the ledger's versions of the price alone."""
    from cobbler.operators.bitemporal import Ledger

    snap = cat.raw("offer_snapshot")
    versions = Ledger(snap, ["shop_id", "external_id"], "observed_at", "ingested_at", ["price_minor"], ["price_minor"]).versions()
    n = snap.where("price_minor is not null").groupBy("shop_id", "external_id").agg(F.count_distinct("observed_at").alias("readings"))
    return versions.groupBy("shop_id", "external_id").agg((F.count("*") - 1).alias("changes")).join(n, ["shop_id", "external_id"])


@query(f"WITH r AS ({_READ}) SELECT shop_id, external_id, arg_max(price_minor, (observed_at, ingested_at, price_minor)) AS price FROM r GROUP BY ALL")
def latest_price(cat: Catalogue) -> DataFrame:
    """Each listing's price at its last reading: a maximum by time, combined before the shuffle."""
    r = cat.raw("offer_snapshot").where("price_minor is not null")
    return r.groupBy("shop_id", "external_id").agg(F.max_by("price_minor", F.struct("observed_at", "ingested_at", "price_minor")).alias("price"))


@query(
    """WITH n AS (SELECT shop_id, external_id, arg_max(struct_pack(price := price_minor, currency := currency, first_seen_at := observed_at), (observed_at, ingested_at, price_minor, coalesce(currency, ''))) AS r
      FROM offer_snapshot WHERE shop_id IS NOT NULL AND external_id IS NOT NULL AND price_minor IS NOT NULL GROUP BY ALL)
    SELECT coalesce(o.shop_id, n.shop_id) AS shop_id, coalesce(o.external_id, n.external_id) AS external_id, CASE WHEN n.r IS NULL THEN o.price_minor ELSE n.r.price END AS price,
      CASE WHEN o.offer_id IS NULL THEN n.r.currency ELSE o.currency END AS currency, CASE WHEN o.offer_id IS NULL THEN n.r.first_seen_at ELSE o.first_seen_at END AS first_seen_at
    FROM normalized_offer o FULL JOIN n ON o.shop_id = n.shop_id AND o.external_id = n.external_id"""
)
def upsert_offers(cat: Catalogue) -> DataFrame:
    """Every listing with the price of its latest reading that has one; listings known by readings alone are added."""
    old = cat.raw("normalized_offer").select("shop_id", "external_id", F.col("price_minor").alias("price"), "currency", "first_seen_at")
    r = cat.raw("offer_snapshot").where("shop_id is not null and external_id is not null and price_minor is not null")
    last = F.max_by(F.struct(F.col("price_minor").alias("price"), "currency", F.col("observed_at").alias("first_seen_at")), F.struct("observed_at", "ingested_at", "price_minor", F.coalesce("currency", F.lit(""))))
    new = r.groupBy("shop_id", "external_id").agg(last.alias("r")).select("shop_id", "external_id", "r.*")
    return upsert.upsert(old, new, ["shop_id", "external_id"], keep=["currency", "first_seen_at"])


@query(
    """WITH n AS (SELECT offer_id, s AS size_eu FROM (SELECT offer_id, unnest(sizes_eu) AS s FROM match_candidate) WHERE s IS NOT NULL)
    SELECT offer_id, size_eu FROM normalized_size WHERE offer_id NOT IN (SELECT offer_id FROM n) UNION ALL SELECT * FROM n"""
)
def replace_sizes(cat: Catalogue) -> DataFrame:
    """The sizes of every listing that the matcher has read are replaced as a whole by what it read."""
    new = cat.raw("match_candidate").select("offer_id", F.explode("sizes_eu").alias("size_eu")).where("size_eu is not null")
    return upsert.replace_groups(cat.raw("normalized_size").select("offer_id", "size_eu"), new, ["offer_id"])


@query("SELECT brand_id, brand_name FROM brand WHERE brand_name IN (SELECT brand FROM normalized_offer)")
def delete_unused_brands(cat: Catalogue) -> DataFrame:
    used = cat.coded.select(F.col("raw_brand").alias("brand_name"))
    return upsert.delete_where_absent(cat.raw("brand").select("brand_id", "brand_name"), used, ["brand_name"])


@query(
    """SELECT 'offer id' AS "check", (SELECT count(*) FROM (SELECT offer_id FROM normalized_offer GROUP BY 1 HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'external id', (SELECT count(*) FROM (SELECT shop_id, external_id FROM normalized_offer GROUP BY ALL HAVING count(*) > 1))
    UNION ALL SELECT 'size id', (SELECT count(*) FROM (SELECT size_id FROM normalized_size GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'offer shop', (SELECT count(*) FROM normalized_offer WHERE shop_id NOT IN (SELECT shop_id FROM shop))
    UNION ALL SELECT 'snapshot listing', (SELECT count(*) FROM offer_snapshot s WHERE external_id IS NOT NULL AND external_id NOT IN (SELECT external_id FROM normalized_offer))
    UNION ALL SELECT 'gender', (SELECT count(*) FROM normalized_offer WHERE gender NOT IN ('men', 'women', 'unisex', 'kids'))"""
)
def catalogue_violations(cat: Catalogue) -> DataFrame:
    """Keys that repeat, parents that are missing, values that are not allowed."""
    offers, sizes = cat.raw("normalized_offer"), cat.raw("normalized_size")
    return validate.report(
        {
            "offer id": validate.repeated_keys(offers, ["offer_id"]),
            "external id": validate.repeated_keys(offers, ["shop_id", "external_id"]),
            "size id": validate.repeated_keys(sizes, ["size_id"]),
            "offer shop": validate.missing_parents(offers, "shop_id", cat.raw("shop"), "shop_id"),
            "snapshot listing": validate.missing_parents(cat.raw("offer_snapshot"), "external_id", offers, "external_id"),
            "gender": validate.outside(offers, "gender", ["men", "women", "unisex", "kids"]),
        }
    )


# --- matching ---------------------------------------------------------------------------------

_CODE = "regexp_replace(upper(sku), '[^A-Z0-9]', '', 'g')"
_BRAND = fl("brand")


def _candidates(cat: Catalogue) -> DataFrame:
    c = cat.raw("match_candidate")
    return c.select(F.col("offer_id").alias("id"), "shop_id", fold_lower("brand").alias("brand_key"), "model", "sku", F.coalesce("gtins", F.array().cast("array<string>")).alias("gtins"), "gender")


@query(f"SELECT {_BRAND} AS brand_key, {_CODE} AS code, min(offer_id) AS first_id, count(*) AS listings, count(DISTINCT shop_id) AS shops FROM match_candidate WHERE length({_CODE}) >= 5 AND {_BRAND} <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def match_code_groups(cat: Catalogue) -> DataFrame:
    return matching.code_groups(_candidates(cat))


@query(
    f"""WITH g AS (SELECT DISTINCT {_BRAND} AS brand_key, offer_id AS id, unnest(gtins) AS gtin FROM match_candidate WHERE {_BRAND} <> ''), f AS (SELECT brand_key, gtin, min(id) AS first_id FROM g WHERE gtin <> '' GROUP BY ALL)
    SELECT brand_key, first_id, id, count(*) AS barcodes FROM g JOIN f USING (brand_key, gtin) WHERE id <> first_id GROUP BY ALL"""
)
def match_barcode_links(cat: Catalogue) -> DataFrame:
    return matching.barcode_links(_candidates(cat))


_NAME = f"trim(regexp_replace({fl('model')}, '{_B}+', ' ', 'g'))"
_GRAMS = "list_distinct([substr('  ' || {x} || ' ', i, 3) for i in range(1, length({x}) + 2)])"


@query(
    f"""WITH n AS (SELECT DISTINCT {_BRAND} AS block, {_NAME} AS name FROM match_candidate WHERE {_BRAND} <> '' AND {_NAME} <> ''), g AS (SELECT block, name, {_GRAMS.format(x='name')} AS s FROM n),
    p AS (SELECT a.block, a.name AS name_a, b.name AS name_b, len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS score FROM g a JOIN g b ON a.block = b.block AND a.name < b.name)
    SELECT * FROM p WHERE score >= 0.6"""
)
def match_similar_names(cat: Catalogue) -> DataFrame:
    """Pairs of similar model names of a brand, by an exact prefix filter."""
    c = _candidates(cat).where("brand_key is not null and model is not null")
    return matching.similar_names(c.select(F.col("brand_key").alias("block"), search_text("model").alias("name")))


@query()
def match_clusters(cat: Catalogue) -> DataFrame:
    """Guarded clusters over barcodes, codes and similar names that nothing contradicts; clusters of too many sizes fall apart."""
    sizes = cat.raw("match_candidate").select(F.col("offer_id").alias("id"), F.filter("sizes_eu", lambda s: s.isNotNull()).alias("sizes"))
    m = _candidates(cat).withColumn("code", matching.comparable_code("sku"))
    by_name = matching.similar_listings(m.withColumn("name", search_text("model")).join(sizes, "id"))
    return matching.plausible_clusters(matching.guarded_clusters(by_name, m.select("id", "shop_id", "code", "gender"), matching.code_sets(m)), sizes)


_SLUG = f"trim(regexp_replace({fl('model')}, '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"WITH c AS (SELECT {_SLUG} AS k, model, count(*) AS n FROM normalized_offer WHERE model IS NOT NULL GROUP BY ALL) SELECT k AS name_key, arg_min(model, (-n, regexp_matches(model, '[’‘“”–—]'), model)) AS model FROM c GROUP BY 1")
def consensus_name(cat: Catalogue) -> DataFrame:
    """The spelling most listings use, by folded name."""
    return matching.consensus(cat.coded.withColumn("name_key", slugify("model")), "name_key", "model")


@query(f"WITH v AS (SELECT shop_id, {_SLUG} AS wish, count(*) AS votes FROM normalized_offer WHERE model IS NOT NULL GROUP BY ALL), w AS (SELECT shop_id, arg_min(wish, (-votes, wish)) AS wish, max(votes) AS votes FROM v GROUP BY 1), b AS (SELECT wish, arg_min(shop_id, (-votes, shop_id)) AS winner FROM w GROUP BY 1) SELECT shop_id, CASE WHEN shop_id = winner THEN wish END AS wish FROM w JOIN b USING (wish)")
def slug_claims(cat: Catalogue) -> DataFrame:
    """Each shop's most used name, given to the shop with most votes for it."""
    v = cat.coded.where("model is not null").groupBy("shop_id", slugify("model").alias("wish")).agg(F.count("*").alias("votes"))
    w = v.groupBy("shop_id").agg(F.min_by("wish", F.struct(-F.col("votes"), F.col("wish"))).alias("wish"), F.max("votes").alias("votes"))
    return matching.claims(w, "shop_id", "wish", "votes")


# --- pages: bodies are made from the listings, so that reading them back can be checked --------


@query("SELECT shop_id, url AS loc, (url LIKE '%/p/0%') AS kept FROM normalized_offer")
def sitemap_locs(cat: Catalogue) -> DataFrame:
    """Sitemaps of the shops' listings, in files of at most some hundred, read back and filtered by path."""
    o = cat.coded.select("shop_id", "url", F.floor(F.col("offer_id") / 500).alias("part"))
    xml = o.groupBy("shop_id", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    locs = pages.sitemap_locs(xml, "body", "shop_id").select("shop_id", "loc")
    return locs.withColumn("kept", pages.path_allowed(F.col("loc"), allow=["p"], contains=["/p/0"], deny=["#"]))


@query("SELECT offer_id, base_url || '/shoe/' || (100 + offer_id) AS link FROM normalized_offer JOIN shop USING (shop_id)")
def page_links(cat: Catalogue) -> DataFrame:
    """Listing fragments with cards, brand links and links elsewhere; only products come back."""
    d = cat.coded.join(cat.raw("shop").select("shop_id", "base_url"), "shop_id")
    card = F.concat(F.lit("<article id='proid-1'><a href='/brand/x'>b</a><a HREF='HTTPS://other.example/1234'>o</a><a href='/shoe/"), (F.col("offer_id") + 100).cast("string"), F.lit("?ref=1#top'>x</a></article><a href='/shoe/9999'>no card</a>"))
    return pages.listing_links(d.select("offer_id", "base_url", card.alias("body")), "body", "base_url", "offer_id").select("offer_id", "link")


@query("SELECT offer_id, (price_minor // 100)::varchar || '.' || lpad((price_minor % 100)::varchar, 2, '0') AS price_raw, CASE WHEN in_stock THEN '42' END AS size, CASE WHEN in_stock THEN NULL ELSE 'sold out' END AS error, currency FROM normalized_offer")
def product_page(cat: Catalogue) -> DataFrame:
    """Microdata pages of every listing, read back; sold-out pages are told from broken ones."""
    price = F.concat(F.floor(F.col("price") / 100).cast("string"), F.lit("."), F.lpad((F.col("price") % 100).cast("string"), 2, "0"))
    size = F.when(F.col("in_stock"), F.lit("<li data-product-size='42'>42</li><li data-product-size='42'>42</li>")).otherwise(F.lit(""))
    head = F.concat(F.lit("<section itemscope itemtype='http://schema.org/Product'><div itemprop='brand'><meta itemprop='name' content='B'></div><h1 itemprop='name'>M</h1><meta itemprop='price' content='"), price, F.lit("'><meta itemprop='priceCurrency' content='"), F.col("currency"))
    body = F.concat(head, F.lit("'><link itemprop='availability' href='http://schema.org/OutOfStock'><ul class='sizes'>"), size, F.lit("</ul></section><ul class='sizes'><li data-product-size='13'>13</li></ul>"))
    d = cat.coded.select("offer_id", body.alias("body"), F.lit("microdata").alias("platform"))
    p = pages.product_pages(d, "body", "platform", "offer_id")
    return p.select("offer_id", "price_raw", F.get("sizes", F.lit(0))["raw"].alias("size"), "error", "currency")


@query("SELECT offer_id, title AS name, sku, price_minor / 100.0::double AS price FROM normalized_offer")
def json_listing(cat: Catalogue) -> DataFrame:
    """JSON listings of every offer, read back in SQL."""
    j = F.to_json(F.struct(F.lit(1).alias("total"), F.array(F.struct(F.col("offer_id").alias("id"), F.col("title").alias("name"), "sku", (F.col("price") / 100).alias("price"))).alias("products")))
    return pages.json_products(cat.coded.select("offer_id", j.alias("body")), "body", "offer_id").select("offer_id", "name", "sku", "price")


@query()
def redact_text(cat: Catalogue) -> DataFrame:
    """Every document's text with its secrets blanked, and how many there were; null stays null."""
    text, n = pages.redacted(F.col("text"))
    return cat.raw("documents").select("doc_id", text.alias("text"), n.alias("secrets"))


@query("SELECT offer_id, 'v3/products/' || slug || '/' || left(sha256(image_url), 32) || '.webp' AS key FROM (SELECT o.offer_id, s.slug, o.image_url FROM normalized_offer o JOIN shop s USING (shop_id)) WHERE image_url IS NOT NULL")
def object_keys(cat: Catalogue) -> DataFrame:
    """Where each listing's picture is stored."""
    d = cat.coded.join(cat.shop, "shop_id").where("image_url is not null")
    return d.select("offer_id", display.object_key("shop_slug", "image_url").alias("key"))


_KIND = "lower(regexp_extract(brand_logo_url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1))"


@query(f"WITH c AS (SELECT brand, brand_logo_url AS url, CASE {_KIND} WHEN 'svg' THEN 0 WHEN 'png' THEN 1 WHEN 'webp' THEN 1 ELSE 2 END AS kind, count(*) AS uses FROM normalized_offer WHERE brand IS NOT NULL AND brand_logo_url IS NOT NULL GROUP BY ALL) SELECT brand, url, row_number() OVER (PARTITION BY brand ORDER BY kind, uses DESC, url) AS place FROM c QUALIFY place <= 4")
def logo_candidates(cat: Catalogue) -> DataFrame:
    """Up to four logos per brand (a top-k report): drawings first, then the most used."""
    from pyspark.sql import Window

    d = cat.raw("normalized_offer").where("brand is not null and brand_logo_url is not null").groupBy("brand", F.col("brand_logo_url").alias("url")).agg(F.count("*").alias("uses"))
    w = Window.partitionBy("brand").orderBy(display.logo_rank("url"), F.col("uses").desc(), "url")
    return d.withColumn("place", F.row_number().over(w)).where("place <= 4").select("brand", "url", "place")


@query("SELECT image_url AS url, min(offer_id) AS offer_id FROM normalized_offer WHERE image_url LIKE 'http%' AND image_url NOT IN (SELECT image_url FROM search_result WHERE image_url IS NOT NULL) GROUP BY 1")
def pictures_to_fetch(cat: Catalogue) -> DataFrame:
    """Each picture once, unless it is there already."""
    seen = cat.raw("search_result").select(F.col("image_url").alias("url"))
    d = cat.coded.where("image_url like 'http%'").groupBy(F.col("image_url").alias("url")).agg(F.min("offer_id").alias("offer_id"))
    return d.join(seen, "url", "left_anti")


_AUD = wd("title")


@query(f"SELECT offer_id, CASE WHEN regexp_matches({_AUD}, '(^| )(djecij|djecj|djecji|kid|kids)') THEN 'kids' WHEN regexp_matches({_AUD}, '(^| )musk') THEN 'men' WHEN regexp_matches({_AUD}, '(^| )zensk') THEN 'women' WHEN regexp_matches({_AUD}, '(^| )unisex') THEN 'unisex' END AS audience FROM normalized_offer")
def audiences(cat: Catalogue) -> DataFrame:
    """Who each title is for."""
    return cat.coded.select("offer_id", display.audience(words("title")).alias("audience"))


# --- joins of the star schema, the logs --------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(value)::decimal(18,2) AS total FROM events GROUP BY 1")
def events_by_type(cat: Catalogue) -> DataFrame:
    return cat.raw("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").cast("decimal(18,2)").alias("total"))


@query("SELECT s_suppkey, count(*) AS clicks FROM events JOIN supplier ON s_suppkey = json_extract_string(props, '$.k')::bigint WHERE event_type = 'click' GROUP BY 1")
def clicks_by_shop(cat: Catalogue) -> DataFrame:
    """Clicks attributed through the key in their JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return cat.raw("events").where("event_type = 'click'").select(k.alias("s_suppkey")).join(cat.raw("supplier").select("s_suppkey"), "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("clicks"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::decimal(18,2) AS sum_qty, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem WHERE l_shipdate <= timestamp '2001-01-01' GROUP BY ALL")
def pricing_summary(cat: Catalogue) -> DataFrame:
    d = cat.raw("lineitem").where("l_shipdate <= timestamp '2001-01-01'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("decimal(18,2)").alias("sum_qty"), F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"))
