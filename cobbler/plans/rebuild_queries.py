"""Queries of the product rebuild, of normalization and of the writes around them, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.functions import money as M
from cobbler.functions import size as Z
from cobbler.functions import listing_text as L
from cobbler.functions.text import search_text
from cobbler.operators import matching, normalize, products, upsert
from cobbler.plans.catalogue import Catalogue
from cobbler.plans.catalogue_queries import BASE, fl, query
from cobbler.plans.domain_queries import _B, _NAME, _PARSED, _candidates, _table
from cobbler.sources import pages

_SLUG = lambda x: f"trim(regexp_replace({fl(x)}, '[^a-z0-9]+', '-', 'g'), '-')"

# --- products from clusters: here a cluster is what shares a code, a listing without one is its own ---

_MEMBER = "member AS (SELECT c.offer_id AS id, coalesce(p.product_id, c.offer_id) AS cluster, c.raw_brand AS brand, c.model, o.slug AS prior, c.shop_id, c.code FROM coded c LEFT JOIN product p USING (code) JOIN normalized_offer o USING (offer_id))"
_PLAN = f"""{_MEMBER},
votes AS (SELECT cluster, prior, count(*) AS n FROM member WHERE prior IS NOT NULL GROUP BY ALL),
best AS (SELECT cluster, arg_min(prior, (-n, prior)) AS inherited, max(n) AS votes FROM votes GROUP BY 1),
named AS (SELECT cluster, min(id) AS anchor, arg_min(struct_pack(b := brand, m := model), (coalesce(regexp_matches({fl('model')}, {"'" + products.PLACEHOLDER + "'"}), true), length(model), id)) AS l FROM member GROUP BY 1),
plan AS (SELECT cluster, anchor, l.b AS brand, l.m AS model, inherited, coalesce(votes, 0) AS votes,
  concat_ws('-', nullif({_SLUG("concat_ws(' ', l.b, l.m)")}, ''), anchor::varchar) AS minted FROM named LEFT JOIN best USING (cluster)),
wins AS (SELECT inherited AS slug, arg_min(cluster, (-votes, anchor)) AS winner FROM plan WHERE inherited IS NOT NULL GROUP BY 1),
claimed AS (SELECT p.*, CASE WHEN w.winner = p.cluster THEN inherited WHEN minted NOT IN (SELECT slug FROM wins) THEN minted WHEN minted || '-x' NOT IN (SELECT slug FROM wins) THEN minted || '-x' ELSE minted || '-x-x' END AS slug
  FROM plan p LEFT JOIN wins w ON w.slug = p.inherited)"""


def _members(cat: Catalogue) -> DataFrame:
    o = cat.offer.select("offer_id", F.coalesce("product_id", "offer_id").alias("cluster"), F.col("raw_brand").alias("brand"), "model", "shop_id", "code")
    return o.join(cat.raw("normalized_offer").select("offer_id", F.col("slug").alias("prior")), "offer_id").withColumnRenamed("offer_id", "id")


@query(f"WITH {BASE}, {_PLAN} SELECT cluster, anchor, brand, model, inherited, votes, minted, slug FROM claimed")
def product_slugs(cat: Catalogue) -> DataFrame:
    """Every product with its lead's name and its slug: inherited by the strongest claim, else minted."""
    return products.claimed(products.planned(_members(cat)))


@query(
    f"""WITH {BASE}, {_PLAN}, r AS (SELECT DISTINCT m.prior, c.cluster, c.votes, c.anchor FROM member m JOIN claimed c USING (cluster) WHERE prior IS NOT NULL AND prior NOT IN (SELECT slug FROM claimed))
    SELECT prior AS alias, arg_min(cluster, (-votes, anchor)) AS cluster FROM r GROUP BY 1"""
)
def slug_aliases(cat: Catalogue) -> DataFrame:
    """Slugs that no product has any more, each leading to the product with the strongest claim."""
    m = _members(cat)
    return products.aliases(m, products.claimed(products.planned(m)))


@query(f"SELECT slug, arg_min(brand, offer_id) AS name FROM (SELECT offer_id, brand, {_SLUG('brand')} AS slug FROM match_candidate) WHERE slug <> '' GROUP BY 1")
def brand_names(cat: Catalogue) -> DataFrame:
    """One brand a slug, as its first listing writes it."""
    return products.brand_names(cat.raw("match_candidate").select(F.col("offer_id").alias("id"), "brand"))


@query(
    f"""WITH {BASE}, {_MEMBER}, by_cluster AS (SELECT cluster, count(*) AS n, count(DISTINCT shop_id) AS shops, count(DISTINCT nullif(code, '')) AS codes FROM member GROUP BY 1)
    SELECT count(*) FILTER (n > 1) AS merged, coalesce(sum(n) FILTER (n > 1), 0)::bigint AS grouped, count(*) FILTER (n > 1 AND codes > 1) AS mixed_codes, count(*) FILTER (n > 1 AND shops > 1) AS several_shops, count(*) FILTER (n = 1) AS singles FROM by_cluster"""
)
def cluster_figures(cat: Catalogue) -> DataFrame:
    """How the rebuild came out, in one row."""
    return products.cluster_figures(_members(cat))


_GRAMS = "list_distinct([substr('  ' || {x} || ' ', i, 3) for i in range(1, length({x}) + 2)])"
_ADULTS = "('men', 'women', 'unisex')"


@query(
    f"""WITH d AS (SELECT offer_id AS id, shop_id, {fl('brand')} AS k, {_NAME} AS name, coalesce(regexp_replace(upper(sku), '[^A-Z0-9]', '', 'g'), '') AS code, coalesce(gender, '') AS g, [s for s in sizes_eu if s IS NOT NULL] AS sizes, [x for x in coalesce(gtins, []) if x <> ''] AS gtins FROM match_candidate),
    e AS (SELECT *, {_GRAMS.format(x='name')} AS t FROM d WHERE k <> '' AND name <> '' AND len(sizes) > 0),
    p AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 3) AS score
      FROM e a JOIN e b ON a.k = b.k AND a.id < b.id AND a.shop_id <> b.shop_id AND a.name <> b.name AND (a.code = '' OR b.code = '' OR (a.code = b.code AND length(a.code) < 5)) AND NOT list_has_any(a.gtins, b.gtins)
        AND (a.g = '' OR b.g = '' OR a.g = b.g OR (a.g IN {_ADULTS} AND b.g IN {_ADULTS})) AND len(list_intersect(a.sizes, b.sizes)) >= 0.5 * least(len(a.sizes), len(b.sizes))),
    q AS (SELECT a, b FROM p WHERE score >= 0.6 AND score < 0.82)
    SELECT id, count(*)::bigint AS partners FROM (SELECT a AS id FROM q UNION ALL SELECT b FROM q) GROUP BY 1"""
)
def match_review(cat: Catalogue) -> DataFrame:
    """How many uncertain partners each listing has: similar names that nothing contradicts and nothing confirms."""
    sizes = cat.raw("match_candidate").select(F.col("offer_id").alias("id"), F.array_sort(F.filter("sizes_eu", lambda s: s.isNotNull())).alias("sizes"))
    m = _candidates(cat).withColumn("code", matching.comparable_code("sku")).withColumn("name", search_text("model"))
    return matching.uncertain_partners(m.join(sizes, "id"))


@query()
def match_methods(cat: Catalogue) -> DataFrame:
    """By which kind of link each listing stands in its cluster."""
    sizes = cat.raw("match_candidate").select(F.col("offer_id").alias("id"), F.filter("sizes_eu", lambda s: s.isNotNull()).alias("sizes"))
    m = _candidates(cat).withColumn("code", matching.comparable_code("sku"))
    edges, sets = matching.similar_listings(m.withColumn("name", search_text("model")).join(sizes, "id")), matching.code_sets(m)
    return products.join_methods(matching.guarded_clusters(edges, m.select("id", "shop_id", "code", "gender"), sets), edges, sets)


# --- normalization -----------------------------------------------------------------------------


def _read_sizes(cat: Catalogue) -> DataFrame:
    s = cat.raw("normalized_size")
    return s.select("offer_id", F.col("size_id").alias("position"), F.col("size_raw").alias("raw"), F.col("size_raw").alias("eu_raw"), F.col("size_us").cast("string").alias("us_raw"), F.lit(None).cast("string").alias("uk_raw"), "in_stock", "gtin")


def _read_offers(cat: Catalogue) -> DataFrame:
    o = cat.raw("normalized_offer")
    return o.select("offer_id", "title", "brand", "gender", "sku", M.format_price("price_minor", "currency").alias("price_raw"), M.format_price("original_price_minor", "currency").alias("original_price_raw"))


_KIND = "CASE WHEN o.gender = 'women' THEN 'women' ELSE 'men' END"
_TABLES = f"t(kind, e, us, uk) AS (SELECT 'men', * FROM (VALUES {_table(Z.MEN)}) UNION ALL SELECT 'women', * FROM (VALUES {_table(Z.WOMEN)}))"
_BETWEEN = "CASE WHEN lo.e = hi.e THEN lo.{k} ELSE round((lo.{k} + (m.size_eu::double - lo.e) / (hi.e - lo.e) * (hi.{k} - lo.{k})) * 2) / 2 END::decimal(4,1)"


@query(
    f"""WITH {_TABLES}, r AS (SELECT offer_id, size_id, size_raw, coalesce(in_stock, false) AS stock, gtin, CASE WHEN size_us >= 0 AND size_us < 100 THEN size_us END AS us, {_PARSED} AS eu FROM normalized_size),
    m AS (SELECT offer_id, eu AS size_eu, bool_or(stock) AS in_stock, arg_min(struct_pack(raw := size_raw, us := us, gtin := gtin), (NOT stock, size_id)) AS f FROM r WHERE eu IS NOT NULL GROUP BY ALL),
    n AS (SELECT m.*, {_KIND} AS kind, (SELECT max(e) FROM t WHERE t.kind = {_KIND} AND e <= m.size_eu::double) AS l, (SELECT min(e) FROM t WHERE t.kind = {_KIND} AND e >= m.size_eu::double) AS h FROM m LEFT JOIN normalized_offer o USING (offer_id))
    SELECT offer_id, size_eu, in_stock, f.raw AS size_raw, f.gtin AS gtin, coalesce(f.us, {_BETWEEN.format(k='us')}) AS size_us, {_BETWEEN.format(k='uk')} AS size_uk
    FROM n m LEFT JOIN t lo ON lo.kind = m.kind AND lo.e = m.l AND m.h IS NOT NULL LEFT JOIN t hi ON hi.kind = m.kind AND hi.e = m.h AND m.l IS NOT NULL"""
)
def normalize_sizes(cat: Catalogue) -> DataFrame:
    """One row for each EU size of a listing; a row in stock gives label, barcode and the shop's own US size."""
    d = normalize.normalized_sizes(_read_sizes(cat), _read_offers(cat))
    return d.select("offer_id", "size_eu", "in_stock", "size_raw", "gtin", "size_us", "size_uk")


@query()
def normalize_offers(cat: Catalogue) -> DataFrame:
    """Every listing read anew from what its shop shows; what can't be stored comes with an error."""
    offers = _read_offers(cat)
    return normalize.normalized_offers(offers, normalize.normalized_sizes(_read_sizes(cat), offers))


# --- pages: bodies are made from the listings, so that reading them back can be checked -----------

_READ = "SELECT offer_id, title, brand, sku, (price_minor // 100)::varchar || '.' || lpad((price_minor % 100)::varchar, 2, '0') AS price_raw"


def _amount(c: str) -> Column:
    return F.concat(F.floor(F.col(c) / 100).cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))


@query(f"{_READ}, '42' AS size, in_stock AS stocked, NULL::varchar AS error FROM normalized_offer WHERE title <> '' AND title NOT LIKE '%<%'")
def json_ld_pages(cat: Catalogue) -> DataFrame:
    """Pages with JSON-LD and a list of size attributes, read back; sizes in teasers don't count."""
    o = cat.raw("normalized_offer").where("title <> '' and title not like '%<%'")
    data = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), "sku", F.struct(F.col("brand").alias("name")).alias("brand"), F.struct(_amount("price_minor").alias("price"), F.lit("BAM").alias("priceCurrency")).alias("offers")))
    off = F.when(F.col("in_stock"), F.lit("")).otherwise(F.lit("disabled"))
    body = F.concat(F.lit("<div class='product-item'><ul class='product-attributes'><li data-productsize-name='13'></li></ul></div><script type='application/ld+json'>"), data, F.lit("</script><ul class='product-attributes'><li data-productsize-name=' 42 ' class='"), off, F.lit("'></li></ul>"))
    p = pages.product_pages(o.select("offer_id", "in_stock", body.alias("body"), F.lit("json_ld").alias("platform")), "body", "platform", "offer_id")
    first = F.get("sizes", F.lit(0))
    return p.select("offer_id", "title", "brand", "sku", "price_raw", first["raw"].alias("size"), first["in_stock"].alias("stocked"), "error")


@query(f"{_READ}, CASE WHEN in_stock THEN '42' END AS size, CASE WHEN original_price_minor > price_minor THEN (original_price_minor // 100)::varchar || '.' || lpad((original_price_minor % 100)::varchar, 2, '0') END AS old_price_raw, CASE WHEN NOT in_stock THEN 'sold out' END AS error FROM (SELECT * REPLACE ('T' AS title, 'B' AS brand, NULL::varchar AS sku) FROM normalized_offer)")
def script_pages(cat: Catalogue) -> DataFrame:
    """Pages whose data stands in script configurations, read back."""
    o = cat.raw("normalized_offer")
    label = F.when(F.col("in_stock"), F.lit('{"label": "42"}')).otherwise(F.lit(""))
    prices = F.concat(F.lit('"prices": {"finalPrice": {"amount": '), _amount("price_minor"), F.lit('}, "oldPrice": {"amount": '), F.coalesce(_amount("original_price_minor"), F.lit("null")), F.lit("}}"))
    config = F.concat(F.lit('{"x": {"jsonConfig": {"attributes": [{"code": "size", "options": ['), label, F.lit("]}], "), prices, F.lit("}}}"))
    body = F.concat(F.lit("<h1> T </h1><script>var productBrand=\"B\";</script><script type='text/x-magento-init'>"), config, F.lit("</script>"))
    p = pages.product_pages(o.select("offer_id", body.alias("body"), F.lit("script").alias("platform")), "body", "platform", "offer_id")
    return p.select("offer_id", "title", "brand", "sku", "price_raw", F.get("sizes", F.lit(0))["raw"].alias("size"), "old_price_raw", "error")


# --- what the platforms' texts say ---------------------------------------------------------------


def _steps(platform: str, texts: dict[str, str]) -> str:
    hit = lambda where, patterns: " AND ".join(f"regexp_matches({texts[where]}, '{p}')" for p in patterns)
    return "CASE " + " ".join(f"WHEN {hit(where, patterns)} THEN '{who}'" for where, who, patterns in L.STEPS[platform]) + " END"


_TEXTS = {"title": "lower(title)", "prose": "lower(search_doc)", "attribute": "lower(gender)", "both": "(coalesce(lower(search_doc), '') || ' ' || lower(title))"}
_HEAD = f"regexp_replace(lower(regexp_extract(title, '(?s)^(.*?)(?:{L.HEAD_ENDS}|$)', 1)), '[^\\p{{L}}]', '', 'g')"
_CODED = " ".join(f"WHEN regexp_matches(title, '^{c}\\s') THEN '{who}'" for c, who in L.CODES.items())
_HEADED = " ".join(f"WHEN regexp_matches({_HEAD}, '{p}') THEN '{who}'" for who, p in L.HEADS)


@query(f"SELECT offer_id, {_steps('json_ld', _TEXTS)} AS json_ld, {_steps('script', _TEXTS)} AS script, {_steps('microdata', _TEXTS)} AS microdata, CASE {_CODED} {_HEADED} END AS json_api FROM normalized_offer WHERE title IS NOT NULL")
def platform_audiences(cat: Catalogue) -> DataFrame:
    """Who every listing is for, as each platform's reader would say."""
    o = cat.raw("normalized_offer").where("title is not null")
    return o.select("offer_id", *[L.platform_audience(p, "title", "search_doc", "gender").alias(p) for p in ("json_ld", "script", "microdata", "json_api")])


@query()
def named_models(cat: Catalogue) -> DataFrame:
    """The model after the word for the goods in every title."""
    return cat.coded.select("offer_id", L.named_model("title").alias("model"))


_LAST = "regexp_extract(regexp_replace(url, '\\?.*$', ''), '([^/]*)$', 1)"


@query(
    f"""WITH u AS (SELECT offer_id, lower(url) || coalesce('-' || lower(sku), '') AS url FROM normalized_offer WHERE url IS NOT NULL), p AS (SELECT offer_id, regexp_extract({_LAST}, '-([a-z0-9]{{4,}})(?:-(\\d{{2,3}}))?$', 1) AS h, regexp_extract({_LAST}, '-([a-z0-9]{{4,}})(?:-(\\d{{2,3}}))?$', 2) AS t FROM u)
    SELECT offer_id, CASE WHEN regexp_matches(h, '\\d') THEN upper(h || CASE WHEN t <> '' THEN '-' || t ELSE '' END) END AS code FROM p"""
)
def slug_codes(cat: Catalogue) -> DataFrame:
    """The style codes that end the listings' addresses, the article number added to each."""
    url = F.concat(F.lower("url"), F.coalesce(F.concat(F.lit("-"), F.lower("sku")), F.lit("")))
    return cat.coded.where("url is not null").select("offer_id", L.slug_code(url).alias("code"))


@query(
    f"""SELECT offer_id, CASE WHEN trim(brand_logo_url) <> '' AND NOT brand_logo_url LIKE 'data:%' AND NOT regexp_matches(brand_logo_url, '(?i){L.NO_LOGO}') THEN
      CASE WHEN regexp_matches(brand_logo_url, '^https?://') THEN brand_logo_url WHEN brand_logo_url LIKE '//%' THEN 'https:' || brand_logo_url WHEN brand_logo_url LIKE '/%' THEN base_url || brand_logo_url WHEN regexp_matches(brand_logo_url, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL ELSE base_url || '/' || brand_logo_url END END AS logo
    FROM (SELECT offer_id, trim(brand_logo_url) AS brand_logo_url, base_url FROM normalized_offer JOIN shop USING (shop_id))"""
)
def logo_addresses(cat: Catalogue) -> DataFrame:
    """The absolute address of every listing's logo."""
    d = cat.raw("normalized_offer").join(cat.raw("shop").select("shop_id", "base_url"), "shop_id")
    return d.select("offer_id", L.logo_address("brand_logo_url", "base_url").alias("logo"))


# --- writes and work lists ---------------------------------------------------------------------


@query(
    """WITH n AS (SELECT shop_id, external_id, arg_max(in_stock, (observed_at, ingested_at)) AS now FROM offer_snapshot WHERE in_stock IS NOT NULL GROUP BY ALL)
    SELECT o.shop_id, o.external_id, coalesce(n.now, o.in_stock) AS in_stock FROM normalized_offer o LEFT JOIN n USING (shop_id, external_id)"""
)
def update_stock(cat: Catalogue) -> DataFrame:
    """Listings with the stock of their last reading; those without a reading keep theirs."""
    last = cat.raw("offer_snapshot").where("in_stock is not null").groupBy("shop_id", "external_id").agg(F.max_by("in_stock", F.struct("observed_at", "ingested_at")).alias("in_stock"))
    return upsert.update_from(cat.raw("normalized_offer").select("shop_id", "external_id", "in_stock"), last, ["shop_id", "external_id"], ["in_stock"])


@query("WITH r AS (SELECT shop_id, date_trunc('day', observed_at) AS run FROM offer_snapshot WHERE observed_at IS NOT NULL GROUP BY ALL), k AS (SELECT shop_id, run, row_number() OVER (PARTITION BY shop_id ORDER BY run DESC) AS n FROM r) SELECT s.shop_id, s.external_id FROM offer_snapshot s JOIN k USING (shop_id) WHERE k.n = 3 GROUP BY ALL HAVING max(s.observed_at) < min(k.run)")
def not_seen_lately(cat: Catalogue) -> DataFrame:
    """Listings not read since their shop's third latest day of readings; a shop with fewer days has none."""
    s = cat.raw("offer_snapshot").where("observed_at is not null")
    return upsert.not_since(s, ["shop_id"], ["external_id"], "observed_at", F.date_trunc("day", "observed_at"), 3)


@query("SELECT shop_id, date_trunc('day', ingested_at) AS day, count(*) AS readings, count(*) FILTER (price_minor IS NULL OR in_stock IS NULL) AS failed, count(*) FILTER (in_stock = false) AS sold_out, round(count(*) FILTER (price_minor IS NULL OR in_stock IS NULL)::double / count(*), 6) AS failed_share FROM offer_snapshot GROUP BY ALL")
def reading_counters(cat: Catalogue) -> DataFrame:
    """Readings of each shop and day: all, failed, sold out."""
    bad = F.col("price_minor").isNull() | F.col("in_stock").isNull()
    by = cat.raw("offer_snapshot").groupBy("shop_id", F.date_trunc("day", "ingested_at").alias("day")).agg(F.count("*").alias("readings"), F.count_if(bad).alias("failed"), F.count_if(~F.col("in_stock")).alias("sold_out"))
    return by.withColumn("failed_share", F.round(F.col("failed") / F.col("readings"), 6))


@query(f"WITH {BASE} SELECT product_id, count(*) AS listings FROM offer WHERE product_id IS NOT NULL GROUP BY 1")
def product_popularity(cat: Catalogue) -> DataFrame:
    return cat.offer.where("product_id is not null").groupBy("product_id").agg(F.count("*").alias("listings"))


@query("SELECT to_json(list(struct_pack(slug := slug, base_url := base_url) ORDER BY slug))::varchar AS shops FROM shop WHERE is_active")
def shop_work_list(cat: Catalogue) -> DataFrame:
    """The active shops as one JSON list; the table of shops is fixed and small."""
    one = F.struct("slug", "base_url")
    return cat.raw("shop").where("is_active").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("shops"))


@query(f"WITH {BASE}, pic AS (SELECT DISTINCT image_url AS url FROM search_result WHERE image_url LIKE 'http%') SELECT offer_id, CASE WHEN pic.url IS NOT NULL THEN 'stored/' || left(sha256(image_url), 32) ELSE image_url END AS picture FROM offer LEFT JOIN pic ON pic.url = image_url")
def shown_pictures(cat: Catalogue) -> DataFrame:
    """The stored copy of a listing's picture where there is one, else the shop's own address."""
    have = cat.raw("search_result").where("image_url like 'http%'").select(F.col("image_url").alias("url")).distinct()
    d = cat.coded.select("offer_id", "image_url").join(have, F.col("image_url") == F.col("url"), "left")
    return d.select("offer_id", F.when(F.col("url").isNotNull(), F.concat(F.lit("stored/"), F.left(F.sha2("image_url", 256), F.lit(32)))).otherwise(F.col("image_url")).alias("picture"))


@query(
    f"""WITH {BASE}, m AS (SELECT left(trim(regexp_replace(text, '{_B}+', ' ', 'g')), 200) AS asked FROM documents WHERE source IS NULL AND text IS NOT NULL)
    SELECT asked, count(*) AS misses FROM m WHERE asked <> '' GROUP BY 1"""
)
def miss_log(cat: Catalogue) -> DataFrame:
    """Searches that found nothing, cut to what the log keeps, with how often; the texts without a source stand for them."""
    return upsert.missed(cat.raw("documents").where("source is null and text is not null"), "text").withColumnRenamed("text", "asked")
