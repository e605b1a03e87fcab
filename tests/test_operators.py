import numpy as np
from pyspark.sql import functions as F

from cobbler.operators import matching, pictures, upsert
from cobbler.operators.units import to_eu_sizes
from cobbler.sources import pages


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, first int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 3)], "k int, v string, first int")
    assert rows(upsert.upsert(old, new, ["k"], keep=["first"])) == [(1, "a", 1), (2, "B", 2), (3, "c", 3)]
    assert rows(upsert.insert_missing(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(upsert.replace_groups(old, new, ["k"])) == [(1, "a", 1), (2, "B", 9), (3, "c", 3)]
    assert rows(upsert.delete_where_absent(old, new, ["k"])) == [(2, "b", 2)]
    assert upsert.unique(old, ["k"]) and not upsert.unique(old.union(old), ["k"])
    assert rows(upsert.appended_changes(old, new, ["k"], ["first"], "v")) == [(2, "B", 9), (3, "c", 3)]
    assert rows(upsert.only_changes(old.union(old.withColumn("first", F.lit(7))), ["k"], [F.col("first")], "v")) == [(1, "a", 1), (2, "b", 2)]


def test_similar_names_lose_no_pair(spark):
    names = ["dunk low", "dunk low retro", "dunk low se", "air max", "air max 1", "air max 90", "samba", "samba og", "samba ogg", "x"]
    df = spark.createDataFrame([(b, n) for b in ("p", "q", "") for n in names] * 2, "block string, name string")
    got = {(r[0], r[1], r[2]) for r in matching.similar_names(df).collect()}

    def grams(x):
        return {f"  {x} "[i : i + 3] for i in range(len(x) + 1)}

    want = {(b, x, y) for b in ("p", "q") for x in names for y in names if x < y and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.6}
    assert got == want


def test_guarded_clusters(spark):
    members = "id long, shop_id int, code string, gender string"
    edges = "a long, b long, method string, confidence double"

    def clusters(ms, es):
        got = dict(rows(matching.guarded_clusters(spark.createDataFrame(es, edges), spark.createDataFrame(ms, members))))
        return got

    assert clusters([(1, 1, None, None), (2, 2, None, None), (3, 1, None, None)], [(1, 2, "fuzzy", 0.9), (2, 3, "fuzzy", 0.9)]) == {1: 1, 2: 1, 3: 3}
    m = [(1, 1, "233132BKCC", "men"), (2, 2, "233132BKCC", "men"), (3, 3, None, None), (4, 4, "150437TPE", "women")]
    assert clusters(m, [(1, 2, "style_code", 0.99), (1, 3, "fuzzy", 0.9), (3, 4, "fuzzy", 0.85)]) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert clusters([(1, 1, None, "men"), (2, 2, None, None), (3, 3, None, "kids")], [(1, 2, "fuzzy", 0.9), (2, 3, "fuzzy", 0.85)]) == {1: 1, 2: 1, 3: 3}
    assert clusters([(1, 1, "AAA111", "men"), (2, 2, "BBB222", "women")], [(1, 2, "gtin", 1.0)]) == {1: 1, 2: 1}


def test_sets_are_all_their_pairs(spark):
    members = "id long, shop_id int, code string, gender string"
    edges = "a long, b long, method string, confidence double"
    sets = "id long, kind string, value string, confidence double"
    none, m = spark.createDataFrame([], edges), spark.createDataFrame([(1, 1, "CODE1", None), (2, 2, "CODE1", None), (3, 1, "CODE1", None), (4, 2, "CODE1", None)], members)
    code = spark.createDataFrame([(i, "style_code", "CODE1", 0.99) for i in (1, 2, 3, 4)], sets)
    assert dict(rows(matching.guarded_clusters(none, m, code))) == {1: 1, 2: 1, 3: 3, 4: 3}
    bar = spark.createDataFrame([(1, "gtin", "9", 1.0), (4, "gtin", "9", 1.0)], sets)
    assert dict(rows(matching.guarded_clusters(none, m, code.unionByName(bar)))) == {1: 1, 2: 2, 3: 2, 4: 1}


OFFERS = "offer_id long, shop_id int, external_id string, url string, title string, brand string, model string, sku string, gender string, image_url string, price_minor int, original_price_minor int, currency string, in_stock boolean, first_seen_at timestamp, last_seen_at timestamp"


def test_word_similarity_of_every_title(spark, tmp_path):
    import re

    from cobbler.plans.catalogue import Catalogue
    from cobbler.plans.catalogue_queries import trgm_word_similarity

    titles = ["dratundo runner 5", "Air Dratund", "tundo dra", "", None, "x dratu undo dratundo2", "nothing here"]
    spark.createDataFrame([(i, 1, None, None, t, ("Nike", None, "Dra")[i % 3], *[None] * 10) for i, t in enumerate(titles)], OFFERS).write.parquet(f"{tmp_path}/normalized_offer.parquet")

    def grams(x):
        return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", x.lower()) for i in range(len(w) + 1)]

    def best(t):
        q, s = set(grams("dratundo")), grams(t)
        return max((len(q & set(s[i:j])) / len(q | set(s[i:j])) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)

    got = dict(rows(trgm_word_similarity(Catalogue(spark, str(tmp_path)))))
    assert got == {i: None if t is None else best(t) for i, t in enumerate(titles)}


def test_fold_of_every_brand(spark, tmp_path):
    from cobbler.plans.catalogue import Catalogue
    from cobbler.plans.catalogue_queries import fold_brand_case

    brands = ["Žešus-9", "361°", "Øre", "Челси", None, "", "Đak"]
    spark.createDataFrame([(i, 1, None, None, None, b, *[None] * 10) for i, b in enumerate(brands)], OFFERS).write.parquet(f"{tmp_path}/normalized_offer.parquet")
    assert rows(fold_brand_case(Catalogue(spark, str(tmp_path)))) == [(0, "Zesus-9"), (1, "361°"), (2, "Ore"), (3, "Челси"), (5, ""), (6, "Dak")]


def test_upsert_of_latest_readings(spark, tmp_path):
    from datetime import datetime

    from cobbler.plans.catalogue import Catalogue
    from cobbler.plans.domain_queries import upsert_offers

    t = [datetime(2026, 1, d) for d in range(1, 5)]
    offers = [(i, 1, f"e{i}", *[None] * 7, 100, None, "BAM", True, t[0], t[0]) for i in (1, 2, 3)]
    spark.createDataFrame(offers, OFFERS).write.parquet(f"{tmp_path}/normalized_offer.parquet")
    readings = [(1, "e3", 200, "EUR", t[1], t[1]), (1, "e3", 300, "EUR", t[2], t[2]), (1, "e3", None, "EUR", t[3], t[3]), (1, "e9", 50, "EUR", t[1], t[1])]
    spark.createDataFrame(readings, "shop_id int, external_id string, price_minor int, currency string, observed_at timestamp, ingested_at timestamp").write.parquet(f"{tmp_path}/offer_snapshot.parquet")
    got = [(r.external_id, r.price, r.currency) for r in upsert_offers(Catalogue(spark, str(tmp_path))).orderBy("external_id").collect()]
    assert got == [("e1", 100, "BAM"), ("e2", 100, "BAM"), ("e3", 300, "BAM"), ("e9", 50, "EUR")]


def brute(members, links):
    """Clusters by walking every pair in order of confidence and ids."""
    at = {r[0]: {r[0]} for r in members}
    info = {r[0]: r[1:] for r in members}
    adult = {"men", "women", "unisex"}
    for _, a, b, _, method in sorted(links):
        x, y = at[a], at[b]
        if x is y or {info[i][0] for i in x} & {info[i][0] for i in y}:
            continue
        if method == "fuzzy":
            cx, cy = ({info[i][1] for i in z if info[i][1]} for z in (x, y))
            gs = [(info[i][2], info[j][2]) for i in x for j in y if info[i][2] and info[j][2]]
            if (cx and cy and not cx & cy) or any(g != h and not {g, h} <= adult for g, h in gs):
                continue
        both = x | y
        for i in both:
            at[i] = both
    return {i: min(z) for i, z in at.items()}


def test_clusters_against_every_pair():
    import random
    from itertools import combinations

    import pandas as pd

    for seed in range(1500):
        r = random.Random(seed)
        n = r.randint(2, 24)
        members = [(i, r.randint(1, r.choice((2, 4, 9))), r.choice(("", "AAAAA", "BBBBB", "CCC")), r.choice((None, "men", "women", "kids"))) for i in range(n)]
        said = [(i, "c " + m[2], 0.99) for i, m in enumerate(members) if len(m[2]) >= 5]
        said += [(i, f"g {g}", 1.0) for i in range(n) for g in range(r.choice((1, 4))) if r.random() < 0.3]
        single = [(a, b, "fuzzy", r.choice((1.0, 0.995, 0.99, 0.9))) for a, b in combinations(range(n), 2) if r.random() < 0.1]
        pairs = [(-c, a, b, 0, "set") for a, v, c in said for b, w, _ in said if v == w and a < b] + [(-c, a, b, 1, m) for a, b, m, c in single]
        links = pd.DataFrame([(i, i, "set", c, v) for i, v, c in said] + [(a, b, m, c, "") for a, b, m, c in single], columns=["a", "b", "method", "confidence", "value"])
        assert matching._unite(pd.DataFrame(members, columns=["id", "shop_id", "code", "gender"]), links) == brute(members, pairs), seed


def test_similar_listings_become_links(spark):
    data = [
        (1, 1, "dunk low retro", None, "men", [40.0, 41.0]),
        (2, 2, "dunk low retro", "", "unisex", [41.0]),
        (3, 2, "dunk low retros", None, None, [40.0, 41.0]),
        (4, 1, "dunk low retro", None, "men", [40.0, 41.0]),  # the shop of 1
        (5, 3, "dunk low retro", None, "kids", [40.0, 41.0]),
        (6, 4, "dunk low retro", None, "men", [44.0, 45.0, 46.0]),
        (7, 5, "dunk low retro", None, "men", []),
        (8, 6, "air max", "ABC123", None, [40.0]),
        (9, 7, "air max", "ABC124", None, [40.0]),
        (10, 8, "air max", "ABC123", None, [40.0]),  # equal codes link by themselves
        (11, 9, "", None, None, [40.0]),
        (12, 10, "", None, None, [40.0]),
    ]
    d = spark.createDataFrame([(i, s, "b", n, c, g, z) for i, s, n, c, g, z in data], "id long, shop_id int, brand_key string, name string, code string, gender string, sizes array<double>")
    assert rows(matching.similar_listings(d)) == sorted([(1, 2, "fuzzy", 1.0), (2, 4, "fuzzy", 1.0), (1, 3, "fuzzy", 0.824), (3, 4, "fuzzy", 0.824), (3, 5, "fuzzy", 0.824)], key=repr)
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "id long, cluster long")
    sizes = spark.createDataFrame([(1, [28.0]), (2, [42.5]), (3, [30.0]), (4, [44.0]), (5, None)], "id long, sizes array<double>")
    assert rows(matching.plausible_clusters(clusters, sizes)) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)]


def test_match_clusters_by_name_alone(spark, tmp_path):
    from cobbler.plans.catalogue import Catalogue
    from cobbler.plans.domain_queries import match_clusters

    d = [(1, 1, "Brand", "Dunk Low", None, None, "men", [40.0]), (2, 2, "brand", "dunk  low", None, None, "men", [40.0]), (3, 3, "brand", "samba", None, None, "men", [40.0])]
    spark.createDataFrame(d, "offer_id long, shop_id int, brand string, model string, sku string, gtins array<string>, gender string, sizes_eu array<double>").write.parquet(f"{tmp_path}/match_candidate.parquet")
    assert rows(match_clusters(Catalogue(spark, str(tmp_path)))) == [(1, 1), (2, 1), (3, 3)]


def test_consensus_and_claims(spark):
    d = spark.createDataFrame([("k", "A"), ("k", "A"), ("k", "B’"), ("l", "B’"), ("l", "B'"), (None, "x"), ("m", None)], "k string, v string")
    assert rows(matching.consensus(d, "k", "v")) == [("k", "A"), ("l", "B'")]
    c = spark.createDataFrame([(1, "s", 2), (2, "s", 3), (3, "t", 1), (4, None, 1)], "k int, w string, n int")
    assert rows(matching.claims(c, "k", "w", "n")) == [(1, None), (2, "s"), (3, "t"), (4, None)]


def test_pages(spark):
    xml = "<urlset><url><loc> https://a.example/p/1 </loc></url><loc>https://a.example/q/2</loc></urlset>"
    index = "<SitemapIndex ><loc>https://a.example/x.xml</loc><loc>https://a.example/product.xml</loc></SitemapIndex>"
    d = spark.createDataFrame([(1, xml), (2, index), (3, None), (4, "")], "id int, body string")
    assert [r.loc for r in pages.sitemap_locs(d.where("id = 1"), "body", "id").orderBy("pos").collect()] == ["https://a.example/p/1", "https://a.example/q/2"]
    assert rows(pages.child_sitemaps(d, "body", "id")) == [(2, "https://a.example/product.xml")]
    u = spark.createDataFrame([("https://a.example/Shoes/x",), ("https://a.example/",), ("nope",), (None,)], "u string")
    assert [bool(r[0]) for r in u.select(pages.path_allowed(F.col("u"), allow=["shoes"])).collect()] == [True, False, False, False]
    html = "<article id='proid-9'><a href='HTTPS://WWW.s.example/shoe/123?x#y'>1</a><a href='/brand/x'>b</a><p><a href='/shoe/123'>again</a></article><a href='/shoe/777'>no</a>"
    assert pages.product_links(html, "https://www.s.example") == ["https://www.s.example/shoe/123"]
    walk = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 2, "b"), ("c", 3, "z"), ("d", 1, "a")], "cat string, page int, link string")
    assert rows(pages.first_seen_pages(walk, "cat", "page", "link")) == [("c", 1, "a"), ("c", 1, "b"), ("d", 1, "a")]


def test_product_pages(spark):
    ld = """<script type="application/ld+json">{"@type":"Product","name":"Dunk
	Low","sku":"S","image":["i1","i2"],"brand":{"name":"B"},"offers":{"price":259,"priceCurrency":"BAM"}}</script>
    <div class=product-item><ul class=product-attributes><li data-productsize-name=1 data-productsize-oldprice=999></ul></div>
    <ul class="product-attributes"><li data-productsize-name="41" data-productsize-oldprice="370.00" data-combination-code="123">41</li><li class="disabled" data-productsize-name="42" data-combination-code="9">42</li></ul>"""
    gone = "<button class='disabled'>Proizvod više nije dostupan</button><ul class='product-attributes'><li class='disabled' data-productsize-name='41'></ul>"
    d = spark.createDataFrame([(1, ld, "json_ld"), (2, gone, "json_ld"), (3, "<p>", "microdata"), (4, None, "microdata"), (5, "x", "other"), (6, "<" * 500, "json_ld")], "id int, body string, platform string")
    got = {r.id: r for r in pages.product_pages(d, "body", "platform", "id").collect()}
    assert (got[1].price_raw, got[1].old_price_raw, got[1].brand, got[1].image_url, len(got[1].sizes)) == ("259", "370.00", "B", "i1", 2)
    assert (got[1].sizes[0].gtin, got[1].sizes[1].gtin, got[1].sizes[1].in_stock) == ("123", None, False)
    assert [got[i].error for i in (1, 2, 3, 4, 5, 6)] == [None, "sold out", "no product", "empty", "unknown platform", "no product"]


def test_script_page():
    html = """<h1> Air  Presto </h1><script>var productBrand="Nike"; var productGender="men";</script>
    <script type="text/x-magento-init">{"x": {"y": {"jsonConfig": {"productId": 7, "attributes": {"9": {"code": "size", "options": [{"label": "44"}, {"label": "44.67"}]}},
    "prices": {"finalPrice": {"amount": 90.93}, "oldPrice": {"amount": 129.9}}}}}}</script>
    <script type="text/x-magento-init">{"[data]": {"mage/gallery/gallery": {"data": [{"img": "a"}, {"img": "b", "isMain": true}], "options": {}}}}</script>"""
    got = pages.script_product(html)
    assert (got["title"], got["brand"], got["price_raw"], got["old_price_raw"], got["image_url"], got["error"]) == ("Air Presto", "Nike", "90.93", "129.90", "b", None)
    assert [s["raw"] for s in got["sizes"]] == ["44", "44.67"]
    assert pages.script_product(html.replace('[{"label": "44"}, {"label": "44.67"}]', "[]"))["error"] == "sold out"
    assert pages.script_product("<h1>x</h1>")["error"] == "no product"


def test_redaction(spark):
    d = spark.createDataFrame([("mail a@b.example and Bearer abcdefghijklmnop1234",), (None,), ("",)], "t string")
    text, n = pages.redacted(F.col("t"))
    assert rows(d.select(text, n)) == [("", 0), ("mail [email] and [bearer]", 2), (None, None)]


def test_redaction_of_every_text(spark, tmp_path):
    from cobbler.plans.catalogue import Catalogue
    from cobbler.plans.domain_queries import redact_text

    d = [(1, "mail a@b.example"), (2, "api_key=abcdefghijklmnop12 and sessionid=abcdef123456"), (3, "a token of thanks, the key, a secret"), (4, None), (5, "Bearer abcdefghijklmnop1234"), (6, "plain")]
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, "mail [email]", 1), (2, "[key] and [cookie]", 2), (3, d[2][1], 0), (4, None, None), (5, "[bearer]", 1), (6, "plain", 0)]
    assert rows(redact_text(Catalogue(spark, str(tmp_path)))) == want


def test_pictures(spark):
    img = np.full((6, 6, 3), 240, dtype=np.uint8)
    img[2:4, 2:4] = 10
    white = pictures.whiten_border(img)
    assert (white[0, 0] == 255).all() and (white[2, 2] == 10).all()
    assert pictures.pack_shot_share(white) == 32 / 36
    dark = np.zeros((4, 4, 3), dtype=np.uint8)
    assert (pictures.whiten_border(dark) == dark).all()
    logo = np.full((10, 10, 4), 255, dtype=np.uint8)
    assert not pictures.logo_visible(logo)
    logo[0, :5, :3] = 0
    assert pictures.logo_visible(logo)
    d = spark.createDataFrame([(1, 6, 6, bytearray(img.tobytes())), (2, 6, 6, bytearray(b"x")), (3, None, 6, None)], "id long, height int, width int, pixels binary")
    assert [(r.id, r.accepted) for r in pictures.score_pictures(d, "id").orderBy("id").collect()] == [(1, True), (2, None), (3, None)]


SIZES = "size_id long, offer_id long, size_raw string, size_eu decimal(4,2), size_us decimal(4,1), size_uk decimal(4,1), in_stock boolean, gtin string, number int"


def chart(spark):
    rows_ = [("men", 40.0 + i, 7 + i * 0.5, 6 + i * 0.5, 248 + 7 * i) for i in range(6)] + [("women", 36.0 + i, 5 + i * 0.5, 2.5 + i * 0.5, 223 + 7 * i) for i in range(6)] + [("kids", 28.0 + i, None, None, 172 + 7 * i) for i in range(6)]
    return spark.createDataFrame(rows_, "gender string, size_eu double, size_us double, size_uk double, foot_mm int")


def test_units(spark):
    from decimal import Decimal

    offers = spark.createDataFrame([(o, "men" if o % 2 else "women", 1) for o in range(40)] + [(99, None, None)], "offer_id long, gender string, shop_id int")
    data, truth, n = [], {}, 0
    for o in range(40):
        for i in range(6):
            n += 1
            eu = (40 if o % 2 else 36) + i
            if o % 4 == 0:  # a US listing: every other label names no unit
                raw, col = (f"US {5 + i * 0.5:g}" if i % 2 else f"{5 + i * 0.5:g}"), Decimal(str(5 + i * 0.5))
            else:
                raw, col = (f"EU {eu}" if i % 2 else f"{eu}"), Decimal(eu)
            data.append((n, o, raw, col, None, None, True, None, 5))
            truth[n] = eu * 100
    data += [(1000, 1, "25,5 cm", None, None, None, None, None, None), (1001, 1, "one size", None, None, None, None, None, None), (1002, 1, None, None, None, None, None, None, None), (1003, 99, "EU 44 2/3", None, None, None, None, None, None), (1003, 99, "EU 44 2/3", None, None, None, None, None, None), (1004, 1, "9" * 400, None, None, None, None, None, None)]
    got = {r.size_id: r for r in to_eu_sizes(spark.createDataFrame(data, SIZES), offers, chart(spark)).collect()}
    wrong = [i for i, eu in truth.items() if got[i].eu_x100 != eu or got[i].status != "converted"]
    assert len(wrong) <= len(truth) * 0.05
    assert got[1000].eu_x100 == 4100 and got[1003].eu_x100 == 4467
    assert 1001 not in got and 1002 not in got
    assert got[1004].status == "review"


def test_units_of_nothing(spark):
    offers = spark.createDataFrame([], "offer_id long, gender string, shop_id int")
    assert to_eu_sizes(spark.createDataFrame([], SIZES), offers, chart(spark)).count() == 0


def test_unit_labels_with_odd_blanks_words_and_numbers(spark):
    offers = spark.createDataFrame([(1, "men", 1)], "offer_id long, gender string, shop_id int")
    labels = ["EU 44\u00a02/3", "44\u202f1/3 EU", "veličina\u00a043\u30001/2", "EU 44\u20092/3", "EU 43.2", "EU 99", "EU 420", "basic 9", "Duke 8", "neu 41", "JP 25,5 cm"]
    data = [(i, 1, x, None, None, None, None, None, None) for i, x in enumerate(labels)]
    got = {r.size_id: r for r in to_eu_sizes(spark.createDataFrame(data, SIZES), offers, chart(spark)).collect()}
    assert [(got[i].eu_x100, got[i].status) for i in (0, 1, 2, 3, 6, 10)] == [(4467, "converted"), (4433, "converted"), (4350, "converted"), (4467, "converted"), (4200, "converted"), (4100, "converted")]
    # an EU number off the grid or the chart, and numbers beside words that only hold a unit's letters
    assert [got[i].status for i in (4, 5)] == ["review"] * 2
    assert [got[i].how for i in (7, 8, 9)] == ["predicted"] * 3


def test_units_without_stated_rows_are_reviewed(spark):
    offers = spark.createDataFrame([(1, "men", 1)], "offer_id long, gender string, shop_id int")
    data = [(i, 1, str(40 + i), None, None, None, None, None, None) for i in range(5)]
    got = to_eu_sizes(spark.createDataFrame(data, SIZES), offers, chart(spark)).collect()
    assert len(got) == 5 and all(r.status == "review" and r.confidence == 0.0 for r in got)
