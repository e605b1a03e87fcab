import os
from decimal import Decimal

from cobbler.operators import normalize, products, upsert


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MEMBERS = "cluster long, id long, brand string, model string, prior string, extra int"


def test_slugs_and_aliases(spark):
    data = [
        (1, 1, "Nike", "Patike", "old", 0), (1, 2, "Nike", "Dunk Low", "old", 0), (1, 3, "NIKE", "Dunk Low Retro", None, 0),  # strongest claim to "old"
        (4, 4, "Nike", "Dunk", "old", 0),  # loses it and mints
        (5, 5, None, None, None, 0), (6, 6, "x", "patike", "gone", 0), (7, 7, "x", "y", "gone", 0), (7, 8, "x", "y", "kept", 0), (7, 9, "x", "y", "kept", 0),
        (10, 10, "a", "b", None, 0), (11, 11, "c", "d", "a-b-10", 0), (12, 12, "e", "f", "a-b-10-x", 0),  # minted "a-b-10" and "a-b-10-x" are inherited
    ]
    m = spark.createDataFrame(data, MEMBERS)
    plan = products.claimed(products.planned(m))
    got = {r.cluster: (r.model, r.inherited, r.votes, r.slug) for r in plan.collect()}
    assert got == {
        1: ("Dunk Low", "old", 2, "old"), 4: ("Dunk", "old", 1, "nike-dunk-4"), 5: (None, None, 0, "5"), 6: ("patike", "gone", 1, "gone"), 7: ("y", "kept", 2, "kept"),
        10: ("b", None, 0, "a-b-10-x-x"), 11: ("d", "a-b-10", 1, "a-b-10"), 12: ("f", "a-b-10-x", 1, "a-b-10-x"),
    }
    assert rows(products.aliases(m, plan)) == []
    retired = spark.createDataFrame([(1, 1, "a", "b", "p", 0), (1, 2, "a", "b", "p", 0), (1, 3, "a", "b", "q", 0), (4, 4, "a", "c", "q", 0), (4, 5, "a", "c", "r", 0), (4, 6, "a", "c", "r", 0), (4, 7, "a", "c", "r", 0)], MEMBERS)
    assert rows(products.aliases(retired, products.claimed(products.planned(retired)))) == [("q", 4)]  # of two that had it the one with more votes
    assert products.claimed(products.planned(m.limit(0))).count() == 0


def test_brands_and_figures(spark):
    d = spark.createDataFrame([(3, "NIKE"), (1, "Nike"), (2, "nike"), (4, None), (5, "!!"), (6, "Žešus")], "id long, brand string")
    assert rows(products.brand_names(d)) == [("nike", "Nike"), ("zesus", "Žešus")]
    m = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, ""), (2, 1, "C"), (3, 1, None)], "cluster long, shop_id int, code string")
    assert rows(products.cluster_figures(m)) == [(2, 4, 1, 1, 1)]
    assert rows(products.cluster_figures(m.limit(0))) == [(0, 0, 0, 0, 0)]


def test_join_methods(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)], "id long, cluster long")
    e = spark.createDataFrame([(1, 2, "fuzzy", 0.9), (3, 4, "fuzzy", 0.85)], "a long, b long, method string, confidence double")
    s = spark.createDataFrame([(2, "gtin", "9", 1.0), (3, "gtin", "9", 1.0), (4, "style_code", "X", 0.99), (5, "style_code", "X", 0.99), (6, "style_code", "X", 0.99)], "id long, kind string, value string, confidence double")
    assert dict(rows(products.join_methods(c, e, s))) == {1: "fuzzy", 2: "fuzzy", 3: "gtin", 4: "fuzzy", 5: "style_code", 6: "style_code"}


def test_normalized(spark):
    sizes = spark.createDataFrame(
        [(1, 1, "US 3.5", "36", "3,5", None, False, "g1"), (1, 2, "US 4", "EU 36", "4", None, True, "g2"), (1, 3, "x", "129", None, None, True, None), (1, 4, "44", "44", None, "9.25", None, None), (2, 1, "one", "one size", None, None, True, None), (1, 5, None, None, None, None, None, None)],
        "offer_id long, position long, raw string, eu_raw string, us_raw string, uk_raw string, in_stock boolean, gtin string",
    )
    offers = spark.createDataFrame(
        [(1, "NIKE PATIKE DUNK ZA MUŠKARCE", "361°", "men", "A-1", "129,90 KM", "129,90 KM"), (2, "x", "Nike", None, None, "10 KM", "20 KM"), (3, None, None, None, None, "call us", None)],
        "offer_id long, title string, brand string, gender string, sku string, price_raw string, original_price_raw string",
    )
    s = normalize.normalized_sizes(sizes, offers)
    assert [(r.size_eu, r.size_raw, r.size_us, r.in_stock, r.gtin) for r in s.orderBy("size_eu").collect()] == [(Decimal("36.00"), "US 4", Decimal("4.0"), True, "g2"), (Decimal("44.00"), "44", Decimal("10.0"), False, None)]
    o = {r.offer_id: r for r in normalize.normalized_offers(offers, s).collect()}
    assert (o[1].brand, o[1].price, o[1].original_price, o[1].in_stock, o[1].error) == ("361 Degrees", 12990, None, True, None)
    assert o[1].search_doc == "361 degrees nike dunk a-1"
    assert (o[2].original_price, o[2].in_stock, o[2].error) == (2000, False, "no sizes") and o[3].error == "no price"
    assert normalize.normalized_offers(offers.limit(0), s).count() == 0
    d = spark.createDataFrame([("9,5",), (" 10 ",), ("9.25",), ("100",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(normalize.number_or_null("x")).collect()] == [Decimal("9.5"), Decimal("10.0"), None, None, None, None]


def test_more_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    assert rows(upsert.update_from(old, spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "k int, v string"), ["k"], ["v"])) == [(1, "a", 1), (2, "B", 2)]
    log = spark.createDataFrame([("  a  b ",), ("a b",), ("",), (None,), ("x" * 999,)], "q string")
    assert rows(upsert.missed(log, "q")) == [("a b", 2), ("x" * 200, 1)]
    folder = f"file://{tmp_path}/t"
    upsert.swapped(old, folder)
    upsert.swapped(spark.read.parquet(folder).where("k = 2"), folder)  # reads what it replaces
    assert rows(spark.read.parquet(folder)) == [(2, "b", 2)]
    assert os.listdir(tmp_path) == ["t"]


def test_review_against_all_pairs(spark):
    from cobbler.operators.matching import uncertain_partners

    names = ["dunk low", "dunk low retro", "dunk low se", "air max 90", "air max 95", "samba og"]
    data = [(i, i % 3, "p", names[i % 6], "" if i % 4 else "AB1", [None, "men", "kids"][i % 3], [40.0, 41.0 + i % 2], ["9"] if i in (1, 2) else []) for i in range(24)]
    d = spark.createDataFrame(data, "id long, shop_id int, brand_key string, name string, code string, gender string, sizes array<double>, gtins array<string>")

    def grams(x):
        return {f"  {x} "[i : i + 3] for i in range(len(x) + 1)}

    want = {}
    for x in data:
        for y in data:
            s = round(len(grams(x[3]) & grams(y[3])) / len(grams(x[3]) | grams(y[3])), 3)
            fits = x[1] != y[1] and x[3] != y[3] and (not x[4] or not y[4] or x[4] == y[4]) and (x[5] is None or y[5] is None or x[5] == y[5]) and not set(x[7]) & set(y[7]) and len(set(x[6]) & set(y[6])) >= 1
            if fits and 0.6 <= s < 0.82:
                want[x[0]] = want.get(x[0], 0) + 1
    assert dict(rows(uncertain_partners(d))) == want and want


def test_pictures_and_logos(spark):
    import numpy as np

    from cobbler.operators import pictures

    img = np.full((20, 30, 3), 200, dtype=np.uint8)
    img[5:9, 10:20] = 10
    assert pictures.trimmed(img).shape == (4, 10, 3) and (pictures.trimmed(img) == 10).all()
    assert (pictures.trimmed(np.full((3, 3, 3), 7, dtype=np.uint8)) == 7).all()
    out = pictures.fitted(img)
    dark = np.argwhere((out == 10).all(axis=2))
    assert out.shape == (640, 640, 3) and (out[0] == 255).all() and np.ptp(dark[:, 1]) + 1 == 563 and abs(dark[:, 0].mean() - 319.5) < 1
    white, busy = np.full((4, 4, 3), 255, dtype=np.uint8), np.zeros((4, 4, 3), dtype=np.uint8)
    assert pictures.best_pack_shot([busy, white]) == 1 and pictures.best_pack_shot([busy]) == 0 and pictures.best_pack_shot([]) is None
    logos = spark.createDataFrame([([("a", 100), ("b", 109), ("c", 111), ("d", 120)],), ([],), (None,)], "l array<struct<url: string, area: int>>")
    assert [r[0] and r[0].url for r in logos.select(pictures.chosen_logo("l")).collect()] == ["c", None, None]


def test_addresses_and_shown_counts(spark):
    from pyspark.sql import functions as F

    from cobbler.functions import display
    from cobbler.operators.search import Search

    p = Search.from_parameters({"velicina": "44, 42.5,44,x,99,", "strana": "3", "sort": "snizenje", "pol": "men,robots", "akcija": "1", "prodavnica": "a,,b", "q": " samba "})
    assert p == Search(sizes=(42.5, 44.0), query="samba", shops=("a", "b"), genders=("men",), on_sale=True, sort="discount", page=3)
    assert Search.from_parameters({"strana": "0", "sort": "zz", "velicina": ""}) == Search() and Search.from_parameters({"strana": "1.5"}).page == 1
    d = spark.createDataFrame([(1,), (2,), (5,), (11,), (12,), (21,), (112,), (None,)], "n int")
    assert [r[0] for r in d.select(display.counted_word("n", display.COLOURS)).collect()] == ["boja", "boje", "boja", "boja", "boja", "boja", "boja", None]
    one = d.limit(1)
    assert one.select(display.shown_range(2, 48, F.lit(1207))).first()[0] == "Prikazano 49-96 od 1.207."
    assert one.select(display.shown_range(2, 48, F.lit(60))).first()[0] == "Prikazano 49-60 od 60."
    sizes = F.array(F.lit(41), F.lit(44))
    assert [one.select(x).first()[0] for x in (display.clicked_size([44]), display.clicked_size([44, 45]), display.clicked_size([43, 44], sizes), display.clicked_size([40], sizes), display.clicked_size([]))] == [44.0, None, 44.0, None, None]
