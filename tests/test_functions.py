from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cobbler.functions import money, size, text, titles, trigram


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "eu"),
    [("44", "44.00"), ("44.5", "44.50"), ("44,5", "44.50"), ("44 2/3", "44.67"), ("42 1/3", "42.33"), ("38-2/3", "38.67"), ("EU 44", "44.00"), ("veličina 44", "44.00"), ("99 1/2", "99.50"), ("129", None), ("0", None), ("", None), ("one size", None), ("44 1/0", None), (None, None)],
)
def test_parse_eu_size(spark, raw, eu):
    assert one(spark, raw, size.parse_eu_size) == (None if eu is None else Decimal(eu))


@pytest.mark.parametrize(("eu", "gender", "brand", "us", "uk"), [(44.0, None, "", "10.0", "9.5"), (44.0, "men", "Nike", "10.0", "9.0"), (44.0, None, "Nike", "10.0", "9.0"), (38.0, "women", "", "7.5", "5.5"), (44.5, None, "", "10.5", "10.0"), (52.0, None, "", None, None), (44.0, "kids", "Nike", "10.0", "9.5")])
def test_convert_size(spark, eu, gender, brand, us, uk):
    got = spark.createDataFrame([(eu, gender, brand)], "e double, g string, b string").select(size.convert_size("e", "g", "b").alias("c")).first()["c"]
    assert (got["us"], got["uk"]) == tuple(None if v is None else Decimal(v) for v in (us, uk))


def test_shown_sizes(spark):
    d = spark.createDataFrame([(Decimal(x),) for x in ("44", "44.5", "44.67", "37.33")], "x decimal(4,2)")
    assert [r[0] for r in d.select(size.format_size("x")).collect()] == ["44", "44½", "44⅔", "37⅓"]
    d = spark.createDataFrame([(44.67,), (45.0,)], "x double")
    assert [r[0] for r in d.select(size.size_match("x", [44.0])).collect()] == ["near", None]
    assert one(spark, 44.67, lambda c: size.size_match(c, [44.5]), "double") is None
    chips = spark.createDataFrame([([float(x) for x in range(36, 49)],)], "x array<double>").select(size.size_chips("x", [47.0, 48.0], 5)).first()[0]
    assert chips == [36.0, 37.0, 38.0, 47.0, 48.0]
    assert one(spark, "46,45,45", size.parse_size_list) == [45.0, 46.0]
    assert one(spark, "abc,0,999,44", size.parse_size_list) == [44.0]


@pytest.mark.parametrize(("raw", "minor"), [("129,90 KM", 12990), ("129.90", 12990), ("1.299,00 KM", 129900), ("129 KM", 12900), ("129.9", 129900), ("", None), ("KM", None), ("-5", None), (None, None)])
def test_parse_price(spark, raw, minor):
    assert one(spark, raw, money.parse_price) == minor


def test_money(spark):
    d = spark.createDataFrame([(19558, "BAM", 10000), (4999, "EUR", None), (12990, "BAM", 12990)], "a int, c string, o int")
    assert [r[0] for r in d.select(money.to_eur_minor("a", "c")).collect()][:2] == [10000, 4999]
    assert [r[0] for r in d.select(money.format_price("a", "c")).collect()] == ["195,58 KM", "49,99 €", "129,90 KM"]
    assert one(spark, 8000, lambda c: money.discount_percent(c, F.lit(10000)), "int") == 20
    assert [r[0] for r in d.select(money.discount_percent("a", "o")).collect()] == [None, None, None]
    assert one(spark, 1207, money.format_count, "int") == "1.207"


def test_text(spark):
    assert one(spark, "ČĆŽŠĐ čćžšđ", text.fold_diacritics) == "CCZSD cczsd"
    assert one(spark, "Nike Air Max 90 — Bijele", text.slugify) == "nike-air-max-90-bijele"
    assert one(spark, "Muške   patike ", text.search_text) == "muske patike"
    assert one(spark, "Straße Œuvre", text.folded) == "strasseoeuvre"
    assert one(spark, None, text.words) is None
    assert spark.range(1).select(text.family_key(F.lit(None).cast("string"), F.lit("Uno Lite"))).first()[0] == "uno-lite"


@pytest.mark.parametrize(("a", "b", "score"), [("Uno Lite", "Uno-Lite", 1.0), ("CAMPUS 00s", "CAMPUS 00s C", 0.917), ("Samba", "Samba OG", 0.667), ("", "x", 0.0)])
def test_similarity(spark, a, b, score):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(trigram.similarity("a", "b")).first()[0] == pytest.approx(score, abs=1e-3)


@pytest.mark.parametrize(("q", "t", "score"), [("word", "two words", 0.8), ("samaba", "adidas samba", 0.444), ("cortz", "nike patike cortez", 0.667), ("jordn", "jordan air jordan 1", 0.667), ("sketchers", "skechers uno", 0.583), ("asixs", "asics gel nyc", 0.5), ("zxcvbn", "nike dunk low", 0.0)])
def test_word_similarity(spark, q, t, score):
    d = spark.createDataFrame([(q, t), (None, t)], "a string, b string")
    got = [r[0] for r in d.select(trigram.word_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(score, abs=1e-3)
    assert got[1] is None


def test_whole_text_similarity(spark):
    d = spark.createDataFrame([("uno lite", "uno-lite"), ("campus 00s", "campus 00s c")], "a string, b string")
    assert [round(r[0], 3) for r in d.select(trigram.text_similarity("a", "b")).collect()] == [0.5, 0.846]


@pytest.mark.parametrize(
    ("title", "brand", "model"),
    [
        ("Nike Patike NIKE DUNK LOW RETRO", "Nike", "Dunk Low Retro"), ("adidas Patike HANDBALL SPEZIAL W", "adidas", "Handball Spezial W"), ("Patike RUNNER 5", None, "Runner 5"),
        ("Jordan Patike Air Jordan 1 Zoom Air", "Jordan", "Air Jordan 1 Zoom Air"), ("NIKE PATIKE AIR PRESTO ZA MUŠKARCE", "NIKE", "Air Presto"), ("PUMA PATIKE KARMEN II JR DJEVOJČICE", "PUMA", "Karmen II JR"),
        ("CONVERSE PATIKE RUN STAR MOTION CX PATIKE UNISEX", "CONVERSE", "Run Star Motion CX"), ("NIKE PATIKE AIR MAX NOVA ZA DE?AKE", "NIKE", "Air Max Nova"),
        ("ADIDAS PATIKE GRAND COURT DJEČACI UZRASTA 0-4 GODINE", "ADIDAS", "Grand Court"), ("REPLAY PATIKE ZA MUŠKARCE", "REPLAY", "Patike"), ("361 BIG3 6.0", "361 Degrees", "BIG3 6.0"),
    ],
)
def test_clean_model(title, brand, model):
    assert titles.clean_model(title, brand) == model


def test_names():
    for shouted, cased in [("VAPOR 16 CLUB TF", "Vapor 16 Club TF"), ("TERREX AX4 GTX", "Terrex AX4 GTX"), ("RS-X HI", "RS-X HI"), ("BLAZER MID '77 JUMBO", "Blazer Mid '77 Jumbo"), ("E-SERIES AD", "E-Series AD"), ("Mixed Case", "Mixed Case")]:
        assert titles.title_case(shouted) == cased
    assert titles.canonical_brand("361°") == "361 Degrees"
    assert titles.canonical_brand("NIKE") == "NIKE"
    assert titles.clean_model(None, "x") is None and titles.clean_model("", "x") == ""
    assert titles.clean_model("Nike Nike", "nike") == "Nike Nike" and titles.clean_model("NikeNike x", "Nike") == "NikeNike x"
    assert titles.is_placeholder("Patike") and titles.is_placeholder(" ") and not titles.is_placeholder("Patike 5")
    assert titles.word_kind("mu?ke") == "wearer" and titles.word_kind("mu??e") == "wearer" and titles.word_kind("m?x") is None


def test_expanded_queries(spark):
    d = spark.createDataFrame([("tenisice",), ("Patike  Tenisice",), ("Obuća x",), ("",), (None,)], "q string")
    assert [r[0] for r in d.select(titles.expanded("q")).collect()] == [["tenisice", "patike"], ["patike", "tenisice"], ["obuca", "patike", "cipele", "x"], [], None]


def test_display(spark):
    import datetime as dt

    from cobbler.functions import display

    assert display.page_window(10, 20) == [1, None, 9, 10, 11, None, 20]
    assert display.page_window(3, 6) == [1, 2, 3, 4, 5, 6]
    assert display.page_window(3, 8) == [1, 2, 3, 4, None, 8]
    d = spark.createDataFrame([(dt.datetime(2026, 9, 17, 23, 30, tzinfo=dt.UTC),)], "t timestamp")
    now = F.lit("2026-09-18 16:45:00").cast("timestamp")
    assert d.select(display.checked_at("t", now)).first()[0] == "danas u 01:30"
    assert d.select(display.is_stale("t", now), display.is_stale("t", F.lit("2026-09-19 01:31:00").cast("timestamp"))).first()[:] == (False, True)
    assert [one(spark, u, display.logo_rank) for u in ("a/b.SVG", "a.png?x=1", "a.jpg", "")] == [0, 1, 2, 2]
    p = spark.createDataFrame([("b", ["a", "b"], ["a", "b"]), ("a", ["a"], ["c", "a"]), (None, [], ["c"]), ("x", ["a"], [])], "s string, o array<string>, n array<string>")
    assert [r[0] for r in p.select(display.kept_picture("s", "o", "n")).collect()] == ["b", "c", "c", None]
    assert [one(spark, t, display.audience) for t in ("muske patike", "djecija obuca muska", "za zenske", "unisex", "x", None)] == ["men", "kids", "women", "unisex", None, None]


def test_platform_texts(spark):
    from cobbler.functions import listing_text as L

    def one(column, *values):
        d = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return d.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]

    for platform, title, prose, attribute, who in [
        ("json_ld", "Air Max GS", "Muške patike", None, "kids"), ("json_ld", "x", "za muškarce i žene", None, "unisex"), ("json_ld", "x", "ženske", None, "women"), ("json_ld", "Dunk W", None, None, "women"), ("json_ld", "x", None, None, None), ("json_ld", None, None, None, None),
        ("script", "NIKE PATIKE MOTIF ZA DEČAKE", None, None, "kids"), ("script", "PUMA KARMEN JR", None, "Muškarci", "men"), ("script", "x za  žene", None, None, "women"), ("microdata", "x", "Dječije patike", None, "kids"), ("microdata", "x", " Muške patike", None, "men"),
        ("json_api", "Z PATIKE LS UNO", None, None, "women"), ("json_api", "Muške patike GALAXY 8", None, None, "men"), ("json_api", "Dj ečije patike X", None, None, "kids"), ("json_api", "Unisex kopacke", None, None, "unisex"), ("json_api", "GALAXY 8", None, None, None),
    ]:
        assert one(lambda t, p, a: L.platform_audience(platform, t, p, a), title, prose, attribute) == who, (platform, title)
    for name, model in [
        ("Muške patike za trčanje GALAXY 8", "GALAXY 8"), ("Ženske patike performance running CLOUDSURFER TRAIL 2", "CLOUDSURFER TRAIL 2"), ("Muške patikeTURF PHANTOM 6", "PHANTOM 6"), ("Ženske patikeS UNO RUGGED", "UNO RUGGED"),
        ("Z PATIKE LS RUN 70S 2.0 FTWWHT/CBLACK", "RUN 70S 2.0"), ("patike AIR MAX FIRE)", "AIR MAX FIRE"), ("patike VL COURT 00s", "VL COURT 00s"), ("patike samo opis", ""), (None, None),
    ]:
        assert one(L.named_model, name) == model, name
    for url, code in [("https://x/a-398878-01", "398878-01"), ("https://x/nike-hq6953?c=1", "HQ6953"), ("https://x/karmen-ii-za-muskarce", None), ("", None), (None, None)]:
        assert one(L.slug_code, url) == code, url
    for src, logo in [("/l/a.svg", "https://s.example/l/a.svg"), ("//cdn/x.png", "https://cdn/x.png"), ("http://y/z.png", "http://y/z.png"), ("b.png", "https://s.example/p/b.png"), ("data:image/png;x", None), ("/no-image.png", None), ("ftp://a/b", None), (" ", None), (None, None)]:
        assert one(L.logo_address, src, "https://s.example/p/q?r=1") == logo, src
