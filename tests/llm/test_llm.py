import itertools
import math
import random
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobbler.llm import canonical, components, confusables, folding, languages, listings, mixing, same_product, survivorship, tokenizing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- groups -----------------------------------------------------------------------------------

PAIRS = "a long, b long, how string, id long, group_id long"


def closure(pairs):
    ids = {x for a, b, *_ in pairs for x in (a, b) if x is not None}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b, how, *_ in pairs:
        if a is not None and b is not None and how and how.strip():
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((i, root(i)) for i in ids)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *range(60)])
    pairs = [(pick(), pick(), rng.choice(["x", " ", None, "y"]), 1, 2) for _ in range(45)]
    pairs += [(100 + i, 101 + i, "chain", 1, 2) for i in range(40)] + [(200, 201 + i, "star", 1, 2) for i in range(40)]
    pairs += pairs[:10] + [(b, a, h, 1, 2) for a, b, h, *_ in pairs[10:20]]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, PAIRS)
    got = components.group_pairs(df, "a", "b", F.trim("how") != "")
    assert sorted(tuple(r) for r in got.collect()) == closure(pairs)


def test_no_pairs(spark):
    assert components.group_pairs(spark.createDataFrame([], PAIRS), "a", "b").count() == 0


# --- canonical values -------------------------------------------------------------------------

NAMES = [(1, "Skeke Sport", []), (2, "Čevuk 87", ["House of Čevuk"]), (3, "Brübaq Works", []), (4, "Čopopož", []), (5, "Čopopož Junior", []), (6, "Gaklex", ["GAXX6"]), (7, "Tilkišon", [])]


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("SKEKE SPORT", 1), ("  skeke   sport ", 1), ("Sport, Skeke", 1), ("S.K.E.K.E Sport", 1), ("Sk eke Sport", 1), ("by SKEKE SPORT", 1), ("Skeke Sport d.o.o.", 1), ("Skeke Sport / Skeke Sport", 1),
        ("Скеке Спорт", 1), ("Skkee Sport", 1), ("BrÃ¼baq Works", 3), ("brubaq works", 3), ("ČOPOPOŽ", 4), ("Čopopož Junior Intl", 5), ("Čopopož Sport", 0), ("gaxx6", 6), ("house of čevuk", 2), ("TilkiÅ¡on", 7),
        ("n/a", 0), ("12990", 0), ("???", 0), ("", 0), ("Praklusitt", None), ("Skeke Sport Gaklex", None), ("x" * 5000, None),
    ],
)
def test_values(value, entry):
    _, exact, near = canonical.Names(NAMES, frozenset("by d o house of".split())).of_value(value)
    assert (exact if exact is not None else near) == entry


def test_mentions_are_the_longest():
    names = canonical.Names([(1, "Alpha Beta", []), (2, "Beta Gamma Delta", []), (3, "Gamma", [])])
    assert [n for *_, n in names.mentions("alpha beta gamma delta")] == [2]
    assert [n for *_, n in names.mentions("gamma alpha beta gamma")] == [3, 1, 3]
    assert names.mentions("") == [] and canonical.Names([]).mentions("alpha beta") == []


def test_similar_words_against_every_name():
    """The bigram index loses no name that comparing with all of them finds."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    names = canonical.Names([(n, f"{word()} {word()}" if n % 3 else word(), []) for n in range(1, 400)])

    def slip(x):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abcdr") + x[k:], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]]) or "a"
        return x

    for name, _, _ in rng.sample(names.names, 250):
        words = slip(name[:5] + " " + name[5:]).split() if rng.random() < 0.5 else [slip(name)]
        joined = "".join(words)
        most = int(len(joined) * (1 - canonical.LEAST_SIMILAR))
        far = [(min(folding.edit_distance("".join(o), key, most) for o in itertools.permutations(words)), n) for key, n, _ in names.names]
        best = min(d for d, _ in far)
        want = {n for d, n in far if d == best} if best <= most else set()
        assert names.similar(words) == (want.pop() if len(want) == 1 else None), words


def test_mapped_values(spark):
    data = [(1, "Skeke Sport", None), (2, None, "x"), (3, "  ", "x"), (4, "skeke sport", None), (5, "Molopomu", "Patike Gaklex Runner 5"), (6, "Molopomu", "GAKLEX TRAIL"), (7, "Fremdo", "Fremdo Trail 2"), (8, "razno", "Gaklex Pro"), (9, "Gaklexx", None), (9, "Gaklexx", None), (10, "ništa", "Gaklex Pro"), (11, "Skeke Spxxyy", "Skeke Sport Dash")]
    df = spark.createDataFrame(data, "id long, brand string, title string").withColumns({"key": F.lit("clash"), "entry": F.lit(1)})
    names = spark.createDataFrame(NAMES, "brand_id int, brand_name string, aliases array<string>")
    assert rows(canonical.map_values(df, "id", "brand", "title", names).distinct()) == [(10, 0), (11, 1), (4, 1), (5, 6), (6, 6), (7, 0), (8, 0), (9, 6)]
    assert canonical.map_values(df.limit(0), "id", "brand", "title", names).count() == 0
    assert {r[1] for r in canonical.map_values(df, "id", "brand", "title", names.limit(0)).collect()} == {0}
    many = spark.createDataFrame([(n, f"Brend{c}x", []) for n, c in enumerate("abcdefgh")], "brand_id int, brand_name string, aliases array<string>")
    wrapped = spark.createDataFrame([(i, f"{w} brend{c}x", None) for i, (w, c) in enumerate([*(("tvrtka", c) for c in "abcdef"), ("razna", "g")])], "id long, brand string, title string")
    # what stands beside many names says nothing, what stands beside one does not hide in it
    assert rows(canonical.map_values(wrapped, "id", "brand", "title", many)) == [*((i, i) for i in range(6)), (6, 0)]
    with pytest.raises(ValueError, match="canonical"):
        canonical.MOST_NAMES, keep = 1, canonical.MOST_NAMES
        try:
            canonical.map_values(df, "id", "brand", "title", names)
        finally:
            canonical.MOST_NAMES = keep


@pytest.mark.parametrize(("a", "b", "most", "d"), [("abc", "abc", 2, 0), ("abc", "acb", 2, 1), ("abc", "abd", 2, 1), ("abc", "ab", 2, 1), ("abc", "xyz", 2, 3), ("", "abcd", 2, 3)])
def test_edits(a, b, most, d):
    assert folding.edit_distance(a, b, most) == d


# --- look-alikes ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Skeke Pro 2", "Ｓｋｅｋｅ Pro 2", True), ("Kurtež", "Kurtež", True), ("glide", "gli​de", True), ("a b", "a b", True), ("x-y", "x‑y", True), ("gold", "gоld", True), ("retro", "rеtrо", True), ("ν5", "v5", True), ("ﬁ", "fi", True), ("𝟪mm", "8mm", True), ("Ⅲ", "III", True),
        ("Gold", "gold", False), ("Kurtež", "Kurtez", False), ("x-y", "x y", False), ("đ", "d", False), ("Патике роса", "Патике poca", False), ("Патике бордo", "Патике бордо", True), ("", "​", True), ("l", "I", False), ("0", "O", False),
        ("ɡold", "gold", True), ("ɑdidas", "adidas", True), ("goldı", "goldi", True), ("Ꭺdidas", "Adidas", True), ("օn", "on", True), ("ꓟ1", "M1", True), ("ⲟn", "on", True), ("x²", "x2", False), ("①", "1", False), ("½", "1⁄2", False), ("´", " ", False),
    ],
)
def test_skeletons(a, b, same):
    assert (confusables.skeleton(a) == confusables.skeleton(b)) is same


def test_lookalike_pairs(spark):
    long = "ab " * 30_000
    texts = [(1, "gold", "x"), (2, "gоld", "x"), (3, "gold", None), (4, "g​old", "y"), (5, None, "у"), (6, "", "​"), (7, "⁠", ""), (8, long, "z"), (9, long + "​", "z"), (1, "gold", "x")]
    df = spark.createDataFrame(texts, "id long, t string, s string").withColumns({"raw": F.lit("clash"), "skeleton": F.lit(1)})
    once = {(i, f, x) for i, t, s in texts for f, x in (("t", t), ("s", s)) if x is not None}
    want = sorted((f, i, j) for (i, f, x), (j, g, y) in itertools.product(once, once) if f == g and i < j and x != y and confusables.skeleton(x) == confusables.skeleton(y))
    assert sorted(tuple(r) for r in confusables.lookalike_pairs(df, "id", ["t", "s"]).collect()) == want
    assert confusables.lookalike_pairs(df.limit(0), "id", ["t"]).count() == 0


# --- survivors --------------------------------------------------------------------------------


def test_survivors(spark):
    t = [datetime(2025, 1, d, tzinfo=UTC) for d in (1, 2, 3)]
    data = [(1, 10, "good a", "m", t[0]), (1, 11, "good b", None, t[1]), (1, 12, "bad", None, t[2]), (1, 11, "good b", None, t[1]), (2, 20, "good", "", t[0]), (3, 30, None, None, None), (3, 31, "good", None, None), (3, 32, "good", None, None), (None, 40, "good", "m", t[0])]
    df = spark.createDataFrame(data, "p long, o long, title string, model string, at timestamp").withColumns({"_key": F.lit(1), "several": F.lit(2), "source": F.lit(3)})
    got = {r.p: r for r in survivorship.survivors(df, "p", "o", "at", {"title": F.col("title").startswith("good"), "model": F.col("model") != ""}).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].title.source, got[1].title.value, got[1].model.source, got[1].several) == (11, "good b", 10, True)
    assert (got[2].title.source, got[2].model, got[2].several) == (20, None, False)
    assert (got[3].title.source, got[3].model) == (31, None)
    assert survivorship.survivors(df.limit(0), "p", "o", "at", {"title": F.lit(True)}).count() == 0


# --- tokens -----------------------------------------------------------------------------------

vocabulary = pytest.mark.skipif(not Path(tokenizing.vocabulary_path()).exists(), reason="no vocabulary files here")


@vocabulary
def test_encoding_is_that_of_the_library(spark):
    import tiktoken

    ranks = tokenizing.read_ranks(tokenizing.vocabulary_path())
    own = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(" abeinorst'ćšж\n0123😀<|>") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["<|endoftext|>", "a" * 5000, "0" * 3000, " \n\t ", "x9" * 2000, "it's we'LL", None, "", "Đon je izdržljiv. Ђон!", "é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = dict(tuple(r) for r in tokenizing.encode(df, "doc_id", "text").collect())
    for i, t in enumerate(texts):
        assert got[i] == (own.encode_ordinary(t) if t else []), t
        assert not t or own.decode(got[i]) == t
    n = dict(tuple(r) for r in tokenizing.count_tokens(df, "text", ["doc_id"]).collect())
    assert n == {i: len(x) for i, x in got.items()}
    assert tokenizing.encode(df.limit(0), "doc_id", "text").count() == 0


# --- mixes ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_the_totals(seed):
    rng = random.Random(seed)
    sizes = [float(rng.randrange(1, 500)) for _ in range(400)]
    chances = [0.3] * 400
    p = mixing.flight(sizes, chances, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(120, abs=1e-6)
    assert sum(a * b for a, b in zip(sizes, p, strict=True)) == pytest.approx(sum(a * b for a, b in zip(sizes, chances, strict=True)), rel=1e-9)
    q = mixing.landing(sizes, p)
    assert set(q) <= {0, 1}
    assert abs(sum(a * b for a, b in zip(sizes, q, strict=True)) - 0.3 * sum(sizes)) < 3


def test_sample_in_blocks(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "a", "a", "b"]), rng.randrange(1, 900), 0.4) for i in range(900)]
    df = spark.createDataFrame(data, "id long, source string, size long, chance double")
    got = mixing.balanced_sample(df, block=100).collect()
    assert len({r.id for r in got}) == len(got) == 900
    for s in "ab":
        want = sum(n * 0.4 for _, x, n, _ in data if x == s)
        assert abs(sum(r["size"] * r.taken for r in got if r.source == s) - want) < 0.01 * want
        assert abs(sum(r.taken for r in got if r.source == s) - 0.4 * sum(x == s for _, x, *_ in data)) <= 3


@vocabulary
def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["shoe"] * rng.randrange(1, 60)), rng.choice(["a", "a", "b", "c", None, "other"])) for i in range(600)] + [(900, None, "a"), (901, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"id": F.lit("clash"), "n_tokens": F.lit(0), "size": F.lit(1)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, "doc_id", "text", "source")
    cap = {"a": 1, "b": 2, "c": 3}
    assert all(0 <= r.copies <= cap[r.source] for r in mixed.collect())
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert got["gone"].reached_share == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert got[s].reached_share == pytest.approx(share, abs=0.002)
    assert mixing.mix(df.limit(0), targets, "doc_id", "text", "source").count() == 0
    assert {r.copies for r in mixing.mix(df, targets.limit(0), "doc_id", "text", "source").collect()} <= {0}


# --- languages --------------------------------------------------------------------------------

SAYINGS = {
    "bs": ["Pertle su prekratke, ali se lako mogu zamijeniti u svakoj prodavnici.", "Narudžba je stigla za {n} dana, a dostavljač je bio vrlo ljubazan."],
    "sr": ["Материјал се брзо суши па су ми ноге суве и после дуге шетње.", "Наручио сам број {n} и мало ми је тесан после ношења."],
    "sl": ["Paket je prišel v {n} dneh in poštar je bil zelo prijazen.", "Podplat je mehak in ne drsi niti na mokrem parketu."],
    "en": ["The outsole is firm and grips well even on wet asphalt.", "I ordered size {n} and it is slightly tight after some days of wear."],
    "de": ["Die Sohle ist weich und hält gut selbst auf nassem Pflaster.", "Ich habe Größe {n} bestellt und sie passt perfekt nach Tagen."],
    "it": ["La suola è robusta e non scivola anche sull'asfalto bagnato.", "La consegna è arrivata in {n} giorni e il postino è stato gentile."],
    "fr": ["La semelle est souple et ne glisse pas même sur un sol mouillé.", "J'ai commandé la pointure {n} et elle est un peu serrée."],
}


def test_languages(spark):
    rng = random.Random(3)
    docs, truth = [], {}
    for i in range(700):
        lang = rng.choice(list(SAYINGS))
        body = " ".join(rng.choice(SAYINGS[lang]).format(n=rng.randrange(60)) for _ in range(4))
        label = lang if rng.random() < 0.85 else rng.choice([None, "xx", "", "de", "bs"])
        docs.append((i, body, label))
        truth[i] = (lang, label)
    mixed = SAYINGS["sr"][0] + " " + SAYINGS["fr"][0] + " " + SAYINGS["sr"][1].format(n=3) + " Just go."
    docs += [(1000, mixed, "Serbian"), (1001, None, None), (1002, "", "en"), (1003, "42 | 43 | 44", None), (1004, "New in", None), (1005, " ".join(SAYINGS["en"] * 2000).format(n=1), "EN-us")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"kind": F.lit("clash"), "confidence": F.lit(1.0)})
    scores = languages.fit_scores(df, "doc_id", "text", "lang")
    got = {(r.doc_id, r.kind, r.lang): r.confidence for r in languages.language_cases(df, "doc_id", "text", "lang", scores).collect()}
    want = {(i, "label", lang) for i, (lang, label) in truth.items() if languages.named_language(label) != lang} | {(1000, "part", "sr"), (1000, "part", "fr")}
    assert set(got) == want
    assert all(0 <= c <= 1 for c in got.values())
    parts = languages.language_stretches(df, "doc_id", "text", scores).where("doc_id = 1000").orderBy("part").collect()
    assert [p.lang for p in parts][:3] == ["sr", "fr", "sr"]
    assert mixed[parts[1].start : parts[1].end].startswith("La semelle")
    none = df.limit(0)
    assert languages.language_cases(none, "doc_id", "text", "lang", languages.fit_scores(none, "doc_id", "text", "lang")).count() == 0


def test_languages_without_a_search(monkeypatch):
    """Texts taken as one language at once, and in small blocks, come out as the search finds them."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))): tuple(rng.gauss(0, 2.5) if k != 1 else -2.0 for k in range(7)) for _ in range(60)}
    scores = languages.Scores(words, np.zeros((languages.BUCKETS, 7), dtype=np.float32), 1.5)
    texts = ["", "...", "12 34", "одно", " ".join(["abc"] * 3000), "漢字 かな " * 9]
    texts += ["".join(rng.choice(list(words)) + rng.choice([" ", " ", " ", " ", " ", ". ", "\n"]) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    monkeypatch.setattr(languages, "BLOCK_WORDS", 500)
    got = list(languages.languages_of(texts, languages._Block(scores)))
    want = [languages.sentence_languages(t, scores) for t in texts]
    assert [{k: v[0] for k, v in g.items()} for g in got] == [{k: v[0] for k, v in w.items()} for w in want]
    assert all(abs(g[k][1] - w[k][1]) < 1e-9 for g, w in zip(got, want, strict=True) for k in g)
    assert [s[2] for s in languages.stretches("漢字 かな", scores)] == [languages.UNKNOWN]


def test_labels():
    for label, lang in [("bs-BA", "bs"), ("BS", "bs"), ("Deutsch", "de"), ("sr-Cyrl", "sr"), ("en_US", "en"), (" it ", "it"), ("xx", None), ("??", None), (None, None), ("", None)]:
        assert languages.named_language(label) == lang


# --- same product -----------------------------------------------------------------------------

BRANDS = [(1, "Gaklex", []), (2, "Skeke Sport", [])]


@pytest.mark.parametrize(("model", "parts"), [("Kegilubu Classic 3 plava", ("kegilubu", "classic", "3", "blue", "")), ("ZuvabokirRunner", ("zuvabokir", "runner", "", "", "")), ("SOSAPEFA TERRAIN V3 W", ("sosapefa", "terrain", "3", "", "women")), ("Zelokarux Glsde IV", ("zelokarux", "glide", "4", "", "")), ("Dozurama-Dash 5.0", ("dozurama", "dash", "5", "", "")), (None, ("", "", "", "", "")), ("", ("", "", "", "", ""))])
def test_models(model, parts):
    assert listings.model_parts(model, ("classic", "dash", "glide", "runner", "terrain", "trail")) == parts


def test_codes_and_colour_names():
    import re

    shapes = [(re.compile("[A-Z]{3}[0-9]{7}"), re.compile("[A-Z]{3}[0-9]{4}"), 7)]
    for sku, parts in [("ABC1234-100", ("ABC1234-100", "ABC1234")), ("Art. abc 1234/100", ("ABC1234-100", "ABC1234")), ("ABC1234", ("", "ABC1234")), ("H001234567", ("", "")), ("0000", ("", "")), (None, ("", "")), ("w" * 9000, ("", ""))]:
        assert listings.code_parts(sku, shapes) == parts
    names = listings.colour_names([(1, "Gaklex Black Label", []), (2, "Skeke Sport", ["Redline"])])
    assert names == {"black label"}
    assert listings.title_parts("Gaklex Black Label Nofu crna muške", names) == ("black", "men")
    assert listings.title_parts("Gaklex Black Label Nofu plava", names) == ("blue", "")


def catalogue():
    """Twenty words, each in two versions, for two audiences and in four colours, at three shops: one states no code, one no audience."""
    rng, out, i = random.Random(5), [], 1000
    for m in range(20):
        word = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
        line, colours = ("Trail", "Dash", "Court", "Glide")[m % 4], ("crna", "plava", "siva", "zlatna") if m % 3 else ("bijela", "crvena", "roza", "braun")
        for n, (version, who, colour) in enumerate(itertools.product("23", ("men", "women"), colours)):
            for shop in range(3):
                i += 1
                sku = f"{'KLM'[m % 3] * 3}{1000 + 10 * m + n // 4}-{100 + n}" if shop < 2 else None
                out.append((i, f"Gaklex {word} {line} {version} {colour}", "Gaklex", f"{word} {line} {version}", sku, None if shop == 1 else who))
    return out


def test_same_product(spark, monkeypatch):
    offers = [
        (1, "Gaklex Nofu Trail 3 crna muške", "Gaklex", "Nofu Trail 3", "ABC1234-100", "men"),
        (2, "GAKLEX NOFU TRAIL V3 BLACK", "GAKLEX", "NOFU TRAIL V3", "abc1234/100", "men"),
        (3, "Nofu Trail 3 by Gaklex | schwarz | Herren", None, "NofuTrail III", None, None),
        (4, "Gaklex Nofu Trail 3 plava muške", "Gaklex", "Nofu Trail 3", "ABC1234-107", "men"),
        (5, "Gaklex Nofu Trail 3 crna ženske", "Gaklex", "Nofu Trail 3", "ABC1234-114", "women"),
        (6, "Gaklex Nofu Trail 4 crna muške", "Gaklex", "Nofu Trail 4", None, "men"),
        (7, "Gaklex patike", "n/a", "Nofu Trail 3", "0000", "men"),  # no colour: its barcode decides
        (8, "Gaklex Nofu Trail 3", None, "Nofu Trail 3", None, "men"),  # black or blue: stays alone
        (9, None, None, None, None, None), (10, "", "", "", "", ""), (11, "z" * 20_000, "y" * 9_000, "x" * 9_000, "w" * 9_000, "men"), (1, "Gaklex Nofu Trail 3 crna muške", "Gaklex", "Nofu Trail 3", "ABC1234-100", "men"),
    ]
    codes = [(4, ["2000000000107", "0000000000000"]), (7, ["2000000000107 "]), (1, ["4006381333931"]), (2, None), (5, []), (6, ["1111111111111", "", None])]
    o = spark.createDataFrame(offers + catalogue(), "id long, title string, brand string, model string, sku string, gender string").withColumns({"node": F.lit(1), "word": F.lit("clash")})
    c = spark.createDataFrame(codes, "id long, gtins array<string>")
    b = spark.createDataFrame(BRANDS, "brand_id int, brand_name string, aliases array<string>")
    got = dict(tuple(r) for r in same_product.same_product(o, c, b).collect())
    assert set(got) == {*range(1, 12), *(r[0] for r in catalogue())}
    of = lambda ids: {frozenset(i for i in ids if got[i] == g) for g in {got[i] for i in ids}}
    assert of(range(1, 12)) == {frozenset(x) for x in ((1, 2, 3), (4, 7), (5,), (6,), (8,), (9,), (10,), (11,))}
    assert of(range(1001, 1961)) == {frozenset((i, i + 1, i + 2)) for i in range(1001, 1961, 3)}
    pairs = same_product.product_pairs(spark.createDataFrame([x for x in got.items() if x[0] < 12], "id long, group_id long"))
    assert rows(pairs) == [(1, 2), (1, 3), (2, 3), (4, 7)]
    assert same_product.same_product(o.limit(0), c, b).count() == 0


def test_weights_are_learned(spark):
    """A spelling that differs between listings of one code comes to count little, a colour that differs decides."""
    number = {k: i for i, k in enumerate(same_product.KINDS)}
    t = lambda kind, n: (n << 6) | number[kind]
    pairs = []
    for n in range(1, 200):
        pairs.append((n, [t("sku=", n), t("word~", 1), t("colours=", n % 5), 0]) if n % 3 == 0 else (n, [t("sku=", n), t("word=", n), t("colours=", n % 5), 0]))
        pairs.append((1000 + n, [t("word=", n), t("colours#", 1), 0] if n % 2 else [t("word=", n), t("colours=", n % 5), 0]))
    got = dict(rows(same_product._reinforced(spark.createDataFrame(pairs, "p long, terms array<long>")).select("p", "score")))
    assert all((got[n] >= same_product.THRESHOLD) for n in range(1, 200))  # without rounds every third has 0
    assert all((got[1000 + n] >= same_product.THRESHOLD) == (n % 2 == 0) for n in range(1, 200))
    assert same_product._reinforced(spark.createDataFrame([], "p long, terms array<long>")).count() == 0


def brute_scores(pairs):
    """Scores by the definition, pair by pair; ``pairs``: lists of terms, the last of which is 0."""
    odds = lambda x: math.log(min(max(x, same_product.LEAST), 1 - same_product.LEAST) / (1 - min(max(x, same_product.LEAST), 1 - same_product.LEAST)))
    score = [0.0 if any((t & 63) and (t & 63) % 2 == 0 for t in ts) else 1.0 for ts in pairs]
    while True:
        of_term, of_kind = {}, {}
        for ts, x in zip(pairs, score, strict=True):
            for t in ts:
                of_term.setdefault(t, []).append(x)
                of_kind.setdefault(t & 63, []).append(x)
        base = sum(score) / len(score)
        share = {k: (sum(xs) + same_product.SMOOTHING * (k % 2)) / (len(xs) + same_product.SMOOTHING) for k, xs in of_kind.items()}
        weight = {t: odds(base) if t == 0 else odds((sum(xs) + same_product.SMOOTHING * share[t & 63]) / (len(xs) + same_product.SMOOTHING)) - odds(base) for t, xs in of_term.items()}
        old, score = score, [1 / (1 + math.exp(-sum(weight[t] for t in ts))) for ts in pairs]
        if all(abs(x - y) <= same_product.STILL for x, y in zip(score, old, strict=True)):
            return score


def test_pairs_of_equal_terms_are_scored_once(spark, monkeypatch):
    """The rounds hold one row for each list of terms, and every pair comes out with the score of its definition."""
    number = {k: i for i, k in enumerate(same_product.KINDS)}
    t = lambda kind, n: (n << 6) | number[kind]
    rng, terms = random.Random(3), []
    for n in range(1, 60):
        for _ in range(rng.randint(1, 60)):
            terms.append([t("sku=", n), t("word=", n // 3), t("colours=", n % 5), 0] if n % 3 else [t("sku=", n), t("word~", 1), t("colours~", 1), 0])
        terms.append([t("word=", n // 3), t("colours#", 1) if n % 2 else t("colours=", n % 5), 0])
    monkeypatch.setattr(same_product, "COMMON", 0.05)  # most words and codes are not common
    held = []
    for name in ("cut", "cut_counted"):
        monkeypatch.setattr(same_product, name, lambda df, *a, f=getattr(same_product, name): (held.append(df.count()), f(df, *a))[1])
    got = dict(rows(same_product._reinforced(spark.createDataFrame(list(enumerate(terms)), "p long, terms array<long>")).select("p", "score")))
    want = brute_scores(terms)
    assert len(got) == len(terms) and all(abs(got[p] - x) < 1e-9 for p, x in enumerate(want))
    assert len(held) > 2 and set(held) == {len({tuple(x) for x in terms})}


def test_barcodes(spark):
    d = spark.createDataFrame([(["4006381333931", " 4 006381 333931", "4006381333932", "0000000000000", "", None, "abc", "04006381333931"],), (None,), ([],)], "g array<string>")
    assert [r[0] for r in d.select(listings.barcodes("g")).collect()] == [[4006381333931], [], []]
