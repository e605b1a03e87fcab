"""Matching of listings: codes, barcodes, and similar model names; clusters with guards; naming.

Codes and barcodes are equi-joins within a brand.  Similar names are found among the distinct names of
a brand by an exact prefix filter: each name's trigrams are ordered from rare to frequent, and two names
of Jaccard similarity t or more must share one of the first n - ceil(t n) + 1; candidates are verified.
Names stand for all listings that bear them, so copies are never paired.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.functions.trigram import jaccard, whole_trigrams
from cobbler.plans.durable import cut


def comparable_code(x: str) -> Column:
    """Capitals and digits of a code."""
    return F.regexp_replace(F.upper(F.col(x)), "[^A-Z0-9]", "")


def code_groups(listings: DataFrame) -> DataFrame:
    """(brand_key, code, first_id, listings, shops) of codes of five characters or more that several listings of a brand bear."""
    d = listings.withColumn("code", comparable_code("sku")).where("length(code) >= 5 and brand_key <> ''")
    return d.groupBy("brand_key", "code").agg(F.min("id").alias("first_id"), F.count("*").alias("listings"), F.count_distinct("shop_id").alias("shops")).where("listings > 1")


def barcode_links(listings: DataFrame) -> DataFrame:
    """(brand_key, first_id, id, barcodes): listings of a brand that share a barcode with the first that has it."""
    codes = listings.where("brand_key <> ''").select("brand_key", "id", F.explode("gtins").alias("gtin")).where("gtin <> ''").distinct()
    first = codes.groupBy("brand_key", "gtin").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return codes.join(first, ["brand_key", "gtin"]).where("id <> first_id").groupBy("brand_key", "first_id", "id").agg(F.count("*").alias("barcodes"))


def similar_names(names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(block, name_a, name_b, score) of distinct folded names of a block from the threshold on, name_a < name_b."""
    d = names.where("block <> '' and name <> ''").distinct().withColumn("grams", F.array_distinct(whole_trigrams("name")))
    freq = d.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    ordered = d.select("block", "name", F.explode("grams").alias("g")).join(freq, "g").groupBy("block", "name").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    n = F.size("o")
    keep = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    prefix = ordered.select("block", "name", n.alias("n"), F.explode(F.slice(F.transform("o", lambda x: x["g"]), F.lit(1), keep)).alias("g"))
    a, b = prefix.withColumnsRenamed({"name": "name_a", "n": "na"}), prefix.withColumnsRenamed({"name": "name_b", "n": "nb"})
    near = a.join(b, ["block", "g"]).where(f"name_a < name_b and na >= {threshold} * nb - 1e-9 and nb >= {threshold} * na - 1e-9").select("block", "name_a", "name_b").distinct()
    return near.withColumn("score", jaccard(whole_trigrams("name_a"), whole_trigrams("name_b"))).where(F.col("score") >= threshold)


#: Score, rounded to three places, from which a similar name is a link; widest span of a cluster's EU sizes; share of the shorter size list that must be common.
FUZZY_ACCEPT, MOST_SPAN, SIZES_SHARED = 0.82, 14, 0.5
_ADULT = ("men", "women", "unisex")


def similar_listings(listings: DataFrame) -> DataFrame:
    """(a, b, method, confidence), a < b: listings of a brand and of different shops with equal or similar names, which no code, audience or size contradicts.

    ``listings``: id, shop_id, brand_key, name (folded), code (comparable), gender, sizes.  Blank names are
    unknown and listings without sizes match by code or barcode only.  Equal codes of five characters or more
    are links by themselves and not repeated here.
    """
    d = listings.where("brand_key <> '' and name <> '' and size(sizes) > 0").select("id", "shop_id", "brand_key", "name", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("gender", F.lit("")).alias("gender"), "sizes")
    near = similar_names(d.select(F.col("brand_key").alias("block"), "name"), FUZZY_ACCEPT - 0.0005)
    pairs = near.select(F.col("block").alias("brand_key"), F.col("name_a").alias("name"), F.col("name_b").alias("other"), F.round("score", 3).alias("confidence"))
    pairs = pairs.where(F.col("confidence") >= FUZZY_ACCEPT)
    same = d.select("brand_key", "name", F.col("name").alias("other"), F.lit(1.0).alias("confidence")).distinct()
    x = d.withColumnsRenamed({c: f"{c}_x" for c in ("id", "shop_id", "code", "gender", "sizes")})
    y = d.withColumnsRenamed({"name": "other"} | {c: f"{c}_y" for c in ("id", "shop_id", "code", "gender", "sizes")})
    met = x.join(pairs.unionByName(same), ["brand_key", "name"]).join(y, ["brand_key", "other"]).where("(name <> other or id_x < id_y) and id_x <> id_y and shop_id_x <> shop_id_y")
    met = met.where("code_x = '' or code_y = '' or (code_x = code_y and length(code_x) < 5)")
    met = met.where((F.col("gender_x") == "") | (F.col("gender_y") == "") | (F.col("gender_x") == F.col("gender_y")) | (F.col("gender_x").isin(*_ADULT) & F.col("gender_y").isin(*_ADULT)))
    # a repeated size of the first listing counts as often as it stands there
    first = F.col("id_x") < F.col("id_y")
    sa, sb = F.when(first, F.col("sizes_x")).otherwise(F.col("sizes_y")), F.when(first, F.col("sizes_y")).otherwise(F.col("sizes_x"))
    shared = F.size(F.filter(sa, lambda s: F.array_contains(sb, s)))
    met = met.where(shared >= SIZES_SHARED * F.least(F.size(sa), F.size(sb)))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.lit("fuzzy").alias("method"), "confidence")


def plausible_clusters(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, cluster): members of clusters whose sizes (id, sizes) span more than ``MOST_SPAN`` are clusters of their own."""
    span = clusters.join(sizes.select("id", F.explode("sizes").alias("s")), "id").groupBy("cluster").agg((F.max("s") - F.min("s")).alias("span"))
    wide = span.where(F.col("span") > MOST_SPAN).select("cluster", F.lit(True).alias("wide"))
    return clusters.join(wide, "cluster", "left").select("id", F.when(F.col("wide"), F.col("id")).otherwise(F.col("cluster")).alias("cluster"))


def linked_components(edges: DataFrame) -> DataFrame:
    """(id, component): least labels over edges (a, b), halved in distance each round and cut from their past."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        fresh = cut(step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        labels = fresh.select("id", "label")
        if fresh.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def code_sets(listings: DataFrame) -> DataFrame:
    """(id, kind, value, confidence): each listing's codes of five characters or more and its barcodes, within its brand, where several listings bear them."""
    d = listings.where("brand_key <> ''")
    codes = d.where("length(code) >= 5").select("id", F.lit("style_code").alias("kind"), "brand_key", F.col("code").alias("key"), F.lit(0.99).alias("confidence"))
    bars = d.select("id", F.lit("gtin").alias("kind"), "brand_key", F.explode("gtins").alias("key"), F.lit(1.0).alias("confidence")).where("key <> ''").distinct()
    every = codes.unionByName(bars)
    several = every.groupBy("kind", "brand_key", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return every.join(several, ["kind", "brand_key", "key"]).select("id", "kind", F.to_json(F.struct("brand_key", "key")).alias("value"), "confidence")


def _unite(members, links) -> dict:
    """Cluster of each member of a component; the work of ``guarded_clusters``.

    Every pair of a set is a link, but pairs are not walked one by one: a refusal for a shop is final, as
    clusters only gain shops, so once one member of a cluster has met the rest of a set, no other member
    of it needs to.  A walk over a set jumps from shop to shop and skips clusters that are through with it.
    """
    parent = {i: i for i in members["id"]}
    shops = {i: {s} for i, s in zip(members["id"], members["shop_id"], strict=True)}
    shop = dict(zip(members["id"], members["shop_id"], strict=True))
    codes = {i: ({c} if isinstance(c, str) and c else set()) for i, c in zip(members["id"], members["code"], strict=True)}
    who = {i: ({g} if isinstance(g, str) and g else set()) for i, g in zip(members["id"], members["gender"], strict=True)}
    through: dict = {}  # sets that a cluster has met as a whole

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def apart(x, y):
        return any(g != h and not (g in _ADULT and h in _ADULT) for g in x for h in y)

    def link(a, b, method):
        a, b = root(a), root(b)
        if a == b or not shops[a].isdisjoint(shops[b]):
            return
        if method == "fuzzy" and ((codes[a] and codes[b] and not codes[a] & codes[b]) or apart(who[a], who[b])):
            return
        a, b = min(a, b), max(a, b)
        parent[b] = a
        shops[a] |= shops[b]
        codes[a] |= codes[b]
        who[a] |= who[b]
        if b in through:
            through.setdefault(a, set()).update(through.pop(b))

    for _, level in sorted(links.groupby("confidence"), key=lambda x: -x[0]):
        sets: dict = {}  # set -> shop -> [ids ascending, place of the first that is not through]
        mine: dict = {}  # id -> its sets and single links
        for r in level.sort_values(["a", "b"]).itertuples():
            if r.value:
                sets.setdefault(r.value, {}).setdefault(shop[r.a], [[], 0])[0].append(r.a)
                mine.setdefault(r.a, ([], []))[0].append(r.value)
            else:
                mine.setdefault(r.a, ([], []))[1].append((r.b, r.method))
        for a in sorted(mine):
            heap = [(b, 1, k, method) for k, (b, method) in enumerate(mine[a][1])]  # (b, single link?, ...): of equals sets come first
            walks: list = []

            def push(k, at, heap=heap, walks=walks, sets=sets):
                v, s = walks[k]
                ids, low = sets[v][s]
                while at < len(ids) and v in through.get(root(ids[at]), ()):
                    at += 1
                    low = at if low == at - 1 else low
                sets[v][s][1] = low
                if at < len(ids):
                    heapq.heappush(heap, (ids[at], 0, k, at))
                elif low == len(ids):
                    del sets[v][s]

            heapq.heapify(heap)
            for v in mine[a][0]:
                met = through.setdefault(root(a), set())
                if v in met:
                    continue
                met.add(v)
                for s in list(sets[v]):
                    walks.append((v, s))
                    push(len(walks) - 1, sets[v][s][1])
            while heap:
                b, single, k, x = heapq.heappop(heap)
                if single:
                    link(a, b, x)
                    continue
                s = walks[k][1]
                if s not in shops[root(a)]:
                    link(a, b, "set")
                    if s not in shops[root(a)]:
                        push(k, x + 1)
    return {i: root(i) for i in parent}


def guarded_clusters(edges: DataFrame, members: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(id, cluster): links are taken in order of confidence, then of ids, and refused where the two clusters share a
    shop or, for similar names, where codes or audiences contradict each other.

    The order decides, so a component of the links is one unit of work; edges are (a, b, method, confidence),
    members (id, shop_id, code, gender); sets (id, kind, value, confidence) link every two ids with the same
    kind and value, without naming the pairs.  Ids without a link are clusters of their own.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "method", "confidence", F.lit("").alias("value"))
    ties = links.select("a", "b")
    if sets is not None:
        named = sets.select("id", F.concat_ws(" ", "kind", "value").alias("value"), F.col("kind").alias("method"), "confidence").distinct()
        ties = ties.unionByName(named.join(named.groupBy("value").agg(F.min("id").alias("a")), "value").select("a", F.col("id").alias("b")).where("a <> b"))
        links = links.unionByName(named.select(F.col("id").alias("a"), F.col("id").alias("b"), "method", "confidence", "value"))
    comp = linked_components(ties)
    nodes = members.join(comp, "id").select("component", "id", "shop_id", "code", "gender")
    links = links.join(comp.withColumnRenamed("id", "a"), "a").select(F.col("component").alias("part"), "a", "b", "method", "confidence", "value")

    def unite(key, left, right):
        import pandas as pd

        found = _unite(left, right)
        return pd.DataFrame({"id": list(found), "cluster": list(found.values())})

    joined = nodes.groupBy("component").cogroup(links.groupBy("part")).applyInPandas(unite, "id long, cluster long")
    return members.select("id").join(joined, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def consensus(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value met most often per key; of equals the one without typographic signs, then the least."""
    counted = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    typographic = F.col(value).rlike("[’‘“”–—]")
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), typographic, F.col(value))).alias(value))


def claims(df: DataFrame, key: str, wish: str, votes: str) -> DataFrame:
    """Each wish goes to the key with most votes for it (of equals the least); losers get null."""
    best = df.where(F.col(wish).isNotNull()).groupBy(wish).agg(F.min_by(key, F.struct(-F.col(votes), F.col(key))).alias("winner"))
    return df.join(best, wish, "left").select(key, F.when(F.col(key) == F.col("winner"), F.col(wish)).alias(wish))


def uncertain_partners(listings: DataFrame) -> DataFrame:
    """(id, partners): to how many listings each is similar enough for a review and not for a link.

    ``listings`` as for ``similar_listings``, with gtins.  Listings that say the same are one class with a count,
    so copies are never paired; what shares a code or barcode is linked by it and not reviewed.
    """
    said = ["shop_id", "brand_key", "name", "code", "gender", "sizes", "gtins"]
    d = listings.where("brand_key <> '' and name <> '' and size(sizes) > 0").select("id", "shop_id", "brand_key", "name", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("gender", F.lit("")).alias("gender"), "sizes", F.filter("gtins", lambda g: g != "").alias("gtins"))
    classes = cut(d.groupBy(*said).agg(F.count("*").alias("n")).withColumn("c", F.xxhash64(*said)))
    near = similar_names(classes.select(F.col("brand_key").alias("block"), "name"), 0.6)
    pairs = near.where(F.round("score", 3) < FUZZY_ACCEPT).select(F.col("block").alias("brand_key"), F.col("name_a").alias("name"), F.col("name_b").alias("other"))
    one = lambda s: classes.select("brand_key", F.col("name").alias("name" if s == "x" else "other"), *[F.col(c).alias(f"{c}_{s}") for c in ("c", "n", "shop_id", "code", "gender", "sizes", "gtins")])
    met = pairs.join(one("x"), ["brand_key", "name"]).join(one("y"), ["brand_key", "other"]).where("shop_id_x <> shop_id_y and not arrays_overlap(gtins_x, gtins_y)")
    met = met.where("code_x = '' or code_y = '' or (code_x = code_y and length(code_x) < 5)")
    met = met.where((F.col("gender_x") == "") | (F.col("gender_y") == "") | (F.col("gender_x") == F.col("gender_y")) | (F.col("gender_x").isin(*_ADULT) & F.col("gender_y").isin(*_ADULT)))
    shared = F.size(F.array_intersect("sizes_x", "sizes_y"))
    met = met.where(shared >= SIZES_SHARED * F.least(F.size("sizes_x"), F.size("sizes_y")))
    both = met.select(F.inline(F.array(F.struct(F.col("c_x").alias("c"), F.col("n_y").alias("m")), F.struct(F.col("c_y").alias("c"), F.col("n_x").alias("m")))))
    return d.withColumn("c", F.xxhash64(*said)).join(both.groupBy("c").agg(F.sum("m").alias("partners")), "c").select("id", "partners")
