"""Listings of the same product: bipartite reinforcement of term weights and pair scores.

A listing is reduced to terms (style code, style, barcodes, model word, line and version, colours,
audience, brand).  Listings that say exactly the same are one node; what is said without code and
barcodes is a profile.  Candidate pairs come from shared-term joins only: nodes with one style code
and nodes with one barcode meet that group's centre, and profiles of listings without a code meet
all profiles with the same model word, whatever their line, version, colours and audience.  A pair
holds a term for every value that both share, one for every field in which they differ, and one if they share all
that makes a product.  Then, alternately,

* the weight of a term is the mean score of the pairs that hold it, and
* the score of a pair is the chance of a match that its terms give together: their log-odds against
  those of a pair at large, added up,

until no score moves by more than ``STILL``.  Nothing is weighed by hand: that two colours tell
products apart and two spellings of a model do not is what the rounds find.  Pairs from
``THRESHOLD`` on are links.  A listing that leaves out its colour or audience is linked only if all
its partners are one product; groups are the connected components of the links.

Scale.  No join enumerates a group's pairs: groups of equal codes or barcodes are stars around
their centre, and profiles stand for all listings that say the same, so a block that holds a third
of all listings costs the square of what can be said about one model word, not of its listings.
Barcodes that stand with several style codes are no evidence.  Terms, pairs and links are
DataFrames; the brand list (``canonical.MOST_NAMES``) and the catalogue's grammar (``listings``) are
the only things collected.

Defined results.  Null or blank fields are unknown and contradict nothing.  A listing without a
model word, code and barcode is a product by itself.  Rows repeated under one id count once (the
one with the least node).  Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobbler.llm.canonical import MOST_NAMES
from cobbler.llm.components import group_pairs
from cobbler.llm.listings import SCHEMA, barcodes, learned_grammar, parsed
from cobbler.plans.durable import cut, cut_counted, drop_written, written

#: Score from which a pair is a link, and from which it may be one; change of a score that counts as none.
THRESHOLD, PLAUSIBLE, STILL = 0.5, 0.2, 0.02
#: Pairs of a term's kind that are added to the term's own, and pairs added to the kind's that all match, or none for a difference: few pairs tell little.
SMOOTHING = 50.0
#: A term weighs as much as a chance between this and one less this; the share of all pairs from which a term is common.
LEAST, COMMON = 0.001, 0.001
#: A misspelt model word is at most this often met, as a share of the sound one.
SLIP_SHARE = 0.2
#: What a profile says; the kinds of terms of a pair, by the number that a term's last bits hold.
PROFILE = ["word", "line", "version", "colours", "audience", "brand", "style"]
#: Odd numbers are shared values, even ones differences: of profiles (#), and beside a shared code or barcode (~), where they may be slips.
FIELDS = ("sku", "style", "gtin", "word", "model", "colours", "audience", "brand", "every")
KINDS = ["all", *[f"{k}{x}" for k in FIELDS for x in "=#"], *[f"{k}{x}" for k in FIELDS for x in " ~"]]


def _mended(listings: DataFrame) -> DataFrame:
    """Model words that are no style's usual one, one slip away from one that is and rare beside it, become that word.

    Words of fewer than five letters are too close to each other to tell slips.
    """
    usual = listings.where("style <> '' and word <> ''").groupBy("style", "word").agg(F.count("*").alias("n")).groupBy("style").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    own = usual.groupBy("word").agg(F.count("*").alias("own"))
    seen = listings.where("length(word) >= 5").groupBy("word").agg(F.count("*").alias("n"), F.max("brand").alias("b")).join(own, "word", "left")
    gone = F.expr("transform(sequence(0, length(word)), i -> if(i = 0, word, concat(left(word, i - 1), substr(word, i + 1))))")
    keyed = written(seen.withColumn("cut", F.explode(gone)), "slips")
    odd = keyed.where("own is null").select("cut", F.col("word").alias("odd"), F.col("b").alias("ob"), F.col("n").alias("on"))
    sound = keyed.where("own > 0").select("cut", "word", "b", "n")
    near = odd.join(sound, "cut").where(f"odd <> word and on <= {SLIP_SHARE} * n and (ob = 0 or b = 0 or ob = b)").groupBy("odd").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).where("lo = hi").select(F.col("odd").alias("word"), F.col("lo").alias("mended"))
    return listings.join(written(near, "mended"), "word", "left").withColumn("word", F.coalesce("mended", "word")).drop("mended")


def _most(c: str) -> Column:
    """The value of the largest node that has one; constant memory, however many nodes a code has."""
    empty = 0 if c == "brand" else ""
    return F.coalesce(F.max_by(F.col(c), F.struct(F.col(c) != empty, F.col("n"), F.col(c))), F.lit(empty))


#: The sign bit of a long: hubs (profiles and codes) have negative numbers and nodes others, so that the least label of a group is a hub's.
HUB = -(1 << 63)


def _hub(*what: Column | str) -> Column:
    return F.xxhash64(*what).bitwiseOR(F.lit(HUB))


def _profile() -> Column:
    return _hub(F.lit("profile"), *PROFILE)


def _whole(at: str = "") -> Column:
    return (F.col(f"{at}colours") != "") & (F.col(f"{at}audience") != "") & (F.col(f"{at}word") != "")


def _centres(nodes: DataFrame) -> DataFrame:
    """(sku, node, profile, what it says): of each code the largest node; what that leaves out the next largest says."""
    coded = nodes.where("sku <> ''")
    alone = coded.where("k = 1").select("sku", "node", *PROFILE)
    several = coded.where("k > 1").groupBy("sku").agg(F.min_by("node", F.struct(-F.col("n"), "node")).alias("node"), *[_most(c).alias(c) for c in PROFILE])
    return alone.unionByName(several).withColumn("profile", _profile())


def _candidates(nodes: DataFrame, gtins: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b, kind, x, y): candidate pairs of nodes (by 'code', 'barcode') and of profiles ('profile'), with what each says."""
    said = F.struct(*PROFILE, "sku").alias("x")
    by_code = nodes.where("k > 1").select("sku", F.col("node").alias("a"), said).join(centres.select("sku", F.col("node").alias("b"), said.alias("y")), "sku").where("a <> b").select("a", "b", F.lit("code").alias("kind"), "x", "y")
    # barcodes that stand with one style code at most; the centre is a node with that code, if there is one.
    # Nodes with a code meet by it, so only the others need their barcodes' centres
    clear = gtins.groupBy("gtin").agg(F.min(F.when(F.col("sku") != "", F.col("sku"))).alias("s1"), F.max("sku").alias("s2"), F.min(F.when(F.col("sku") != "", F.col("node"))).alias("coded"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    clear = clear.where("lo <> hi and coalesce(s1, '') = s2").select("gtin", F.coalesce("coded", "lo").alias("b"))
    met = gtins.where("sku = ''").select("node", "gtin").join(clear, "gtin").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    by_barcode = met.join(nodes.select(F.col("node").alias("a"), said), "a").join(nodes.select(F.col("node").alias("b"), said.alias("y")), "b").select("a", "b", F.lit("barcode").alias("kind"), "x", "y")
    free = nodes.where("sku = '' and word <> ''").select(_profile().alias("a"), said).dropDuplicates(["a"])
    coded = centres.where("word <> ''").select(F.col("profile").alias("b"), F.struct(*PROFILE, F.lit("").alias("sku")).alias("y")).dropDuplicates(["b"])
    there = coded.unionByName(free.where(_whole("x.")).select(F.col("a").alias("b"), F.col("x").alias("y")).join(coded.select("b"), "b", "left_anti"))
    by_word = free.withColumn("word", F.col("x.word")).join(there.withColumn("word", F.col("y.word")), "word").where("a <> b").select("a", "b", F.lit("profile").alias("kind"), "x", "y")
    return by_code.unionByName(by_barcode).unionByName(by_word)


def _terms() -> Column:
    """The terms of a pair: a hash of each value that both say, and of each field in which they differ; the last bits are the kind."""
    number = {k: i for i, k in enumerate(KINDS)}
    term = lambda kind, *value: F.xxhash64(F.lit(kind), *value).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(number[kind]).cast("long"))
    differs = lambda k: F.when(F.col("kind") == "profile", term(f"{k}#")).otherwise(term(f"{k}~"))
    out = [F.when(F.col("kind") == "barcode", term("gtin=", "a", "b"))]
    for k in ("sku", "style", "word", "colours", "audience", "brand"):
        x, y, none = F.col(f"x.{k}"), F.col(f"y.{k}"), F.lit(0 if k == "brand" else "")
        out.append(F.when((x != none) & (y != none), F.when(x == y, term(f"{k}=", x)).otherwise(differs(k))))
    # a name without line or version is a name as well
    x, y = (F.concat_ws(" ", f"{s}.line", f"{s}.version") for s in "xy")
    out.append(F.when((F.col("x.word") != "") & (F.col("y.word") != ""), F.when(x == y, term("model=", x)).otherwise(differs("model"))))
    # what is shared as a whole: fields are not independent of each other
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("word", "colours", "audience")]
    out.append(F.when(_whole("x.") & same[0] & same[1] & same[2] & (x == y), term("every=")))
    return F.array_append(F.array_compact(F.array(*out)), F.lit(0).cast("long"))  # the term of all pairs


def _reinforced(pairs: DataFrame) -> DataFrame:
    """``pairs`` (terms and what else is carried) with their score once weights and scores agree; to begin with, a pair matches if it differs in nothing.

    Pairs of equal terms have equal scores, so the rounds run over the distinct lists of terms, each with the number of its pairs.
    Terms that many pairs hold (colours, audiences, differences) are few; their sums come to the driver and
    their weights go out as constants.  The others, such as model words and codes, are summed in windows: none is held by more than
    ``COMMON`` of all pairs.  A round's numbers go out in arrays, so that all rounds are the same compiled code.
    """
    spark = pairs.sparkSession
    kind = lambda t: t.bitwiseAND(F.lit(63)).cast("int")
    numbers = lambda xs: F.split(F.lit(" ".join(map(repr, xs))), " ").cast("array<double>")
    differs = F.exists("terms", lambda t: (kind(t) > 0) & (F.pmod(kind(t), F.lit(2)) == 0))
    # a pair has ten terms at most, one of which all pairs hold, so at most 10 / COMMON of them are common
    rows = pairs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(math.ceil(10 / COMMON)).collect()
    if not rows:
        return pairs.drop("terms").withColumn("score", F.lit(0.0))
    held = [(r["t"], r["n"]) for r in rows if r["n"] >= COMMON * rows[0]["n"]]
    index = F.broadcast(spark.createDataFrame([(t, i) for i, (t, _) in enumerate(held)], "t long, i short"))
    alike = F.xxhash64("terms").alias("alike")
    lists = pairs.select(alike, "terms").groupBy("alike").agg(F.first("terms").alias("terms"), F.count("*").alias("m"))
    said = lists.select("alike", "m", F.when(differs, 0.0).otherwise(1.0).alias("score"), F.explode("terms").alias("t")).join(index, "t", "left")
    scores = cut(said.groupBy("alike").agg(F.first("m").alias("m"), F.first("score").alias("score"), F.collect_list("i").alias("common"), F.collect_list(F.when(F.col("i").isNull(), F.col("t"))).alias("rare")))
    odds = lambda x: math.log(min(max(x, LEAST), 1 - LEAST) / (1 - min(max(x, LEAST), 1 - LEAST)))
    of_term = Window.partitionBy("t")
    while True:
        # a row a common term, and one for all others of a kind: -1 less the kind
        held_by = scores.select(F.explode(F.concat(F.col("common").cast("array<int>"), F.transform("rare", lambda t: -1 - kind(t)))).alias("i"), "m", (F.col("m") * F.col("score")).alias("s"))
        sums = {r["i"]: (r["s"], r["n"]) for r in held_by.groupBy("i").agg(F.sum("s").alias("s"), F.sum("m").alias("n")).collect()}
        of_kind = {-1 - i: list(x) for i, x in sums.items() if i < 0}
        for i, (t, n) in enumerate(held):
            s, m = of_kind.get(t & 63, (0.0, 0))
            of_kind[t & 63] = [s + sums[i][0], m + n]
        base = of_kind[0][0] / of_kind[0][1]
        # until many pairs say otherwise, what is shared speaks for a match and what differs against it
        share = {k: (s + SMOOTHING * (k % 2)) / (n + SMOOTHING) for k, (s, n) in of_kind.items()}
        constants = numbers([odds(base) if t == 0 else odds((sums[i][0] + SMOOTHING * share[t & 63]) / (n + SMOOTHING)) - odds(base) for i, (t, n) in enumerate(held)])
        added, less = numbers([SMOOTHING * share.get(k, base) for k in range(64)]), numbers([odds(base)] * 64)
        rare = scores.select("alike", F.explode("rare").alias("t"), "m", (F.col("m") * F.col("score")).alias("s")).select("alike", "t", F.sum("s").over(of_term).alias("s"), F.sum("m").over(of_term).alias("n"))
        chance = F.greatest(F.least((F.col("s") + F.get(added, kind(F.col("t")))) / (F.col("n") + SMOOTHING), F.lit(1 - LEAST)), F.lit(LEAST))
        told = rare.select("alike", (F.log(chance / (1 - chance)) - F.get(less, kind(F.col("t")))).alias("w")).groupBy("alike").agg(F.sum("w").alias("w"))
        known = F.aggregate("common", F.lit(0.0), lambda a, i: a + F.get(constants, i))
        fresh = scores.join(told, "alike", "left").select("alike", "m", (1 / (1 + F.exp(-known - F.coalesce("w", F.lit(0.0))))).alias("score"), "common", "rare", F.col("score").alias("old"))
        fresh, moved = cut_counted(fresh, f"abs(score - old) > {STILL}")
        drop_written(scores)
        scores = fresh
        if not moved:
            return pairs.withColumn("alike", alike).drop("terms").join(scores.select("alike", "score"), "alike").drop("alike")


def _links(scored: DataFrame, nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b): links of nodes, and of nodes with the profiles that stand between them."""
    sure = scored.where(F.col("kind") != "profile").where(F.col("score") >= THRESHOLD).select("a", "b", "hub")
    # a profile that leaves something out needs partners that are one product
    may = scored.where((F.col("kind") == "profile") & (F.col("score") >= PLAUSIBLE)).select("a", "b", "score", "la", "lb", "pa", "pb")
    loose = may.where("la").select(F.col("a").alias("me"), F.col("pb").alias("them")).unionByName(may.where("lb").select(F.col("b").alias("me"), F.col("pa").alias("them")))
    torn = loose.groupBy("me").agg(F.min("them").alias("lo"), F.max("them").alias("hi")).where("lo <> hi").select("me")
    may = may.where(F.col("score") >= THRESHOLD).join(torn.withColumnRenamed("me", "a"), "a", "left_anti").join(torn.withColumnRenamed("me", "b"), "b", "left_anti").select("a", "b")
    # profiles stand for their nodes; a shared barcode decides for a listing that leaves something out
    decided = sure.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mine = nodes.where("sku = '' and word <> ''").select("node", _profile().alias("profile"), _whole().alias("whole"))
    mine = mine.where("whole").unionByName(mine.where("not whole").join(decided, "node", "left_anti")).select("node", "profile")
    # whole profiles that listings with and without a code share need no pair
    shared = centres.where(_whole()).select("profile").join(mine, "profile", "left_semi")
    linked = may.select(F.explode(F.array("a", "b")).alias("profile")).unionByName(shared).distinct()
    stand = mine.unionByName(centres.select("node", "profile")).join(linked, "profile").select(F.col("node").alias("a"), F.col("profile").alias("b"))
    # what shares a code meets at the code's hub, which every walk through a group finds first
    at_code = sure.select(F.explode(F.array("a", "b")).alias("a"), F.col("hub").alias("b")).where("a <> b")
    return at_code.unionByName(may).unionByName(stand)


def same_product(offers: DataFrame, codes: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, group_id) of every listing; group_id is a stable label.

    ``offers``: id, title, brand, model, sku, gender; ``codes``: id, gtins; ``brands``: id, name, aliases.
    """
    if (n := brands.count()) > MOST_NAMES:
        raise ValueError(f"{n} brands; the automaton is built for {MOST_NAMES} at most")
    names = [(int(r[0]), r[1], list(r[2]) if r[2] is not None else []) for r in brands.collect() if r[0] is not None]
    offers = offers.where("id is not null")
    said = [c for c in SCHEMA.names if c != "id"]
    held = codes.where("id is not null").select("id", barcodes("gtins").alias("g")).where("size(g) > 0").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("gtins"))
    listings = written(parsed(offers, names, learned_grammar(offers)).join(held, "id", "left"), "listings")
    apart = F.when((F.col("sku") != "") | _whole(), "").when(F.size("gtins") > 0, F.get("gtins", F.lit(0)).cast("string")).when(F.col("word") == "", F.concat(F.lit("id "), F.col("id").cast("string"))).otherwise("")
    # the node of a listing is the 63-bit hash of what it says: no join is needed to find it
    keyed = written(_mended(listings).withColumn("apart", apart).withColumn("node", F.xxhash64(*said, "apart").bitwiseAND(F.lit(~HUB))), "nodes")
    drop_written(listings)
    nodes = keyed.groupBy("node", *said).agg(F.count("*").alias("n"))  # the node stands for all that is said
    coded = nodes.where("sku <> ''").withColumn("k", F.count("*").over(Window.partitionBy("sku")))
    nodes = written(coded.unionByName(nodes.where("sku = ''").withColumn("k", F.lit(0).cast("long"))), "profiles")
    gtins = keyed.where("size(gtins) > 0").select("node", "sku", F.explode("gtins").alias("gtin"))
    centres = written(_centres(nodes), "centres")
    product = lambda s: F.xxhash64(*[f"{s}.{c}" for c in ("line", "version", "colours", "audience")])
    pairs = _candidates(nodes, gtins, centres).select("a", "b", "kind", _terms().alias("terms"), (~_whole("x.")).alias("la"), (~_whole("y.")).alias("lb"), F.when(F.col("y.sku") != "", _hub(F.lit("sku"), "y.sku")).otherwise(F.col("b")).alias("hub"), product("x").alias("pa"), product("y").alias("pb"))
    pairs = written(pairs, "pairs")
    scored = written(_reinforced(pairs), "scored")
    drop_written(pairs)
    links = written(_links(scored, nodes, centres), "links")
    drop_written(scored)
    groups = group_pairs(links, "a", "b").withColumnRenamed("id", "node")
    loose = (F.col("sku") == "") & ~_whole()
    out = keyed.groupBy("id").agg(F.min("node").alias("node")).join(nodes.select("node", loose.alias("loose")).join(groups, "node", "left"), "node")
    # nodes that say too little and found no partner are not known to be one product
    return out.select("id", F.coalesce("group_id", F.when(F.col("loose"), F.xxhash64(F.lit("alone"), "id")).otherwise(F.col("node"))).alias("group_id"))


def product_pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: every two listings of one group, without ever holding a group in one task."""
    left, right = groups.select(F.col("id").alias("a"), "group_id"), groups.select(F.col("id").alias("b"), "group_id")
    return left.join(right, "group_id").where("a < b").select("a", "b")
