"""Quantities recorded in different units: shoe sizes brought to EU sizes.

A label is parsed into a number and, where the text names one, a unit.  Where it names none, the
unit is predicted by a random forest from the magnitude, the source (shop), the category
(audience) and neighbouring fields: the other size columns of the row and the units and magnitudes
of the listing's other rows.  The forest learns from rows whose unit is stated, either in the text
or by the one US or UK column that repeats the number and lies in that unit's range.  Its
confidence is calibrated by isotonic regression on rows it has not seen.  Votes for
units in which the number could be no size of the listing's audience are void.  Predictions from
``CONFIDENT`` on are converted; the rest is routed to review with its best guess.

Scale.  Parsing, features, prediction and conversion are JVM expressions over all rows.  The rows
of a listing are summed up before the shuffle and joined back by listing; a listing with a third of
all rows is split by adaptive skew handling.  The forest is fitted on at most ``FIT_ROWS`` stated
rows, chosen by hash of their id (a documented bound); the chart is a fixed table of some dozens
of rows, refused beyond ``MOST_CHART_ROWS`` and broadcast.

Defined results.  A label without a digit names no size and gets the status 'none'; a null label
likewise.  A row that occurs twice comes out once.  A US, UK or foot number that the chart does not
have gets the status 'review' and no size; an EU number must be a whole size, a half or a third
within the chart's range, else it keeps its size and gets 'review'.  Blanks of every kind are
blanks.  Empty tables give empty results; without stated rows to fit on and to calibrate by, the
confidence of unstated rows is 0 and they are reviewed.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.functions.text import BLANK
from cobbler.plans.durable import written

#: Calibrated confidence from which a predicted unit is believed.
CONFIDENT = 0.9
#: Stated rows the forest is fitted and calibrated on at most.
FIT_ROWS = 24_000
TREES, DEPTH, SEED = 12, 8, 7
MOST_CHART_ROWS = 10_000

UNITS = ("EU", "EU10", "US", "UK", "MM", "CM", "IN")
# How labels name their units, tried in this order on the lower-case label.  A mark is a word: no letter beside it.
UNIT_MARKS = (
    ("MM", ("mm", "mondo")), ("CM", ("cm", "stopalo", "dužina", "duzina", "jp")), ("IN", ("inch", "in", '"', "″", "”")),
    ("UK", ("uk", "eng")), ("US", ("usa", "us")), ("EU", ("eur", "eu", "br", "veličina", "velicina")),
)
FRACTIONS = {"½": " 1/2", "⅓": " 1/3", "⅔": " 2/3", "¼": " 1/4", "¾": " 3/4"}


def parsed_label(raw: str) -> tuple[Column, Column]:
    """(number, stated unit or null) of a size label."""
    c = F.lower(F.col(raw))
    for sign, text in FRACTIONS.items():
        c = F.replace(c, F.lit(sign), F.lit(text))
    # Java's white space knows no blank beyond ASCII
    c = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), BLANK, " ")
    # six digits are beyond any size in any unit; longer strings would be infinite
    whole = F.regexp_extract(c, r"(\d{1,6}(?:\.\d{1,6})?)", 1).try_cast("double")
    part = F.regexp_extract(c, r"\d[\s-]+(\d)/(\d)", 1).try_cast("double")
    of = F.regexp_extract(c, r"\d[\s-]+(\d)/(\d)", 2).try_cast("double")
    number = whole + F.coalesce(F.try_divide(part, of), F.lit(0.0))
    unit = F.lit(None).cast("string")
    for name, marks in reversed(UNIT_MARKS):
        any_mark = "|".join(rf"(?<!\p{{L}}){m}(?!\p{{L}})" if m.isalpha() else m for m in marks)
        unit = F.when(c.rlike(any_mark), F.lit(name)).otherwise(unit)
    return number, F.when((unit == "EU") & (number >= 100), F.lit("EU10")).otherwise(unit)


def _chart(chart: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    rows = chart.count()
    if rows > MOST_CHART_ROWS:
        raise ValueError(f"a size chart of {rows} rows; {MOST_CHART_ROWS} at most are broadcast")
    eu = F.round(F.col("size_eu").cast("double") * 100).cast("int")
    foot = chart.where("foot_mm is not null").select(F.lit("foot").alias("cu"), F.lit("").alias("cg"), F.col("foot_mm").cast("long").alias("cn"), eu.alias("ce"))
    us = chart.where("size_us is not null").select(F.lit("US").alias("cu"), F.col("gender").alias("cg"), F.round(F.col("size_us").cast("double") * 100).cast("long").alias("cn"), eu.alias("ce"))
    uk = chart.where("size_uk is not null").select(F.lit("UK").alias("cu"), F.col("gender").alias("cg"), F.round(F.col("size_uk").cast("double") * 100).cast("long").alias("cn"), eu.alias("ce"))
    span = chart.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in ("size_us", "size_uk", "size_eu") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {u: (span[f"lo_{c}"] if span[f"lo_{c}"] is not None else 1.0, span[f"hi_{c}"] if span[f"hi_{c}"] is not None else 0.0) for u, c in (("US", "size_us"), ("UK", "size_uk"), ("EU", "size_eu"))}
    lookup = foot.unionByName(us).unionByName(uk).groupBy("cu", "cg", "cn").agg(F.min("ce").alias("ce"))
    return lookup, ranges


FEATURES = ["number", "third", "half", "audience", "source", "eq_us", "eq_uk", "eq_eu", "no_eu", "has_us", "o_eu", "o_eu10", "o_us", "o_uk", "o_mm", "o_cm", "o_in", "low", "high", "n", "odd", "odd_share"]


def _odd() -> Column:
    """1.0 where a number is no whole, half or third, as foot lengths are."""
    sixths = F.col("number") * 6
    return F.when(F.abs(sixths - F.round(sixths)) > 0.03, 1.0).when(F.abs(F.col("number") * 2 - F.round(F.col("number") * 2)) < 0.01, 0.0).when(F.abs(F.col("number") * 3 - F.round(F.col("number") * 3)) < 0.03, 0.0).otherwise(1.0)


def _featured(sizes: DataFrame, offers: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    number, text_unit = parsed_label("size_raw")
    d = sizes.select("size_id", "offer_id", "size_eu", F.col("size_us").cast("double").alias("us"), F.col("size_uk").cast("double").alias("uk"), number.alias("number"), text_unit.alias("text_unit"))
    near = lambda a: F.coalesce(F.abs(F.col(a).cast("double") - F.col("number")) < 0.006, F.lit(False))
    within = lambda u: F.col("number").between(*ranges[u])
    column_unit = F.when(F.col("size_eu").isNull() & near("us") & ~near("uk") & within("US"), "US").when(F.col("size_eu").isNull() & near("uk") & ~near("us") & within("UK"), "UK")
    d = d.withColumns({"eq_us": near("us").cast("double"), "eq_uk": near("uk").cast("double"), "eq_eu": near("size_eu").cast("double"), "stated": F.coalesce("text_unit", column_unit)})
    # parsing costs most: it is done once, and rows that stand there twice go while they are narrow
    d = written(d.where("number is not null and offer_id is not null").dropDuplicates(["size_id"]), "parsed")
    sums = d.groupBy("offer_id").agg(
        *[F.count_if(F.col("stated") == u).alias(f"c_{u}") for u in UNITS],
        F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n"), F.avg(_odd()).alias("odd_share"),
    )
    who = offers.groupBy("offer_id").agg(F.max("gender").alias("gender"), F.max("shop_id").alias("shop_id"))
    listing = sums.join(who, "offer_id", "left")
    d = d.join(listing, "offer_id")
    own = lambda u: F.coalesce((F.col("stated") == u).cast("int"), F.lit(0))
    frac = F.col("number") - F.floor("number")
    return d.select(
        "size_id", "offer_id", "size_eu", "number", "stated", F.col("text_unit").isNotNull().alias("by_text"), "gender",
        (F.abs(F.abs(frac - 0.5) - 1 / 6) < 0.01).cast("double").alias("third"),
        (F.abs(frac - 0.5) < 0.01).cast("double").alias("half"),
        F.when(F.col("gender") == "men", 0.0).when(F.col("gender") == "unisex", 1.0).when(F.col("gender") == "women", 2.0).when(F.col("gender") == "kids", 4.0).otherwise(3.0).alias("audience"),
        F.coalesce(F.col("shop_id").cast("double"), F.lit(-1.0)).alias("source"),
        "eq_us", "eq_uk", "eq_eu", F.col("size_eu").isNull().cast("double").alias("no_eu"), F.col("us").isNotNull().cast("double").alias("has_us"),
        *[((F.col(f"c_{u}") - own(u)) / F.greatest(F.col("n") - 1, F.lit(1))).alias(f"o_{u.lower()}") for u in UNITS],
        "low", "high", F.col("n").cast("double").alias("n"), _odd().alias("odd"), "odd_share",
    )


def _audience_ranges(chart: DataFrame) -> DataFrame:
    """Per audience, and for an unknown one (null) overall, the range of each unit in the chart."""
    agg = [F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"span_{c}") for c in ("size_eu", "size_us", "size_uk", "foot_mm")]
    return chart.groupBy("gender").agg(*agg).where("gender is not null").unionByName(chart.agg(*agg).withColumn("gender", F.lit(None).cast("string")))


def _feasible() -> Column:
    """1.0 or 0.0 for each unit: could the number be a size of this audience in that unit?"""
    n = F.col("number")
    within = lambda c, x, slack: F.coalesce(x.between(F.col(f"{c}.lo") - slack, F.col(f"{c}.hi") + slack), F.lit(False)).cast("double")
    return F.array(
        within("span_size_eu", n, 1.0), within("span_size_eu", n / 10, 1.0), within("span_size_us", n, 0.01), within("span_size_uk", n, 0.01),
        within("span_foot_mm", n, 0.6), within("span_foot_mm", n * 10, 0.6), within("span_foot_mm", n * 25.4, 0.6),
    )


def _weighed(df: DataFrame) -> DataFrame:
    """``unit`` and raw confidence ``p``: the forest's votes among the units that are feasible."""
    # units that no fitted row has are missing at the end of the forest's votes
    votes = F.zip_with(vector_to_array("probability"), F.col("feasible"), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    df = df.withColumn("votes", votes)
    total = F.aggregate("votes", F.lit(0.0), lambda a, b: a + b)
    best = F.array_max("votes")
    return df.withColumns({"p": F.coalesce(F.try_divide(best, total), F.lit(0.0)), "best": F.array_position("votes", best) - 1})


def _predict(rows: DataFrame, chart: DataFrame) -> DataFrame:
    """``rows`` with ``unit`` and calibrated ``confidence`` for rows whose unit is not stated."""
    code = {u: float(i) for i, u in enumerate(UNITS)}
    label = F.create_map(*[F.lit(x) for u in UNITS for x in (u, code[u])])[F.col("stated")]
    stated = rows.where("stated is not null")
    n = stated.count()
    loose = rows.where("stated is null")
    unknown = loose.withColumns({"unit": F.lit("EU"), "confidence": F.lit(0.0)})
    if n == 0:
        return unknown
    step = 1_000_000
    bar = step if n <= FIT_ROWS else int(step * FIT_ROWS / n)
    spans = F.broadcast(_audience_ranges(chart).withColumnRenamed("gender", "span_of"))  # one row per audience of the checked chart
    overall = ["men", "women", "unisex", "kids"]
    with_spans = lambda d: d.join(spans, F.when(F.col("gender").isin(overall), F.col("gender")).eqNullSafe(F.col("span_of")), "left").withColumn("feasible", _feasible()).drop("span_of", "span_size_eu", "span_size_us", "span_size_uk", "span_foot_mm")
    fit = stated.where(F.pmod(F.xxhash64("size_id"), F.lit(step)) < bar).withColumn("label", label)
    fit = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_spans(fit)).select("size_id", "label", "features", "feasible").cache()
    held = F.pmod(F.xxhash64("size_id", F.lit(1)), F.lit(4)) == 0
    if fit.where(~held).isEmpty() or fit.where(held).isEmpty():
        fit.unpersist()
        return unknown
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, maxMemoryInMB=64).fit(fit.where(~held))
    seen = _weighed(model.transform(fit.where(held))).select("p", ((F.col("best") == F.col("label")) & (F.col("p") > 0)).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(seen)
    fit.unpersist()
    loose = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_spans(loose))
    out = _weighed(model.transform(loose))
    names = F.array(*[F.lit(u) for u in UNITS])
    out = out.withColumn("unit", F.get(names, F.col("best").cast("int")))
    # the calibration is a step function with few steps
    xs, ys = [float(x) for x in iso.boundaries], [float(y) for y in iso.predictions]
    at = F.array_size(F.filter(F.array(*map(F.lit, xs)), lambda x: x <= F.col("p")))
    # less sure than anything seen while calibrating: the raw votes, at most the first step
    low = F.least(F.col("p"), F.lit(ys[0]))
    out = out.withColumn("confidence", F.when(at == 0, low).otherwise(F.get(F.array(*map(F.lit, ys)), at - 1)))
    return out.drop("features", "rawPrediction", "probability", "prediction", "p", "best", "votes", "feasible")


def to_eu_sizes(sizes: DataFrame, offers: DataFrame, chart: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(size_id, size_eu, unit, how, confidence, status, eu_x100) of every row that names a size, once each.

    ``how`` is 'stated' or 'predicted'; ``status`` is 'converted' or 'review'.
    """
    lookup, ranges = _chart(chart)
    rows = written(_featured(sizes, offers, ranges), "sizes")
    cols = ["size_id", "size_eu", "number", "gender", "unit", "how", "confidence"]
    stated = rows.where("stated is not null").withColumns({"unit": F.col("stated"), "how": F.lit("stated"), "confidence": F.lit(1.0)}).select(cols)
    guessed = _predict(rows, chart).withColumn("how", F.lit("predicted")).select(cols)
    every = stated.unionByName(guessed)
    foot = F.when(F.col("unit") == "MM", F.round("number")).when(F.col("unit") == "CM", F.round(F.col("number") * 10)).when(F.col("unit") == "IN", F.round(F.col("number") * 25.4))
    every = every.withColumns(
        {
            "ku": F.when(foot.isNotNull(), "foot").otherwise(F.col("unit")),
            "kg": F.when(foot.isNotNull(), "").otherwise(F.col("gender")),
            "kn": F.coalesce(foot, F.round(F.col("number") * 100)).cast("long"),
        }
    )
    k = F.broadcast(lookup)  # some dozens of rows, checked above
    found = every.join(k, (F.col("ku") == k["cu"]) & (F.col("kg") == k["cg"]) & (F.col("kn") == k["cn"]), "left")
    eu = F.when(F.col("unit") == "EU", F.round(F.col("number") * 100)).when(F.col("unit") == "EU10", F.round(F.col("number") * 10)).otherwise(F.col("ce")).cast("int")
    out = found.select("size_id", "size_eu", "unit", "how", "confidence", eu.alias("eu_x100"))
    # EU numbers are not looked up: the chart leaves out thirds; a size is whole, a half or a third within its range
    low, high = (F.lit(round(x * 100)) for x in ranges["EU"])
    sound = ~F.col("unit").isin("EU", "EU10") | (F.col("eu_x100").between(low, high) & F.pmod("eu_x100", F.lit(100)).isin(0, 33, 50, 67))
    sure = (F.col("confidence") >= confident) & F.col("eu_x100").isNotNull() & sound
    return out.select("size_id", "size_eu", "unit", "how", "confidence", F.when(sure, "converted").otherwise("review").alias("status"), "eu_x100")
