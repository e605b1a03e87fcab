"""One consistent form for text that looks the same: a confusables skeleton.

The text is decomposed canonically, wide and restyled letters, digits and ligatures become plain ones,
characters that take no room are dropped, every character is replaced by the prototype of its
look-alike class, and the result is decomposed again.  Originals are grouped by equal skeletons.

Defined results.  Case and accents are kept apart, as are a hyphen and a space; a letter with a
combining accent equals the precomposed one.  Raised, lowered and circled signs and fractions look
different from plain ones.  Latin look-alikes of one script (I and l, O and 0) are kept apart.  A
Cyrillic word that could be read as a Latin one stays Cyrillic if the text has a Cyrillic letter that
looks like no Latin one; other Cyrillic words differ from any Latin word by such a letter, whatever
becomes of the rest.  White space at the ends is dropped.  Null has the skeleton null; a text of
invisible characters only, or an empty one, the empty skeleton.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobbler.plans.durable import written

# Letters that look like Latin ones in upright type, and those, by script, in two rows of equal length.
CYRILLIC = "аеорсухѕіјһԁԛԝӏүѵАВЕКМНОРСТУХЅІЈԚԜӀҮѴԌ"
CYRILLIC_LATIN = "aeopcyxsijhdqwlyvABEKMHOPCTYXSIJQWIYVG"
GREEK = "αινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_LATIN = "aivopucjABEZHIKMNOPTYXCJ"
LATIN = "ɡɑıȷɩᴏᴄᴠᴡᴢꜱᴜ"
LATIN_LATIN = "gaijiocvwzsu"
ARMENIAN = "օոսհցզյՕՍԼ"
ARMENIAN_LATIN = "onuhgqjOUL"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ"
CHEROKEE_LATIN = "ABCDEGHJKLMPRSTVWYZ"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲀⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲌ"
COPTIC_LATIN = "ABHIKMNOoPpCcTYXZ"
# The kinds of compatibility forms that are the same sign in another style or width.
STYLES = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Hyphens and dashes that read as a hyphen.
HYPHENS = "‐‑‒–﹘−⁃"
#: Quotes and primes that read as an apostrophe.
QUOTES = "‘’‛′ʼ＇"

_LOOK = ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN), (LATIN, LATIN_LATIN), (ARMENIAN, ARMENIAN_LATIN), (CHEROKEE, CHEROKEE_LATIN), (LISU, LISU_LATIN), (COPTIC, COPTIC_LATIN))
_TO_LATIN = {ord(a): b for rows in _LOOK for a, b in zip(*rows, strict=True)}
_PLAIN = {ord(c): "-" for c in HYPHENS} | {ord(c): "'" for c in QUOTES}
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--[\t\n\r]]", regex.V1)
_SPACE = regex.compile(r"[\p{Z}\t\n\r]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_OTHER = regex.compile(r"\p{Cyrillic}")
_LOOKALIKE = set(CYRILLIC)


@lru_cache(maxsize=100_000)
def _plain_style(c: str) -> str:
    """A character without its style or width; others as they are."""
    kind, _, points = unicodedata.decomposition(c).partition(" ")
    if kind not in STYLES:
        return c
    out = "".join(_plain_style(chr(int(x, 16))) for x in points.split())
    # a blank with an accent is a sign of its own
    return c if len(out) > 1 and out[0] == " " else unicodedata.normalize("NFD", out)


def _letters(word: str) -> list[str]:
    return [c for c in word if not unicodedata.combining(c)]


def skeleton(text: str | None) -> str | None:
    """The skeleton of one text."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text.strip()
    out = "".join(c if c < "\x80" else _plain_style(c) for c in unicodedata.normalize("NFD", text))
    out = _SPACE.sub(" ", _INVISIBLE.sub("", out)).translate(_PLAIN).strip()
    if not out.isascii():
        words = _WORD.findall(out)
        # does the text hold Cyrillic that can be nothing else?
        cyrillic = any(_OTHER.match(c) and c not in _LOOKALIKE for w in words for c in w)

        def form(m) -> str:
            word = m[0]
            letters = _letters(word)
            if cyrillic and len(letters) > 1 and all(c in _LOOKALIKE for c in letters):
                return word  # could be read either way: the text decides
            return word.translate(_TO_LATIN)

        out = _WORD.sub(form, out)
    return unicodedata.normalize("NFD", out)


def skeletons(text: Column) -> Column:
    """The skeleton of a text column; what is plain ASCII needs no Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(skeleton, na_action="ignore")

    ascii_ = text.rlike("^[ -~]*$")
    return F.when(ascii_, F.btrim(text)).otherwise(run(F.when(~ascii_, text)))


def lookalike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field_name, id_a, id_b), id_a < id_b: rows whose texts have one skeleton but other characters.

    Texts and skeletons are known by 128 bits of hash from the first step on.  Only skeletons that stand
    for two texts or more are joined, and equal texts are joined as one, so copies of a text never
    meet each other; two spellings meet once, whatever the number of their rows.  Of several rows under one
    id the one with the least hash counts.
    """
    mark = lambda c: F.struct(F.xxhash64(c).alias("u"), F.xxhash64(F.lit("again"), c).alias("v"))
    long = df.select(F.col(id_col).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields]))).where("raw is not null and id is not null")
    known = long.select("field_name", "id", mark(F.col("raw")).alias("raw"), mark(skeletons(F.col("raw"))).alias("skeleton"))
    rows = written(known, "skeletons").groupBy("field_name", "id").agg(F.min(F.struct("raw", "skeleton")).alias("s")).select("field_name", "id", "s.*")
    several = rows.groupBy("field_name", "skeleton").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field_name", "skeleton")
    hit = written(rows.join(several, ["field_name", "skeleton"]), "spellings")
    spelt = hit.select("field_name", "skeleton", "raw").distinct()
    twins = spelt.join(spelt.withColumnRenamed("raw", "twin"), ["field_name", "skeleton"]).where("raw <> twin").select("field_name", "raw", "twin")
    left = hit.select("field_name", "raw", F.col("id").alias("id_a")).join(twins, ["field_name", "raw"])
    right = hit.select("field_name", F.col("raw").alias("twin"), F.col("id").alias("id_b"))
    return left.join(right, ["field_name", "twin"]).where("id_a < id_b").select("field_name", "id_a", "id_b")
