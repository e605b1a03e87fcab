"""What a product listing says: brand, model, line, version, colours, audience, style code, barcodes.

How models and codes are written is learned from the catalogue itself (``Grammar``): the words that close
the names of many different models are line words, and the shapes in which codes are written in groups
("AAA9999-999") tell a style from the suffix of its colour, also where a code is written in one piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobbler.functions.text import words
from cobbler.llm.canonical import Names
from cobbler.llm.colours import COLOUR_OF
from cobbler.llm.folding import edit_distance, plain

#: Share of all pairs of a model's first and last word from which the last is a line word, and first words it must close at least.
LINE_SHARE, LINE_WORDS = 0.005, 3
#: Share of the codes written in groups from which their shape is a code's shape.
CODE_SHARE = 0.01
# Roman version numbers, and words for the audience.
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
AUDIENCE = {
    "men": "men mens m muske muski muskarce muskarci herren man uomo homme".split(),
    "women": "women womens w zenske zenski zene damen woman donna femme".split(),
    "unisex": "unisex u".split(),
    "kids": "kids kid jr djecije decije djecu decu djeca kinder gs bambini enfants".split(),
}
AUDIENCE_OF = {w: a for a, ws in AUDIENCE.items() for w in ws}
#: A label before a code, and what stands between a code's groups.
LABEL, APART = r"^\s*[A-Z]+\s*[.:#]\s*", r"[-_/\s]+"
_CAMEL = re.compile(r"(?<=[a-zčćžšđ])(?=[A-ZČĆŽŠĐ][a-z])")
_VERSION = re.compile(r"v?(\d{1,2})")

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("brand", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("word", "line", "version", "colours", "audience", "sku", "style")],
    ]
)


class Grammar(NamedTuple):
    """How a catalogue writes: its line words, and its codes as (shape of the style, shape of the suffix); 'A' is a letter, '9' a digit."""

    lines: tuple[str, ...]
    codes: tuple[tuple[str, str], ...]


def learned_grammar(df: DataFrame) -> Grammar:
    """Learned from all rows of ``df`` (model, sku); at most 1 / LINE_SHARE words and 1 / CODE_SHARE shapes reach the driver."""
    known = "|".join([*COLOUR_OF, *AUDIENCE_OF, *ROMAN, r"v?\d{1,2}"])
    said = F.regexp_replace(words(F.regexp_replace("model", "(\\p{Ll})(\\p{Lu}\\p{Ll})", "$1 $2")), f"(?: (?:{known}))+$", "")
    once = lambda x: F.explode(F.array(x))  # noqa: E731  conditions on x are not moved before it, where x would be computed again
    ends = df.select(once(said).alias("said")).where(F.contains("said", F.lit(" "))).select(F.substring_index("said", " ", 1).alias("first"), F.substring_index("said", " ", -1).alias("last")).distinct()
    counted = ends.groupBy("last").agg(F.count("*").alias("n"))
    sku = F.regexp_replace(F.upper("sku"), LABEL, "")
    groups = F.filter(F.split(sku, APART), lambda g: g != "")
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, r"\d", "9"), "[A-Z]", "A")
    cut = df.select(once(groups).alias("g")).where("size(g) > 1").select(once(F.struct(shape(F.array_join(F.slice("g", F.lit(1), F.size("g") - 1), "")).alias("first"), shape(F.element_at("g", -1)).alias("last"))).alias("s")).select("s.*")
    cut = cut.where(F.col("first").rlike("^A+9[A9]*$") & F.col("last").rlike("^9{2,4}$")).groupBy("first", "last").agg(F.count("*").alias("n"))
    lines = [r["last"] for r in _frequent(counted, LINE_SHARE) if r["n"] >= LINE_WORDS]
    return Grammar(tuple(sorted(lines)), tuple(sorted((r["first"], r["last"]) for r in _frequent(cut, CODE_SHARE))))


def _frequent(counted: DataFrame, share: float) -> list:
    """The rows that hold at least ``share`` of all of column n; there can't be more than 1 / share."""
    seen = Observation()
    rows = counted.observe(seen, F.sum("n").alias("all")).orderBy(F.desc("n"), *[c for c in counted.columns if c != "n"]).limit(math.ceil(1 / share)).collect()
    return [r for r in rows if r["n"] >= share * seen.get["all"]]


def model_parts(model: str | None, lines: tuple[str, ...]) -> tuple[str, str, str, str, str]:
    """(word, line, version, colours, audience) of a model text; typing slips in the line are mended."""
    ws = plain(_CAMEL.sub(" ", model)).split() if model else []
    version, colours, audience, kept = "", set(), "", []
    for w in ws:
        if w in COLOUR_OF:
            colours.add(COLOUR_OF[w])
        elif m := _VERSION.fullmatch(w):
            if not version and m[1] != "0":
                version = m[1]
        elif w in ROMAN and kept:
            version = version or ROMAN[w]
        elif w in AUDIENCE_OF and kept:
            audience = audience or AUDIENCE_OF[w]
        else:
            kept.append(w)
    line = ""
    if len(kept) > 1:
        if kept[-1] in lines:
            line = kept.pop()
        elif len(kept[-1]) > 2 and (close := [x for x in lines if edit_distance(kept[-1], x, 1 if len(x) < 5 else 2) <= (1 if len(x) < 5 else 2)]):
            line = min(close, key=lambda x: edit_distance(kept[-1], x, 2))
            kept.pop()
    word = "".join(kept)
    if not line:
        for x in lines:
            if word.endswith(x) and len(word) > len(x) + 3:
                word, line = word[: -len(x)], x
                break
    return word, line, version, "/".join(sorted(colours)), audience


def colour_names(names: list[tuple[int, str, list[str]]]) -> set[str]:
    """What follows the first word in the names of brands and holds a colour word: no colour of a shoe."""
    said = (plain(x).split() for _, name, aliases in names for x in [name, *aliases] if x)
    return {" ".join(ws[1:]) for ws in said if any(w in COLOUR_OF for w in ws[1:])}


def title_parts(title: str | None, names: set[str]) -> tuple[str, str]:
    """(colours, audience) of a title; ``names`` as ``colour_names`` gives them."""
    if not title:
        return "", ""
    folded = plain(title)
    for x in names:
        if x in folded:
            folded = re.sub(rf"\b{x}\b", " ", folded)
    colours, audience = set(), ""
    for w in folded.split():
        if w in COLOUR_OF:
            colours.add(COLOUR_OF[w])
        elif w in AUDIENCE_OF:
            audience = audience or AUDIENCE_OF[w]
    return "/".join(sorted(colours)), audience


def code_parts(sku: str | None, shapes: list[tuple[re.Pattern, re.Pattern, int]]) -> tuple[str, str]:
    """(whole code, style) of an article number; empty what it does not state."""
    if not sku:
        return "", ""
    text = re.sub("[^A-Z0-9]", "", re.sub(LABEL, "", sku.upper()))
    for whole, style, n in shapes:
        if whole.fullmatch(text):
            return f"{text[:n]}-{text[n:]}", text[:n]
        if style.fullmatch(text):
            return "", text
    return "", ""


def barcodes(column: str) -> Column:
    """The sound 13-digit codes of an array of barcode texts, as numbers; null and junk fall away."""
    number = lambda x: F.regexp_replace(x, r"\D", "").try_cast("long")
    # what each two digits add to the check sum: every other digit counts threefold
    two = F.array(*[F.lit(x % 10 + 3 * (x // 10)) for x in range(100)])

    def sound(n: Column) -> Column:
        total = F.get(two, F.pmod(n, F.lit(100)).cast("int"))
        for k in range(1, 7):
            total = total + F.get(two, F.pmod(F.call_function("div", n, F.lit(100**k)), F.lit(100)).cast("int"))
        return n.isNotNull() & n.between(10**7, 10**13 - 1) & (F.pmod(total, F.lit(10)) == 0) & (F.pmod(n, F.lit(1111111111111)) != 0)

    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), number), sound))


def parsed(df: DataFrame, names: list[tuple[int, str, list[str]]], grammar: Grammar) -> DataFrame:
    """``df`` has id, title, brand, model, sku, gender; one row of ``SCHEMA`` for each."""

    no_colours = colour_names(names)
    form = lambda x: x.replace("9", "[0-9]").replace("A", "[A-Z]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, brands, models = Names(names), {}, {}
        shapes = [(re.compile(form(a) + form(b)), re.compile(form(a)), len(a)) for a, b in grammar.codes]
        for pdf in batches:
            out = []
            for i, title, brand, model, sku, gender in zip(pdf.id, pdf.title, pdf.brand, pdf.model, pdf.sku, pdf.gender, strict=True):
                if len(brands) > 300_000:
                    brands.clear()
                if len(models) > 300_000:
                    models.clear()
                if (b := brands.get(brand)) is None:
                    _, entry, _ = known.of_value(brand, similar=False) if brand else ("", 0, None)
                    b = brands[brand] = entry or 0
                if (m := models.get(model)) is None:
                    m = models[model] = model_parts(model, grammar.lines)
                colours, audience = title_parts(title, no_colours)
                out.append((i, b, m[0], m[1], m[2], colours or m[3], gender or audience or m[4], *code_parts(sku, shapes)))
            yield pd.DataFrame(out, columns=SCHEMA.names)

    return df.select("id", "title", "brand", "model", "sku", "gender").mapInPandas(run, SCHEMA)
