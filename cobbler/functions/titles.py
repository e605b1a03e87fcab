"""Model names out of shop titles.

A title is read once, as runs of letters and what stands between them.  Every run has a class: a word
for the goods, a word for who wears them, a word of an age phrase, or none.  What has a class goes, the
brand goes from the front, and what is left is the model's name.  Some shops lose letters on the way:
a question mark inside a run stands for one letter that is not known (``LOST``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cobbler.functions.text import search_text

# Brands written in several ways, by their folded spellings.
BRAND_NAMES = {"361": "361 Degrees", "361°": "361 Degrees", "361 degrees": "361 Degrees"}
# Words for the goods and for who wears them, folded; "za" may stand before the latter.
GOODS = "patike tenisice obuca cipele sneaker sneakers shoes".split()
WEARERS = """muskarce muskarci muske muski zenske zena zene zenu unisex bebe
djecaci djecak djecaka djecake djecaki djecija djecije djeciji djeca djecu djevojcica djevojcice
decaci decak decaka decake decaki decija decije deciji deca decu devojcica devojcice""".split()
# The words of an age phrase ("uzrasta 4-8 godina"), folded.
AGED, YEARS = ["uzrasta"], ["godin", "godina", "godine", "godini"]
# What a search word also means.
SYNONYMS = {"tenisice": ["patike"], "superge": ["patike"], "starke": ["patike"], "obuca": ["patike", "cipele"], "sneakers": ["patike"], "sneaker": ["patike"], "kopacke": ["kopacke", "patike"]}

#: The sign that stands for a lost letter.
LOST = "?"
_KINDS = {w: kind for kind, words in (("goods", GOODS), ("wearer", WEARERS), ("aged", AGED), ("years", YEARS), ("for", ["za"])) for w in words}
_RUNS = re.compile(r"((?:[^\W\d_]|(?<=[^\W\d_])[?](?=[^\W\d_]))+)")
_VOWELS = frozenset("AEIOU")


def folded_name(text: str) -> str:
    """Lower case without accents, single blanks."""
    plain = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


def word_kind(run: str) -> str | None:
    """'goods', 'wearer', 'aged', 'years', 'for' or None; a lost letter may be any letter."""
    word = folded_name(run)
    if LOST not in word:
        return _KINDS.get(word)
    return next((kind for known, kind in _KINDS.items() if len(known) == len(word) and all(a in (b, LOST) for a, b in zip(word, known, strict=True))), None)


def _without_kinds(title: str) -> tuple[str, str]:
    """The title without the words that have a kind, single blanks; and its first word for goods."""
    pieces = _RUNS.split(title)  # between, run, between, run, ..., between
    kinds = [word_kind(x) if i % 2 else None for i, x in enumerate(pieces)]
    gone = {i for i, kind in enumerate(kinds) if kind in ("goods", "wearer")}
    for i, kind in enumerate(kinds):
        beside = pieces[i + 1].strip() if 0 < i < len(pieces) - 2 else None
        if kind == "for" and beside == "" and kinds[i + 2] == "wearer":
            gone.add(i)
        elif kind == "aged" and beside is not None and kinds[i + 2] == "years" and not beside.strip("0123456789.,-– "):
            gone.update((i, i + 1, i + 2))
    return " ".join("".join(" " if i in gone else x for i, x in enumerate(pieces)).split()), next((x for x, kind in zip(pieces, kinds, strict=True) if kind == "goods"), "")


def title_case(text: str) -> str:
    """Gives shouted text its capitals; words with digits, of two letters or without vowels, and Roman numbers up to four signs stay as they are."""
    if text != text.upper() or text == text.lower():
        return text
    out, word = [], ""
    for c in f"{text} ":
        if c.isalnum() or c in "'’.":
            word += c
            continue
        keep = len(word) < 3 or not _VOWELS.intersection(word) or any(map(str.isdigit, word)) or (len(word) < 5 and not word.strip("IVX"))
        out += [word if keep else word.capitalize() if word[0].isalpha() else word[0] + word[1:].lower(), c]
        word = ""
    return "".join(out)[:-1]


def canonical_brand(brand: str | None) -> str | None:
    """The name a brand is shown by."""
    return BRAND_NAMES.get(folded_name(brand), brand) if brand else brand


def brand_spellings(brand: str | None) -> list[str]:
    """Every name of the brand, longest first."""
    if not brand:
        return []
    shown = canonical_brand(brand)
    return sorted({brand, shown, *(k for k, v in BRAND_NAMES.items() if v == shown)}, key=lambda x: (-len(x), x))


def is_placeholder(model: str) -> bool:
    """Only words for goods."""
    return not any(x.strip() for i, x in enumerate(_RUNS.split(model)) if not (i % 2 and word_kind(x) == "goods"))


def clean_model(title: str | None, brand: str | None) -> str | None:
    """The title without goods, age and wearers, and without the brand at its front; never empty unless the title is.

    Where nothing else is left, the word for the goods is the model; a null title gives null.
    """
    if title is None:
        return None
    rest, goods = _without_kinds(title)
    names = [n.lower() for n in brand_spellings(brand)]
    at = 0
    while (low := rest[at:].lower().lstrip()) and (hit := next((n for n in names if low.startswith(n) and not low[len(n) : len(n) + 1].isalpha()), None)):
        at = len(rest) - len(low) + len(hit)
    return title_case(rest[at:].strip() or goods or rest or title.strip())


def expanded(x: Column | str) -> Column:
    """The words of a query and what they also mean, once each, in order."""
    also = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in dict.fromkeys([k, *v])]))])
    words = F.filter(F.split(search_text(x), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(also[w], F.array(w)))))


def cleaned_models(title: Column, brand: Column) -> Column:
    """``clean_model`` over Arrow batches; the brand stands in the pattern, which SQL can't express."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, b in batches:
            yield pd.Series([clean_model(x, y) for x, y in zip(t, b, strict=True)], dtype="object")

    return clean(title, brand)
