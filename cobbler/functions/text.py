"""Text folding as Column expressions: the one place that both sides of a comparison use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks (Latin-1 and Latin Extended-A) and the letters they fold to.
MARKED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
FOLDED = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"
#: Blanks of every kind.
BLANK = "[\\s\u00a0\u2000-\u200a\u202f\u205f\u3000\ufeff]"
# Letters that fold to two.
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
# Typographic quotes and dashes and their plain forms.
TYPOGRAPHIC, TYPED = "‘’‚‛“”„‐‑‒–—―−", "''''\"\"\"-------"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_lower(x: Column | str) -> Column:
    """Lower case without accents; punctuation stays."""
    c = F.translate(F.lower(_c(x)), MARKED + TYPOGRAPHIC, FOLDED + TYPED)
    return reduce(lambda c, d: F.replace(c, F.lit(d), F.lit(DOUBLE[d])), DOUBLE, c)


def fold_diacritics(x: Column | str) -> Column:
    """Accents dropped, case kept."""
    c = F.translate(_c(x), MARKED + MARKED.replace("ı", "").upper(), FOLDED + _upper_folded())
    return reduce(lambda c, d: F.replace(c, F.lit(d), F.lit(DOUBLE[d])), DOUBLE, c)


def _upper_folded() -> str:
    return "".join(f.upper() for m, f in zip(MARKED, FOLDED, strict=True) if m != "ı")


def search_text(x: Column | str) -> Column:
    """Accents and case dropped, white space single; punctuation kept."""
    return F.btrim(F.regexp_replace(fold_lower(x), f"{BLANK}+", " "))


def folded(x: Column | str) -> Column:
    """Only a-z and 0-9 of the folded text, with nothing between."""
    return F.regexp_replace(fold_lower(x), "[^a-z0-9]+", "")


def spaced(x: Column | str) -> Column:
    """Each character that is not a-z or 0-9 becomes one space; not collapsed."""
    return F.regexp_replace(fold_lower(x), "[^a-z0-9]", " ")


def words(x: Column | str) -> Column:
    """The folded text's words, single spaces between."""
    return F.btrim(F.regexp_replace(fold_lower(x), "[^a-z0-9]+", " "))


def slugify(x: Column | str) -> Column:
    """Words joined by hyphens."""
    return F.btrim(F.regexp_replace(fold_lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def family_key(brand: Column | str, model: Column | str) -> Column:
    """The key of a model family: brand and model as one slug."""
    return slugify(F.concat(F.coalesce(_c(brand), F.lit("")), F.lit(" "), _c(model)))
