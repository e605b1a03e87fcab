"""What is shown: page numbers, check times, object keys, picture and logo choices, audiences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone of shown times; file kinds by rank; words for the audience at the start of a word, in this order.
ZONE = "Europe/Sarajevo"
RANKS = {"svg": 0, "png": 1, "webp": 1}
AUDIENCE_MARKS = (("kids", "djecij djecj djecji kid kids"), ("men", "musk"), ("women", "zensk"), ("unisex", "unisex"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def page_window(page: int, pages: int) -> list[int | None]:
    """Page numbers around the current one, with both ends; None stands for a gap of two pages or more."""
    near = sorted({1, pages, *range(max(1, page - 1), min(pages, page + 1) + 1)})
    out: list[int | None] = []
    for a, b in zip([0, *near], near, strict=False):
        if b - a == 2:
            out.append(a + 1)
        elif b - a > 2:
            out.append(None)
        out.append(b)
    return out


def checked_at(x: Column | str, now: Column) -> Column:
    """'danas u 01:30', 'juče u 01:30' or the date, in the shop's zone."""
    local, today = F.from_utc_timestamp(_c(x), ZONE), F.to_date(F.from_utc_timestamp(now, ZONE))
    days = F.datediff(today, F.to_date(local))
    clock = F.date_format(local, "HH:mm")
    return F.when(days == 0, F.concat(F.lit("danas u "), clock)).when(days == 1, F.concat(F.lit("juče u "), clock)).otherwise(F.date_format(local, "d. M. yyyy."))


def is_stale(x: Column | str, now: Column, hours: int = 26) -> Column:
    return (now - _c(x)) > F.expr(f"interval {hours} hours")


def object_key(shop: Column | str, url: Column | str, version: str = "v3") -> Column:
    """version/products/shop/hash.webp"""
    return F.concat(F.lit(f"{version}/products/"), _c(shop), F.lit("/"), F.left(F.sha2(_c(url), 256), F.lit(32)), F.lit(".webp"))


def logo_rank(url: Column | str) -> Column:
    """Drawings before lossless pictures before the rest."""
    kind = F.lower(F.regexp_extract(_c(url), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit(2)
    for k, n in RANKS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def kept_picture(stored: Column | str, before: Column | str, now: Column | str) -> Column:
    """The stored picture if it was chosen against the first candidate and is still listed; else the new first."""
    s = _c(stored)
    chosen = ~s.eqNullSafe(F.get(_c(before), F.lit(0))) & F.coalesce(F.array_contains(_c(now), s), F.lit(False))
    return F.when(chosen, s).otherwise(F.get(_c(now), F.lit(0)))


def audience(text: Column | str) -> Column:
    """men, women, unisex or kids by words in a folded text; kids first."""
    out = F.lit(None).cast("string")
    for name, marks in reversed(AUDIENCE_MARKS):
        out = F.when(_c(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(marks.split())})"), name).otherwise(out)
    return out


# The forms of counted words after one, after two to four, and after the rest.
SHOPS, COLOURS = ("prodavnica", "prodavnice", "prodavnica"), ("boja", "boje", "boja")


def counted_word(n: Column | str, forms: tuple[str, str, str]) -> Column:
    """The form of a word after a count: by its last digit, but numbers that end in 11 to 14 take the last form."""
    digit, two = F.pmod(_c(n), F.lit(10)), F.pmod(_c(n), F.lit(100))
    return F.when(two.between(11, 14), forms[2]).when(digit == 1, forms[0]).when(digit.between(2, 4), forms[1]).when(_c(n).isNotNull(), forms[2])


def shown_range(page: int, per_page: int, total: Column | str) -> Column:
    """Prikazano 49-96 od 1.207."""
    last = F.least(F.lit(page * per_page), _c(total))
    return F.concat(F.lit(f"Prikazano {(page - 1) * per_page + 1}-"), last.cast("string"), F.lit(" od "), F.translate(F.format_number(_c(total), 0), ",", "."), F.lit("."))


def clicked_size(chosen: list[float], sizes: Column | str | None = None) -> Column:
    """The size a click counts for: on a card the only chosen one, in a product's row the first chosen one that the shop has."""
    want = F.array(*[F.lit(float(x)) for x in chosen]).cast("array<double>")
    if sizes is None:
        return F.when(F.lit(len(chosen) == 1), F.get(want, F.lit(0)))
    have = F.transform(_c(sizes), lambda x: x.cast("double"))
    return F.get(F.filter(want, lambda x: F.array_contains(have, x)), F.lit(0))
