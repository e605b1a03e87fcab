"""Amounts of money in minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: convertible marks to the euro.
BAM_PER_EUR = "1.95583"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price(x: Column | str) -> Column:
    """Minor units of a written price; the last separator is decimal only before exactly two digits."""
    c = F.regexp_replace(F.lower(_c(x)), "[\\s\u00a0\u2000-\u200a\u202f]|km|bam|eur|€", "")
    decimal = c.rlike(r"[.,]\d{2}$")
    digits = F.when(decimal, F.concat(F.regexp_replace(F.regexp_replace(c, r"[.,]\d{2}$", ""), "[.,]", ""), F.lit("."), F.right(c, F.lit(2)))).otherwise(F.regexp_replace(c, "[.,]", ""))
    return F.when(digits.rlike(r"^\d+(\.\d+)?$"), F.round(digits.try_cast("decimal(18,2)") * 100).cast("long"))


def to_eur_minor(amount: Column | str, currency: Column | str) -> Column:
    a = _c(amount)
    return F.when(_c(currency) == "EUR", a.cast("long")).when(_c(currency) == "BAM", F.round(a / F.lit(BAM_PER_EUR).cast("decimal(6,5)"), 0).cast("long"))


def format_price(amount: Column | str, currency: Column | str) -> Column:
    """129,90 KM or 49,99 €."""
    a = _c(amount)
    text = F.concat(F.floor(a / 100).cast("string"), F.lit(","), F.lpad(F.pmod(a, F.lit(100)).cast("string"), 2, "0"))
    return F.when(_c(currency) == "BAM", F.concat(text, F.lit(" KM"))).when(_c(currency) == "EUR", F.concat(text, F.lit(" €")))


def discount_percent(price: Column | str, old: Column | str) -> Column:
    """Whole percent off, half up; null unless the old price is higher."""
    p, o = _c(price), _c(old)
    return F.when(o > p, F.round((o - p) / o * 100, 0).cast("int"))


def format_count(n: Column | str) -> Column:
    """1.207"""
    return F.translate(F.format_number(_c(n), 0), ",", ".")
