"""EU sizes: reading them from labels, converting them, showing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# EU, US and UK sizes of the two conversion tables; the men's is also for unisex and kids.
MEN = [(39, 6.5, 6), (40, 7, 6.5), (41, 8, 7.5), (42, 8.5, 8), (43, 9.5, 9), (44, 10, 9.5), (45, 11, 10.5), (46, 12, 11.5), (47, 12.5, 12), (48, 13.5, 13)]
WOMEN = [(36, 5.5, 3.5), (37, 6.5, 4.5), (38, 7.5, 5.5), (39, 8, 6), (40, 9, 6.5), (41, 9.5, 7.5), (42, 10.5, 8)]
# Brands and audience whose UK sizes run half a size lower.
UK_LOWER = [("nike", "men")]
#: Blanks of every kind that labels hold.
BLANK = "[\\s\u00a0\u2000-\u200a\u202f\u3000\ufeff]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_eu_size(x: Column | str) -> Column:
    """decimal(4,2), or null where the label is no EU size; fractions are not held to the range."""
    c = F.lower(_c(x))
    c = F.regexp_replace(c, r"eur?\b|europe|velicina|veličina|br\.?", "")
    c = F.regexp_replace(c, r"^([^,]*),", r"$1.")
    c = F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+$", "")
    part = r"^(\d{1,2})[\s-](\d)/(\d)$"
    whole, over, under = (F.regexp_extract(c, part, i).try_cast("int") for i in (1, 2, 3))
    fraction = F.round(whole + F.try_divide(over.cast("double"), under.cast("double")), 2)
    plain = F.when(c.rlike(r"^\d{1,2}(\.\d)?$"), c.try_cast("double"))
    return F.when(c.rlike(part), fraction).otherwise(F.when(plain.between(15, 52), plain)).cast("decimal(4,2)")


def _lowered(by) -> Column:
    """The men's table with its UK sizes half a size lower; halves are rounded after the shift."""
    return by([(a, us, uk - 0.5) for a, us, uk in MEN], 2)


def convert_size(eu: Column | str, gender: Column | str, brand: Column | str | None = None) -> Column:
    """struct(us, uk): the table's row, or half sizes between its neighbours; null beyond the table.  Only women use the women's table."""
    e = _c(eu).cast("double")

    def by(rows: list[tuple[float, float, float]], k: int) -> Column:
        out = F.lit(None).cast("double")
        for lo, hi in zip(reversed(rows[:-1]), reversed(rows[1:]), strict=True):
            mid = F.lit(float(lo[k])) + (e - lo[0]) / (hi[0] - lo[0]) * (hi[k] - lo[k])
            out = F.when((e > lo[0]) & (e < hi[0]), F.round(mid * 2) / 2).otherwise(out)
        for r in rows:
            out = F.when(e == r[0], F.lit(float(r[k]))).otherwise(out)
        return out

    women = F.coalesce(_c(gender), F.lit("men")) == "women"
    us, uk = (F.when(women, by(WOMEN, k)).otherwise(by(MEN, k)) for k in (1, 2))
    if brand is not None:
        for name, who in UK_LOWER:
            hit = (F.trim(F.lower(_c(brand))) == name) & (F.coalesce(_c(gender), F.lit("men")) == who)
            uk = F.when(F.coalesce(hit, F.lit(False)), _lowered(by)).otherwise(uk)
    return F.struct(us.cast("decimal(4,1)").alias("us"), uk.cast("decimal(4,1)").alias("uk"))


def format_size(x: Column | str) -> Column:
    """44, 44½, 44⅔, 37⅓; other fractions as they are."""
    d = _c(x).cast("decimal(4,2)")
    whole = F.floor(d).cast("string")
    frac = ((d - F.floor(d)) * 100).cast("int")
    return F.when(frac == 0, whole).when(frac == 50, F.concat(whole, F.lit("½"))).when(frac == 33, F.concat(whole, F.lit("⅓"))).when(frac == 67, F.concat(whole, F.lit("⅔"))).otherwise(d.cast("string"))


def size_match(x: Column | str, chosen: list[float]) -> Column:
    """'exact', 'near' (a half or third of a chosen whole size) or null."""
    d = _c(x).cast("double")
    exact = d.isin([float(c) for c in chosen])
    near = F.exists(F.array(*[F.lit(float(c)) for c in chosen if float(c).is_integer()]).cast("array<double>"), lambda s: (d > s) & (d < s + 1))
    return F.when(exact, "exact").when(near, "near")


def size_chips(sizes: Column | str, chosen: list[float], room: int) -> Column:
    """At most ``room`` sizes: matches first, filled up with the smallest, shown ascending."""
    s = F.array_sort(F.transform(_c(sizes), lambda x: x.cast("double")))
    hits = F.filter(s, lambda x: size_match(x, chosen).isNotNull())
    hits = F.slice(hits, 1, room)
    rest = F.slice(F.filter(s, lambda x: ~F.array_contains(hits, x)), F.lit(1), F.greatest(F.lit(0), room - F.size(hits)))
    return F.array_sort(F.concat(hits, rest))


def parse_size_list(x: Column | str) -> Column:
    """Sizes of a comma list: numbers from 15 to 52, once each, ascending."""
    n = F.transform(F.split(_c(x), ","), lambda t: F.trim(t).try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(n, lambda v: v.isNotNull() & v.between(15, 52))))
