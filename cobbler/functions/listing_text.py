"""What listing texts of the shop platforms say: audience, model, style code, logo address.

Audiences are found by steps: the first step of a platform whose patterns all occur in the text it looks
at decides.  The steps are data, so the SQL of the check reads the same ones.

Defined results.  Null texts match nothing; a text that no step knows has a null audience.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A border between ASCII letters, digits and underscores and anything else, for engines whose own border knows more letters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Per platform the steps (text looked at, audience, patterns that must all occur in its lower case).
_KIDS, _WOMEN, _MEN = r"(bebe|djec|dje[čć]|djevoj|kids|junior)", r"([zž]ensk|[zž]en[ae]\b|women|wmns)", r"(mu[sš]k|\bmen\b)"
STEPS = {
    "json_ld": [
        ("title", "kids", [r"\b(bp|ps|td|gs)\b"]), ("prose", "kids", [_KIDS]), ("prose", "unisex", [_WOMEN, _MEN]), ("prose", "unisex", [r"\bunisex\b"]), ("prose", "women", [_WOMEN]), ("prose", "men", [_MEN]),
        ("title", "kids", [_KIDS]), ("title", "women", [r"\b(zene|žene|ženske|zenske|women|w|wmns)\b"]), ("title", "men", [r"\b(muskarce|muškarce|muške|muske|men|m)\b"]), ("title", "unisex", [r"\bunisex\b"]),
    ],
    "script": [
        ("attribute", "kids", [r"(d[j]?e[cč](a|ij|ak|ac)|d[j]?evoj[cč]|beb)"]), ("attribute", "women", [r"[zž]en"]), ("attribute", "men", [r"mu[sš]k"]), ("attribute", "unisex", [r"unisex"]),
        ("title", "kids", [r"(\bd[j]?e[cč](a|ij|ak|k)|d[j]?evoj[cč]|bebe|\bjr\b|junior)"]), ("title", "women", [r"(za\s+[zž]ene|[zž]enske|\bw\b|wmns)"]), ("title", "men", [r"(za\s+mu[sš]karce|mu[sš]ke)"]), ("title", "unisex", [r"unisex"]),
    ],
    "microdata": [
        ("both", "kids", [r"\bdje[cč]ij|\bdje[cč]j|\bkids?\b"]), ("both", "men", [r"\bmu[sš]k"]), ("both", "women", [r"\b[zž]ensk"]), ("both", "unisex", [r"\bunisex\b"]),
    ],
}
# Audience codes before a blank; where the head of a name ends; what its letters then begin with or hold.
CODES = {"DJ": "kids", "M": "men", "Z": "women", "U": "unisex"}
HEAD_ENDS = r"[Pp]ati|apti|kopa|cipel|perf|runn|ko[sš]ark|\p{Lu}{2}"
HEADS = [("unisex", "^unise"), ("kids", "^d|je[cčć]|bebe"), ("women", "^[zž]"), ("men", "^m|^u[sšz]")]
# Words for the goods in a name, labels of types at a model's front, file names that are no logo.
CATEGORY = r"(?:[Pp]ati[kc]|aptik|kopa[cč]k|cipel)\p{Ll}*(?:\p{Lu}(?=\s))?|PATI[KC][AE](?=\s)"
TYPES = [r"^(?:LS|GS)\s+(?=\S)", r"^(?:INDOOR|TURF|TREK|TRAIL SHOES)\s+(?=\S)"]
NO_LOGO = r"(?:no[_-]?image|placeholder|blank)\."


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def platform_audience(platform: str, title: Column | str, prose: Column | str | None = None, attribute: Column | str | None = None) -> Column:
    """The audience by the steps of a platform, or 'json_api': a code or the letters before the word for the goods."""
    if platform == "json_api":
        return _head_audience(_c(title))
    none = F.lit(None).cast("string")
    texts = {"title": F.lower(_c(title)), "prose": F.lower(none if prose is None else _c(prose)), "attribute": F.lower(none if attribute is None else _c(attribute))}
    texts["both"] = F.concat_ws(" ", F.coalesce(texts["prose"], F.lit("")), texts["title"])
    out = none
    for where, who, patterns in reversed(STEPS[platform]):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.coalesce(texts[where].rlike(p.replace(r"\b", EDGE)), F.lit(False))
        out = F.when(hit, who).otherwise(out)
    return out


def _head_audience(name: Column) -> Column:
    code = F.regexp_extract(name, r"^(DJ|M|Z|U)(?=\s)", 1)
    head = F.regexp_replace(F.lower(F.get(F.split(name, HEAD_ENDS), F.lit(0))), r"[^\p{L}]", "")
    out = F.lit(None).cast("string")
    for who, begins in reversed(HEADS):
        out = F.when(head.rlike(begins), who).otherwise(out)
    for c, who in CODES.items():
        out = F.when(code == c, who).otherwise(out)
    return out


def named_model(name: Column | str) -> Column:
    """The model in a name of audience, word for the goods, description and model.

    What stands before and in the word for the goods goes, then words without a capital or digit at the front, labels of types, a tail of colours with slashes, and closing brackets that nothing opened.
    """
    said = F.regexp_replace(_c(name), r"(\p{Ll})(\p{Lu}{2,})", "$1 $2")
    after = F.when(said.rlike(CATEGORY), F.regexp_extract(said, f"(?s)(?:{CATEGORY})(.*)$", 1)).otherwise(said)
    model = F.regexp_replace(F.btrim(after), r"^(?:[^\p{Lu}\d\s]+(?:\s+|$))+", "")
    for label in [*TYPES, r"\s+\S*/\S*$"]:
        model = F.regexp_replace(model, label, "")
    model = F.when(F.contains(model, F.lit("(")), model).otherwise(F.translate(model, ")", ""))
    return F.btrim(F.regexp_replace(model, r"\s+", " "))


def slug_code(url: Column | str) -> Column:
    """The style code that ends an address, in capitals; null where the end holds no digit."""
    last = F.regexp_extract(F.regexp_replace(_c(url), r"\?.*$", ""), r"([^/]*)$", 1)
    pattern = r"(?i)-([a-z0-9]{4,})(?:-(\d{2,3}))?$"
    head, tail = (F.regexp_extract(last, pattern, i) for i in (1, 2))
    return F.when(head.rlike(r"\d"), F.upper(F.concat_ws("-", head, F.nullif(tail, F.lit("")))))


def logo_address(src: Column | str, page: Column | str) -> Column:
    """The absolute address of a logo on ``page``; null for inline data, stand-ins and what is no web address."""
    s = F.btrim(F.regexp_replace(_c(src), r"^\s+|\s+$", ""))
    origin = F.regexp_extract(_c(page), r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(_c(page), r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    absolute = (
        F.when(s.rlike(r"(?i)^https?://[^/\s]"), s).when(s.rlike("^//"), F.concat(F.regexp_extract(_c(page), r"^(https?:)", 1), s))
        .when(s.rlike("^/"), F.concat(origin, s)).when(s.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(folder, F.lit("/"), s))
    )
    return F.when((s != "") & ~F.startswith(s, F.lit("data:")) & ~s.rlike(f"(?i){NO_LOGO}") & (origin != ""), absolute)
