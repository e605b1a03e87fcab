"""What is sound in a result card: its title, model and picture address against its product's slug."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobbler.functions.text import words
from cobbler.llm.colours import CATEGORY_WORDS, COLOURS

# File names that stand for a picture that is missing.
NO_PICTURE = "placeholder|no[-_]?image|no[-_]?photo|spacer|blank|default|missing|pixel|logo"
#: Characters that no whole title has: cuts, mark-up, entities, templates, lost letters.
DAMAGE = r"[<>&;%?{}\[\]|\\…�]|\.\.|https?:"


def _name(slug: Column) -> tuple[Column, Column]:
    """The slug's words before its colour, and the colour."""
    return F.regexp_replace(F.regexp_extract(slug, r"^(.*)-[a-z]+$", 1), "-", " "), F.regexp_extract(slug, r"-([a-z]+)$", 1)


def sound_title(title: str, slug: str) -> Column:
    """Brand, model and colour are all there, with nothing but kind words beside, and undamaged."""
    name, colour = _name(F.col(slug))
    kinds = "|".join(CATEGORY_WORDS)
    said = F.btrim(F.regexp_replace(F.concat(F.lit(" "), words(title), F.lit(" ")), f"(?<= )(?:{kinds}) ", ""))
    known = reduce(lambda c, k: c.when(colour == k, F.lit(COLOURS[k])), list(COLOURS)[1:], F.when(colour == list(COLOURS)[0], F.lit(COLOURS[list(COLOURS)[0]]))).otherwise(colour)
    named = F.exists(F.split(known, " "), lambda w: said == F.concat(name, F.lit(" "), w))
    return (F.length(name) > 0) & ~F.col(title).rlike(DAMAGE) & named


def sound_model(model: str, slug: str, brand: str) -> Column:
    """The whole name of the model: what the slug has between brand and colour."""
    name, _ = _name(F.col(slug))
    said = words(model)
    after = F.concat(F.lit(" "), said)
    whole = F.when(F.col(brand).isNull(), F.endswith(name, after) & (said != "")).otherwise(name == F.concat(words(brand), after))
    return whole & ~F.col(model).rlike(DAMAGE)


def sound_picture(url: str) -> Column:
    """A whole address, of a picture file that is not a stand-in or a logo."""
    c = F.lower(F.col(url))
    return c.rlike(r"^https?://[a-z0-9.-]+\.[a-z]+/\S*[a-z0-9]\.(jpe?g|png|webp|avif)$") & ~F.regexp_extract(c, r"([^/]*)$", 1).rlike(NO_PICTURE)
