"""SQL that states the queries of this package, for those that SQL can state."""

from __future__ import annotations

from cobbler.functions.text import DOUBLE, FOLDED, MARKED, TYPED, TYPOGRAPHIC
from cobbler.llm.colours import CATEGORY_WORDS, COLOURS
from cobbler.llm.search_cards import DAMAGE, NO_PICTURE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(x: str) -> str:
    out = f"translate(lower({x}), {_q(MARKED + TYPOGRAPHIC)}, {_q(FOLDED + TYPED)})"
    for a, b in DOUBLE.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


#: Transitive closure by recursion: fit for the small tables of the SQL check.
P1 = """
WITH RECURSIVE link AS (
  SELECT offer_id_a AS a, offer_id_b AS b FROM match_result
  WHERE offer_id_a IS NOT NULL AND offer_id_b IS NOT NULL AND offer_id_a <> offer_id_b AND trim(match_method) <> ''),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
vertex AS (SELECT offer_id_a AS id FROM match_result WHERE offer_id_a IS NOT NULL UNION SELECT offer_id_b FROM match_result WHERE offer_id_b IS NOT NULL),
reach AS (SELECT id, id AS seen FROM vertex UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.seen)
SELECT id AS offer_id, min(seen) AS group_id FROM reach GROUP BY id
"""

_SHADES = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in COLOURS.items())
_KINDS = ", ".join(map(_q, CATEGORY_WORDS))
_FILE = "regexp_extract(lower(image_url), '([^/]*)$', 1)"
P7 = f"""
WITH named AS (
  SELECT *, replace(regexp_extract(product_slug, '^(.*)-[a-z]+$', 1), '-', ' ') AS name, regexp_extract(product_slug, '-([a-z]+)$', 1) AS colour,
    array_to_string([w for w in string_split({_words('title')}, ' ') if w NOT IN ({_KINDS})], ' ') AS said, {_words('model')} AS m, {_words('brand')} AS b
  FROM search_result WHERE product_id IS NOT NULL AND offer_id IS NOT NULL),
judged AS (
  SELECT product_id, offer_id, coalesce(checked_at, TIMESTAMPTZ '1900-01-01 00:00:00+00') AS seen,
    name <> '' AND NOT regexp_matches(title, {_q(DAMAGE)}) AND list_contains([name || ' ' || w for w in string_split(CASE colour {_SHADES} ELSE colour END, ' ')], said) AS title_ok,
    CASE WHEN b IS NULL THEN m <> '' AND ends_with(name, ' ' || m) ELSE name = b || ' ' || m END AND NOT regexp_matches(model, {_q(DAMAGE)}) AS model_ok,
    regexp_full_match(lower(image_url), 'https?://[a-z0-9.-]+\\.[a-z]+/\\S*[a-z0-9]\\.(jpe?g|png|webp|avif)') AND NOT regexp_matches({_FILE}, {_q(NO_PICTURE)}) AS image_ok
  FROM named),
best AS (
  SELECT product_id, count(DISTINCT offer_id) AS n, arg_max(offer_id, (seen, -offer_id)) FILTER (title_ok) AS title, arg_max(offer_id, (seen, -offer_id)) FILTER (image_ok) AS image_url, arg_max(offer_id, (seen, -offer_id)) FILTER (model_ok) AS model
  FROM judged GROUP BY 1)
SELECT product_id, f AS field_name, CASE f WHEN 'title' THEN title WHEN 'image_url' THEN image_url ELSE model END AS offer_id
FROM best, (VALUES ('title'), ('image_url'), ('model')) v(f) WHERE n > 1 AND CASE f WHEN 'title' THEN title WHEN 'image_url' THEN image_url ELSE model END IS NOT NULL
"""

SQL = {"p1_found": P1, "p7_found": P7}
