"""The queries of the core's own data operators, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobbler.operators.bitemporal import Ledger, bitemporal_ledger
from cobbler.operators.units import to_eu_sizes
from cobbler.sources.tables import table

SNAPSHOT = {"keys": ["shop_id", "external_id"], "valid": "observed_at", "recorded": "ingested_at", "attrs": ["price_minor", "original_price_minor", "in_stock"], "required": ["price_minor", "in_stock"]}


def p3_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every size that names one, in EU sizes, with how its unit is known; uncertain ones for review."""
    return to_eu_sizes(table(spark, sf, "normalized_size"), table(spark, sf, "normalized_offer"), table(spark, sf, "size_chart"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes whose EU size is missing or wrong, with the right one."""
    rows = p3_sizes(spark, sf).where("status = 'converted'")
    wrong = F.col("size_eu").isNull() | (F.round(F.col("size_eu").cast("double") * 100).cast("int") != F.col("eu_x100"))
    return rows.where(wrong).select("size_id", "eu_x100")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The start of each version of each listing."""
    return Ledger(table(spark, sf, "offer_snapshot"), **SNAPSHOT).versions().select("shop_id", "external_id", "valid_from_us")


def p6_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The whole bitemporal ledger: what was believed when about which period."""
    rows = bitemporal_ledger(table(spark, sf, "offer_snapshot"), **SNAPSHOT)
    return rows.select("shop_id", "external_id", *SNAPSHOT["attrs"], *[F.unix_micros(c).alias(f"{c}_us") for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_sizes, p6_found, p6_ledger)}


P6_SQL = """
WITH latest AS (
  SELECT shop_id, external_id, observed_at, price_minor, original_price_minor, in_stock,
         row_number() OVER (PARTITION BY shop_id, external_id, observed_at ORDER BY ingested_at DESC, price_minor DESC, original_price_minor DESC, in_stock DESC) AS n
  FROM offer_snapshot WHERE price_minor IS NOT NULL AND in_stock IS NOT NULL),
stepped AS (
  SELECT *, lag(price_minor) OVER w AS p, lag(original_price_minor) OVER w AS o, lag(in_stock) OVER w AS s
  FROM latest WHERE n = 1 WINDOW w AS (PARTITION BY shop_id, external_id ORDER BY observed_at))
SELECT shop_id, external_id, epoch_us(observed_at) AS valid_from_us FROM stepped
WHERE p IS NULL OR p <> price_minor OR s <> in_stock OR o IS DISTINCT FROM original_price_minor
"""

# Of each reading, the later readings that were recorded earlier than any between: each shortens what was believed.
LEDGER_SQL = """
WITH said AS (
  SELECT DISTINCT ON (shop_id, external_id, v, r) shop_id, external_id, price_minor, original_price_minor, in_stock, v, r
  FROM (SELECT *, epoch_us(observed_at) AS v, greatest(coalesce(epoch_us(ingested_at), epoch_us(observed_at)), epoch_us(observed_at)) AS r FROM offer_snapshot)
  WHERE v IS NOT NULL AND shop_id IS NOT NULL AND external_id IS NOT NULL AND price_minor IS NOT NULL AND in_stock IS NOT NULL
  ORDER BY shop_id, external_id, v, r, price_minor DESC, original_price_minor DESC NULLS LAST, in_stock DESC),
reading AS (SELECT *, row_number() OVER () AS n, lead(r) OVER (PARTITION BY shop_id, external_id, v ORDER BY r) AS corrected FROM said),
later AS (
  SELECT i.n, i.r, i.corrected, j.v AS to_v, j.r AS to_r, min(j.r) OVER (PARTITION BY i.n ORDER BY j.v, j.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least
  FROM reading i JOIN reading j USING (shop_id, external_id) WHERE j.v > i.v),
cut AS (
  SELECT n, to_v, greatest(to_r, r) AS since, coalesce(lag(to_r) OVER (PARTITION BY n ORDER BY to_v), corrected) AS until
  FROM later WHERE (least IS NULL OR to_r < least AND least > r) AND (corrected IS NULL OR to_r < corrected)),
whole AS (
  SELECT n, NULL AS to_v, r AS since, coalesce(low, corrected) AS until
  FROM (SELECT i.n, i.r, i.corrected, min(c.since) AS low FROM reading i LEFT JOIN cut c USING (n) GROUP BY ALL) WHERE coalesce(low, corrected) IS NULL OR coalesce(low, corrected) > r)
SELECT shop_id, external_id, price_minor, original_price_minor, in_stock, v AS valid_from_us, to_v AS valid_to_us, since AS recorded_from_us, until AS recorded_to_us
FROM (SELECT * FROM cut UNION ALL SELECT * FROM whole) JOIN reading USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p6_ledger": LEDGER_SQL}
