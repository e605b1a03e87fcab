"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import datetime
import decimal
import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6f}"
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else str(x)


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = entry.queries()[name](spark, str(DATA))
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), cols)


#: Of queries without SQL: the key that no two rows share, the rows that the tables make certain, and what must hold for each row.
LISTINGS, DOCUMENTS = "SELECT count(*) FROM normalized_offer", "SELECT count(*) FROM documents"
SHAPES = {
    "p3_found": ("size_id", None, "eu_x100 between 2700 and 4850"),
    "p3_sizes": ("size_id", "SELECT count(DISTINCT size_id) FROM normalized_size WHERE regexp_matches(size_raw, '[0-9]')", "status in ('converted', 'review') and confidence between 0 and 1"),
    "search_fuzzy_title": ("group_key", None, "min_price <= max_price"),
    "suggest_fuzzy": ("family", None, "score > 0"),
    "clean_models": ("offer_id", LISTINGS, "model is not null"),
    "named_models": ("offer_id", LISTINGS, "model is not null"),
    "match_clusters": ("id", "SELECT count(*) FROM match_candidate", "cluster <= id"),
    "match_methods": ("id", "SELECT count(*) FROM match_candidate", "method in ('gtin', 'style_code', 'fuzzy')"),
    "normalize_offers": ("offer_id", LISTINGS, "error is not null or (price > 0 and (original_price is null or original_price > price))"),
    "redact_text": ("doc_id", DOCUMENTS, "secrets is null or secrets >= 0"),
    "trgm_word_similarity": ("offer_id", LISTINGS, "score is null or score between 0 and 1"),
}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_shape_without_sql(spark, con, name):
    if name not in SHAPES:
        assert entry.queries()[name].__module__.startswith("cobbler.llm")  # its own tests hold it
        return
    key, count, holds = SHAPES[name]
    rows = entry.queries()[name](spark, str(DATA)).cache()
    n = rows.count()
    assert (n > 0 or key in ("group_key", "family")) and n == rows.select(*key.split()).distinct().count()
    assert count is None or n == con.execute(count).fetchone()[0]
    assert rows.where(f"not coalesce({holds}, false)").count() == 0
    rows.unpersist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_in_the_core_imports_the_optional_package():
    root = Path(importlib.util.find_spec("cobbler").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "cobbler.llm" not in p.read_text(), p
