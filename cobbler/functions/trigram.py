"""Trigram similarities as higher-order expressions: JVM-side, no UDF (but for word extents)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trigrams(x: Column | str) -> Column:
    """Ordered trigrams of each alphanumeric run, padded by two blanks before and one after; repeats stay."""
    runs = F.filter(F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(runs, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))))


def whole_trigrams(x: Column | str) -> Column:
    """Ordered trigrams of the whole text, padded once; punctuation stays."""
    padded = F.concat(F.lit("  "), _c(x), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(_c(x)) + 1), lambda i: F.substring(padded, i, 3))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either side is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(a, b))), F.lit(0.0))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Word-wise trigram similarity."""
    return jaccard(trigrams(a), trigrams(b))


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """Trigram similarity of whole texts, which must be folded already."""
    return jaccard(whole_trigrams(a), whole_trigrams(b))


def _extent(query: set[str], seq: list[str]) -> float:
    """The best similarity of a set with a contiguous stretch of a sequence."""
    best, n = 0.0, len(query)
    if not n:
        return 0.0
    spots = [i for i, t in enumerate(seq) if t in query]
    for a in spots:  # the best stretch begins and ends at a shared trigram
        seen: set[str] = set()
        hits = 0
        for k in range(a, len(seq)):
            t = seq[k]
            if t not in seen:
                seen.add(t)
                hits += t in query
            if t in query:
                best = max(best, hits / (n + len(seen) - hits))
            if len(seen) > n / max(best, 1e-9):
                break
    return best


def _runs(text: str) -> list[str]:
    return [f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", text.lower()) if w for i in range(len(w) + 1)]


def word_similarity(query: Column, text: Column) -> Column:
    """How well the query's trigrams match the best stretch of the text's; Arrow batches of plain strings."""

    @F.pandas_udf("double")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series([None if a is None or b is None else _extent(set(_runs(a)), _runs(b)) for a, b in zip(q, t, strict=True)], dtype="float64")

    return best(query, text)
