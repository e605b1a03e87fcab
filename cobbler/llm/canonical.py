"""Mapping free-entered values to a canonical list.

A multi-pattern automaton holds every canonical name and alias, folded: with blanks between its words,
to be found inside a value, and in one piece, for values that are spaced otherwise.  The longest
non-overlapping mentions win.  A value is an entry if all its mentions name that entry and what is
left are words that say nothing; which words those are is learned from the values themselves: they
stand beside the names of many entries ("by", legal forms, countries).  What the automaton leaves
goes to token-set similarity: the words of the value against the words of each name, in any order and
with room for slips of the pen, weighed by their letters.  Only names that share one of the value's
rarest bigrams are compared.  Aliases that the list lacks are learned from context: rows that share
an unresolved value, and whose context texts mention one entry in most cases, mean that entry; a single
row is evidence only of a name that shares a word with the value.  A value found beside many different
entries (a placeholder) means none.

The list is the fixed reference side: it is collected, refused beyond ``MOST_NAMES`` entries, broadcast
once and made into an automaton once per Python worker.  The values are mapped in one pass without a
shuffle; only values that the pass leaves unresolved are aggregated and joined, by value, with partial
sums before the shuffle.

Defined results.  Null and blank values, and values that are byte for byte an entry, are no case.
A value without a letter names nothing: it maps to 0 whatever its context.  A value that names two
different entries, and a value that names a line (a name with a line word added) the list lacks,
maps to 0, as does everything unresolved.  Ties in similarity resolve to nothing.  Empty tables give
empty results.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobbler.llm.folding import edit_distance, plain
from cobbler.plans.durable import written

#: Entries the automaton is built for at most.
MOST_NAMES = 1_000_000
#: Share of an unresolved value's rows whose context must mention one entry for it to become an alias.
ALIAS_SHARE = 0.7
#: A word says nothing if it stands beside the names of at least so many entries, and of this share of them.
NOISE_ENTRIES, NOISE_SHARE = 5, 0.02
#: Share of a value's letters that must agree with a name's for the two to be similar.
LEAST_SIMILAR = 0.75
# Words that stand where a name is missing.
NO_NAMES = frozenset("n a na nan null nil none no name noname unknown nepoznato bez x xx xxx tbd test".split())


def _grams(key: str) -> set[str]:
    w = f"^{key}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


class Names:
    """The folded list with its automaton and its bigrams."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], noise: frozenset[str] = frozenset()):
        self.noise = noise
        first: dict[str, set[int]] = {}
        self.line_words: set[str] = set()
        self.names: list[tuple[str, int, str]] = []  # words in one piece, entry, digits
        self.holding: dict[str, list[int]] = {}
        self.words_of: dict[int, set[str]] = {}
        keyed: dict[str, int] = {}
        auto = ahocorasick.Automaton()
        for n, name, aliases in sorted(rows):
            for k, text in enumerate([name, *(aliases or [])]):
                if not text or not (words := tuple(plain(text).split())):
                    continue
                key = "".join(words)
                self.words_of.setdefault(n, set()).update(words)
                if keyed.setdefault(key, n) == n:
                    auto.add_word(f" {' '.join(words)} ", (n, len(" ".join(words)) + 2))
                    auto.add_word(f"|{key}|", (n, len(key) + 2))
                for g in _grams(key):
                    self.holding.setdefault(g, []).append(len(self.names))
                self.names.append((key, n, "".join(c for c in key if c.isdigit())))
                if k == 0:
                    first.setdefault(words[0], set()).add(n)
                    if len(words) > 1 and not words[-1].isdigit():
                        self.line_words.add(words[-1])
        # the first word of one entry only stands for it in "house of ..."
        self.first = {w: next(iter(x)) for w, x in first.items() if len(x) == 1}
        auto.make_automaton()
        self.auto = auto if len(auto) else None

    def mentions(self, folded: str) -> list[tuple[int, int, int]]:
        """(start, end, entry) of the longest non-overlapping mentions in folded text, in its order; of equal length the first."""
        if self.auto is None:
            return []
        hits = sorted((-size, end + 1 - size, n) for end, (n, size) in self.auto.iter(f" {folded} "))
        out: list[tuple[int, int, int]] = []
        for size, start, n in hits:
            # the blank between two names may belong to both
            if all(start >= b - 1 or start - size <= a + 1 for a, b, _ in out):
                out.append((start, start - size, n))
        return sorted(out)

    def in_context(self, text: str | None) -> int | None:
        """The one entry that a context text mentions; a name followed by a line word is another name."""
        if not text:
            return None
        folded = plain(text)
        hay = f" {folded} "
        found = {n for _, end, n in self.mentions(folded) if hay[end:].split(" ", 1)[0] not in self.line_words}
        return found.pop() if len(found) == 1 else None

    def around(self, words: list[str]) -> tuple[set[int], list[str]]:
        """The entries mentioned among the words, and the words beside the mentions."""
        hay = f" {' '.join(words)} "
        found = self.mentions(hay[1:-1])
        ends = [0, *[b - 1 for _, b, _ in found]]
        return {n for *_, n in found}, [w for a, b in zip(ends, [*[a + 1 for a, *_ in found], len(hay)], strict=True) for w in hay[a:b].split()]

    def similar(self, words: list[str]) -> int | None:
        """The entry whose words are most like these, in any order, if it is one; None below ``LEAST_SIMILAR``."""
        joined = "".join(words)
        most = int(len(joined) * (1 - LEAST_SIMILAR))
        digits = "".join(c for c in joined if c.isdigit())
        # an edit spoils three bigrams at most, another order of the words those at their ends: of the rarest ones one is left
        grams = sorted(_grams(joined), key=lambda g: (len(self.holding.get(g, ())), g))
        near = {k for g in grams[: 3 * most + len(words) + 2] for k in self.holding.get(g, ())}
        orders = {"".join(p) for p in permutations(words)} if len(words) < 4 else {joined, "".join(sorted(words))}
        best, hits = most + 1, set()
        for k in near:
            name, n, own = self.names[k]
            if abs(len(name) - len(joined)) > most or sorted(own) != sorted(digits):
                continue
            d = min(edit_distance(o, name, min(best, most)) for o in orders)
            if d < best:
                best, hits = d, {n}
            elif d == best and d <= most:
                hits.add(n)
        return hits.pop() if len(hits) == 1 else None

    def of_value(self, value: str, similar: bool = True) -> tuple[str, int | None, int | None]:
        """(key, entry, entry that is only similar) of one value; without ``similar``, mentions decide, whatever stands beside them."""
        words = plain(value).split()
        key = "".join(words)
        if not any(c.isalpha() for c in key):
            return key, 0, None
        # the whole value in one piece
        if self.auto is not None and (whole := next((n for end, (n, size) in self.auto.iter(f"|{key}|") if size == len(key) + 2), None)) is not None:
            return key, whole, None
        if all(w in NO_NAMES or w.isdigit() for w in words):
            return key, 0, None
        found, rest = self.around(words)
        if len(found) == 1:
            if all(w in self.noise for w in rest) or (not similar and not any(w in self.line_words for w in rest)):
                return key, next(iter(found)), None
            if all(w in self.line_words or w in self.noise for w in rest):
                return key, 0, None
        if not similar:
            return key, None, None
        core = [w for w in words if w not in self.noise] or words
        # each in one piece: "Ba-browen GmbH", "Babrowen / Babrowen"
        half = len(core) // 2
        if len(core) % 2 == 0 and core[:half] == core[half:]:
            core = core[:half]
        if len(core) < len(words) and len(core) == 1 and core[0] in self.first:
            return key, self.first[core[0]], None
        hit = self.similar(core)
        return key, None, hit


#: The list's automaton in this Python worker, by the id of its broadcast.
_BUILT: dict[str, Names] = {}


def built(rows: list, noise: frozenset[str], uid: str) -> Names:
    """``Names`` made once in a worker."""
    if uid not in _BUILT:
        _BUILT.clear()
        _BUILT[uid] = Names(rows, noise)
    return _BUILT[uid]


def listed(names: DataFrame) -> list[tuple[int, str, list[str]]]:
    """The reference list (id, name, aliases), refused beyond ``MOST_NAMES`` entries."""
    if (n := names.count()) > MOST_NAMES:
        raise ValueError(f"{n} canonical entries; the automaton is built for {MOST_NAMES} at most")
    return [(int(r[0]), r[1], list(r[2]) if r[2] is not None else []) for r in names.collect() if r[0] is not None]


def noise_words(values: DataFrame, value: str, rows: list, sent, uid: str) -> frozenset[str]:
    """Words that stand beside the names of many entries, in all distinct values; line words are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = built(sent.value, frozenset(), uid + " bare")
        for pdf in batches:
            out = set()
            for v in pdf[value]:
                found, rest = known.around(plain(v).split())
                if len(found) == 1 and len(rest) < 6:
                    out.update((w, n) for n in found for w in rest if w not in known.line_words)
            yield pd.DataFrame(sorted(out), columns=["word", "entry"]).astype({"word": "string", "entry": "int32"})

    beside = values.select(value).distinct().mapInPandas(run, "word string, entry int").distinct().groupBy("word").agg(F.count("*").alias("n"))
    least = max(NOISE_ENTRIES, math.ceil(NOISE_SHARE * len(rows)))
    found = beside.where(F.col("n") >= least).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} words stand beside many entries")
    return frozenset(r["word"] for r in found)


def map_values(df: DataFrame, id_col: str, value: str, context: str, names: DataFrame) -> DataFrame:
    """(id_col, entry): ``names`` is (id, name, aliases); rows whose value is null, blank or an exact name are left out."""
    rows = listed(names)
    exact = names.select(F.col(names.columns[1]).alias(value)).distinct()
    todo = df.select(id_col, value, context).where(f"trim(regexp_replace(`{value}`, '[\\\\s\\\\u00a0]+', ' ')) <> ''").join(exact, value, "left_anti")
    sent, uid = df.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex  # MOST_NAMES at most
    noise = noise_words(todo, value, rows, sent, uid)
    schema = T.StructType([df.schema[id_col], T.StructField("key", T.StringType()), T.StructField("entry", T.IntegerType()), T.StructField("near", T.IntegerType()), T.StructField("seen", T.IntegerType()), T.StructField("akin", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, cache = built(sent.value, noise, uid), {}
        for pdf in batches:
            out = []
            for i, v, c in zip(pdf[id_col], pdf[value], pdf[context], strict=True):
                if (got := cache.get(v)) is None:
                    if len(cache) > 500_000:
                        cache.clear()
                    got = cache[v] = known.of_value(v)
                seen = None if got[1] is not None else known.in_context(c)
                out.append((i, *got, seen, seen is not None and not known.words_of[seen].isdisjoint(plain(v).split())))
            yield pd.DataFrame(out, columns=schema.names).astype({"entry": "Int32", "near": "Int32", "seen": "Int32"})

    mapped = written(todo.select(id_col, value, context).mapInPandas(run, schema), "mapped")
    open_ = mapped.where("entry is null")
    votes = open_.groupBy("key", "near", "seen").agg(F.count("*").alias("count"), F.max("akin").alias("akin")).groupBy("key", "near").agg(F.sum("count").alias("all"), F.expr("max_by(struct(seen, count, akin), struct(if(seen is null, 0, count), -seen))").alias("top"))
    # a similar name stands unless the contexts mention another entry; else the contexts decide, one alone only for a name that shares a word
    learned = votes.select("key", F.expr(f"case when near is not null and (top.seen is null or top.seen = near) then near when top.seen is not null and (top.akin or top.count > 1) and top.count >= {ALIAS_SHARE} * all then top.seen when near is not null and top.count < {ALIAS_SHARE} * all then near else 0 end").alias("learned"))
    late = open_.join(learned, "key").select(id_col, F.col("learned").alias("entry"))
    return mapped.where("entry is not null").select(id_col, "entry").unionByName(late)
