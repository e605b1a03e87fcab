"""The language of every text and of its stretches: script ranges, per-word scores and Viterbi.

A word's script narrows its candidates: a Cyrillic word can only be in a language written so, and
there counts a Latin word as a name.  Each word has a score per candidate; a Viterbi pass over the
words of the whole text, with a penalty for every switch, labels stretches.  Stretches are reported
with character offsets and a confidence; a text's language is the one with most characters in
whole sentences.

The scores are trained here: on at most ``FIT_DOCS`` labelled documents of at most ``FIT_CHARS``
characters, drawn by the hashes of their ids (documented bounds), from counts of words and character
n-grams per language.  Labels may be wrong and texts mixed, so counting is repeated after
relabelling sentences with the model at hand.  Evidence of neighbouring words is not independent: what a
stretch's summed evidence is divided by before it becomes a confidence is fitted too, on how often the
first words of a sentence agree with the whole of it.  The model has a fixed size (``BUCKETS`` x
languages); applying it is a map over all documents, without a shuffle, over whole texts.  Words of a
batch are scored once and summed as arrays; a text in which no other language gains more over any stretch
than a switch costs has one language by Viterbi, so only the others are searched.

Defined results.  Null and empty texts, and texts without a word, have no stretches and no language.
Ties go to the language listed first.  Confidence lies between 0 and 1.  A stretch without evidence for
one language (names only, or a script that none of the languages is written in) has the language
``UNKNOWN``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The languages and how labels write them.
LANGUAGES = ("bs", "sr", "sl", "en", "de", "it", "fr")
SCRIPTS = {"sr": "Cyrillic"}
NAMES = {
    "bs": "bs bos bosnian bosanski bosanskom bosnisch",
    "sr": "sr srp scc serbian srpski srpski српски serbisch",
    "sl": "sl slv slovenian slovene slovenski slovenscina slovenščina slowenisch",
    "en": "en eng english engleski angleski engl",
    "de": "de deu ger german deutsch njemacki njemački nemacki nemški",
    "it": "it ita italian italiano italijanski italienisch",
    "fr": "fr fra fre french francais français francuski französisch",
}
NAMED = {n: lang for lang, names in NAMES.items() for n in names.split()}

#: Documents the scores are fitted on at most; hash buckets of n-grams; rounds of relabelling.
FIT_DOCS, BUCKETS, ROUNDS = 3_000, 1 << 17, 2
#: Characters of a document that is fitted on at most.
FIT_CHARS = 100_000
#: The language of a stretch whose confidence is below this.
UNKNOWN, LEAST_SURE = "und", 0.5
#: Words whose evidence is held as one array.
BLOCK_WORDS = 200_000
#: What a switch of language costs, in nats; the bounds of one word's evidence.
SWITCH, MOST_EVIDENCE = 7.0, 6.0
#: Words that make a whole sentence.
SENTENCE_WORDS = 6
#: Share of letters from which words are prose and not codes.
PROSE = 0.6

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*")
_END = regex.compile(r"[.!?…]+(?=\s|$|[\"'”)])|[\n\r\u2028\u2029]+|\s[/|•]\s")
_WRITTEN = regex.compile(r"[\p{Latin}\p{Cyrillic}]")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_LATIN_ONLY = [i for i, x in enumerate(LANGUAGES) if x not in SCRIPTS]
_SR = LANGUAGES.index("sr")


def named_language(label: str | None) -> str | None:
    """The language that a label names, whatever its writing, or None."""
    if not label:
        return None
    text = label.strip().lower()
    return NAMED.get(text) or NAMED.get(regex.split(r"[-_ ]", text)[0])


@lru_cache(maxsize=100_000)
def _grams(word: str) -> tuple[int, ...]:
    """Hash buckets of a word's character n-grams (two to four, with its borders)."""
    codes = [94, *map(ord, word), 36]
    out = []
    n = len(codes)
    for i in range(n - 1):
        h = ((2166136261 ^ codes[i]) * 16777619) & 0xFFFFFFFF
        for c in codes[i + 1 : i + 4]:  # each gram goes on from the one before
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
            out.append((h ^ (h >> 15)) & (BUCKETS - 1))
    return tuple(out)


class Scores:
    """Evidence for each language in a word."""

    def __init__(self, words: dict[str, tuple[float, ...]], grams: np.ndarray, spread: float = 1.0):
        self.words, self.grams, self.spread = words, grams, spread
        self.cache: dict[str, tuple[float, ...]] = {}

    def sure(self, totals: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The confidence in each row's language ``own``, given the evidence of its words."""
        off = np.clip((totals - totals[np.arange(len(own)), own][:, None]) / self.spread, -50.0, 50.0)
        return 1.0 / np.exp(off).sum(axis=1)

    def of(self, word: str) -> tuple[float, ...]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[word] = self._of(word)
        return got

    def _of(self, word: str) -> tuple[float, ...]:
        w = word.lower().replace("’", "'")
        n = len(LANGUAGES)
        if not _WRITTEN.search(w):
            return (0.0,) * n
        if _CYRILLIC.search(w):
            return tuple(0.0 if i == _SR else -MOST_EVIDENCE for i in range(n))
        if (known := self.words.get(w)) is not None:
            return known
        # a word not met in fitting is often a name: its letters count little
        x = self.grams[list(_grams(w))].mean(axis=0)
        x = 0.5 * (x - x[_LATIN_ONLY].max())
        x[_SR] = -0.7
        return tuple(float(max(v, -MOST_EVIDENCE / 3)) for v in x)


def _sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def labelled(text: str, scores: Scores) -> tuple[list[tuple[int, int]], list[int], list[tuple[float, ...]]]:
    """Word positions, their languages by Viterbi, and their scores."""
    spots = [m.span() for m in _WORD.finditer(text)]
    if not spots:
        return [], [], []
    of = scores.of
    evidence = [of(text[a:b]) for a, b in spots]
    n = len(LANGUAGES)
    state = list(evidence[0])
    back: list[tuple[int, int]] = []  # per word: best before, and bits of languages that were switched to
    for e in evidence[1:]:
        best = max(state)
        low = best - SWITCH
        bits = 0
        nxt = []
        for k in range(n):
            s = state[k]
            if s < low:
                bits |= 1 << k
                s = low
            nxt.append(s + e[k])
        back.append((state.index(best), bits))
        state = nxt
    k = state.index(max(state))
    path = [k]
    for b, bits in reversed(back):
        if bits >> k & 1:
            k = b
        path.append(k)
    path.reverse()
    return spots, path, evidence


def _confidence(total: list[float], own: int, scores: Scores) -> float:
    return 1.0 / sum(math.exp(min(max((t - total[own]) / scores.spread, -50.0), 50.0)) for t in total)


def stretches(text: str, scores: Scores) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches of one language."""
    spots, path, evidence = labelled(text, scores)
    out = []
    i = 0
    while i < len(path):
        j = i
        total = [0.0] * len(LANGUAGES)
        while j < len(path) and path[j] == path[i]:
            for k, v in enumerate(evidence[j]):
                total[k] += v
            j += 1
        conf = _confidence(total, path[i], scores)
        out.append((spots[i][0], spots[j - 1][1], LANGUAGES[path[i]] if conf >= LEAST_SURE else UNKNOWN, conf))
        i = j
    return out


def sentence_languages(text: str, scores: Scores) -> dict[str, tuple[int, float]]:
    """Per language: characters in whole sentences, and the best sentence's confidence."""
    spots, path, evidence = labelled(text, scores)
    out: dict[str, tuple[int, float]] = {}
    at = 0
    for a, b in _sentences(text):
        first = at
        while at < len(spots) and spots[at][0] < b:
            at += 1
        if at - first < SENTENCE_WORDS:
            continue
        # one sentence may still hold two languages: each counts with its own whole stretch
        i = first
        while i < at:
            j = i
            total = [0.0] * len(LANGUAGES)
            while j < at and path[j] == path[i]:
                for k, v in enumerate(evidence[j]):
                    total[k] += v
                j += 1
            end = b if j == at else spots[j][0]
            letters = sum(y - x for x, y in spots[i:j])
            if j - i >= SENTENCE_WORDS and letters >= PROSE * len("".join(text[spots[i][0] : end].split())):
                conf = _confidence(total, path[i], scores)
                chars, best = out.get(LANGUAGES[path[i]], (0, 0.0))
                out[LANGUAGES[path[i]]] = (chars + end - spots[i][0], max(best, conf))
            i = j
    return out


def _counted(sentences: list[tuple[int, set[str], int | None]]) -> Scores:
    """Scores from (document, words, language) of sentences; a word counts once per document and language."""
    n = len(LANGUAGES)
    seen = {(doc, lang, w) for doc, ws, lang in sentences if lang is not None for w in ws}
    words: dict[str, np.ndarray] = {}
    for _, lang, w in seen:
        words.setdefault(w, np.zeros(n))[lang] += 1
    grams = np.full((BUCKETS, n), 0.05)
    sums = np.ones(n)
    for w, row in words.items():
        sums += row
        np.add.at(grams, list(_grams(w)), np.minimum(row, 50))
    logs = np.log(grams / grams.sum(axis=0))
    known: dict[str, tuple[float, ...]] = {}
    even = sums[_LATIN_ONLY].mean() / sums
    for w, row in words.items():
        if row.sum() < 3:
            continue
        p = np.log(row * even + 0.5)
        p = np.maximum(p - p[_LATIN_ONLY].max(), -MOST_EVIDENCE)
        # where a Cyrillic language is written, a Latin word is a name: the surer its own language, the less so
        first, second = sorted((float(p[k]) for k in _LATIN_ONLY), reverse=True)[:2]
        p[_SR] = -0.7 - min(first - second, 2.8)
        known[w] = tuple(map(float, p))
    logs -= logs[:, _LATIN_ONLY].max(axis=1, keepdims=True)
    logs[:, _SR] = -0.7
    return Scores(known, logs.astype(np.float32))


def fit_scores(docs: DataFrame, id_col: str, text: str, label: str, fit_docs: int = FIT_DOCS) -> Scores:
    """Scores from at most ``fit_docs`` documents whose label names a language."""
    named = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([\p{L}]+)", 1)).isin(list(NAMED))
    # the count reads labels only; by their hashes about as many rows as are wanted reach the driver
    n = docs.where(named).count()
    step = 1_000_000_000
    drawn = F.pmod(F.xxhash64(id_col), F.lit(step))
    usable = docs.where(named & (drawn < (step if n <= fit_docs else step * fit_docs // n)) & F.length(text).between(1, FIT_CHARS))
    rows = sorted(usable.select(text, label, drawn.alias("_h")).collect(), key=lambda r: (r[2], r[0]))[:fit_docs]
    sentences: list[tuple[int, set[str], int | None]] = []
    for doc, (t, lab, *_) in enumerate(rows):
        lang = named_language(lab)
        if lang is None:
            continue
        k = LANGUAGES.index(lang)
        for a, b in _sentences(t):
            s = t[a:b]
            ws = [w.lower().replace("’", "'") for w in _WORD.findall(s)]
            latin = [w for w in ws if not _CYRILLIC.search(w)]
            if len(latin) < 3 or len(latin) < len(ws):
                continue  # what the script decides needs no counts
            sentences.append((doc, set(latin), k if k != _SR else None))
    scores = _counted(sentences)
    for _ in range(ROUNDS):
        again = []
        for doc, ws, _ in sentences:
            total = [sum(x) for x in zip(*map(scores.of, ws), strict=True)]
            (second, _), (first, best) = sorted((total[k], k) for k in _LATIN_ONLY)[-2:]
            again.append((doc, ws, best if first - second > 3.0 else None))
        sentences = again
        scores = _counted(sentences)
    scores.spread = _spread(scores, [t for t, *_ in rows])
    return scores


def _spread(scores: Scores, texts: list[str]) -> float:
    """By what to divide evidence so that the first three words of a sentence are as often right as they are sure; the whole sentence tells what is right."""
    some, right = [], []
    for t in texts:
        for a, b in _sentences(t):
            ws = _WORD.findall(t[a:b])
            if len(ws) >= 8:
                each = np.array([scores.of(w) for w in ws])
                some.append(each[:3].sum(axis=0))
                right.append(int(each.sum(axis=0).argmax()))
    if not some:
        return 1.0
    some_, right_ = np.array(some), np.array(right)
    return float(min((0.5 + k / 4 for k in range(40)), key=lambda x: -np.log(np.maximum(Scores({}, scores.grams, x).sure(some_, right_), 1e-12)).mean()))


class _Block:
    """Evidence of the words of some texts, as arrays."""

    def __init__(self, scores: Scores):
        self.scores = scores
        self.index: dict[str, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.table = np.zeros((0, len(LANGUAGES)))

    def numbers(self, words: list[str]) -> list[int]:
        out = list(map(self.index.get, words))
        if None in out:
            for k, w in enumerate(words):
                if out[k] is None:
                    out[k] = self.index.setdefault(w, len(self.rows))
                    if out[k] == len(self.rows):
                        self.rows.append(self.scores.of(w))
        return out

    def evidence(self, numbers: list[int]) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], dtype=float)])
        out = self.table[numbers]
        if len(self.rows) > 500_000:
            self.index, self.rows, self.table = {}, [], np.zeros((0, len(LANGUAGES)))
        return out


def _one_language(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text (its words' evidence from ``starts`` on) the language of all its words by Viterbi, or -1 if it must be searched.

    Against the language of the largest sum, no other language gains more than a switch on any stretch of
    words: then no path with switches is better.
    """
    best = np.add.reduceat(e, starts).argmax(axis=1)
    sizes = np.diff(np.append(starts, len(e)))
    gain = e - e[np.arange(len(e)), np.repeat(best, sizes)][:, None]
    # a row of zeros before each text, from which its sums are counted
    padded = np.insert(gain, starts, 0.0, axis=0)
    at = starts + np.arange(len(starts))
    sums = np.cumsum(padded, axis=0)
    sums -= np.repeat(sums[at], sizes + 1, axis=0)
    # each text lies far below the one before, so the running minimum starts anew
    deep = np.repeat(np.arange(len(starts)), sizes + 1)[:, None] * (2 * np.abs(sums).max() + 1.0)
    most = np.maximum.reduceat(sums - deep - np.minimum.accumulate(sums - deep, axis=0), at).max(axis=1)
    return np.where(most < SWITCH - 1e-6, best, -1)


def languages_of(texts: list[str], block: _Block) -> Iterator[dict[str, tuple[int, float]]]:
    """``sentence_languages`` of each text, most of them without a search."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        starts, sentences, begins, which = [], [], [], []
        first = at
        while at < len(texts) and len(words) < BLOCK_WORDS:
            t = texts[at]
            starts.append(len(words))
            for a, b in _sentences(t):
                s = t[a:b]
                ws = _WORD.findall(s)
                if len(ws) >= SENTENCE_WORDS:
                    begins.append(len(words))
                    begin = s.find(ws[0])
                    chars, letters = b - a - begin, sum(map(len, ws))
                    # blanks don't count, but most sentences are prose with them
                    sentences.append((len(words) + len(ws), chars, letters >= PROSE * chars or letters >= PROSE * len("".join(s[begin:].split()))))
                    which.append(at - first)
                words += ws
            at += 1
        found: list[dict[str, tuple[int, float]]] = [{} for _ in range(at - first)]
        if words:
            e = block.evidence(block.numbers(words))
            some = np.flatnonzero(np.diff(np.append(starts, len(e))))  # texts with words
            alone = np.full(at - first, -2)
            alone[some] = _one_language(e, np.asarray(starts)[some])
            if sentences:
                ends = [x for x, *_ in sentences]
                own = alone[which]
                totals = np.add.reduceat(np.concatenate([e, np.zeros((1, e.shape[1]))]), np.ravel(np.column_stack([begins, ends])))[::2]
                sure = block.scores.sure(totals, np.maximum(own, 0)).tolist()
                for (_, chars, prose), d, k, conf in zip(sentences, which, own.tolist(), sure, strict=True):
                    if prose and k >= 0:
                        before, best = found[d].get(LANGUAGES[k], (0, 0.0))
                        found[d][LANGUAGES[k]] = (before + chars, max(best, conf))
            for d in np.flatnonzero(alone == -1).tolist():
                found[d] = sentence_languages(texts[first + d], block.scores)
        yield from found


def language_stretches(docs: DataFrame, id_col: str, text: str, scores: Scores) -> DataFrame:
    """(id, part, start, end, lang, confidence) of every stretch of every text."""
    schema = T.StructType([docs.schema[id_col], T.StructField("part", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])

    sent = docs.sparkSession.sparkContext.broadcast(scores)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for pdf in batches:
            out = [(i, n, *s) for i, t in zip(pdf[id_col], pdf[text], strict=True) if t for n, s in enumerate(stretches(t, known))]
            yield pd.DataFrame(out, columns=schema.names)

    return docs.select(id_col, text).mapInPandas(run, schema)


def language_cases(docs: DataFrame, id_col: str, text: str, label: str, scores: Scores) -> DataFrame:
    """(id, kind, lang, confidence): missing or wrong labels, and the languages of mixed texts."""
    schema = T.StructType([docs.schema[id_col], T.StructField("kind", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])

    sent = docs.sparkSession.sparkContext.broadcast(scores)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block(sent.value)
        for pdf in batches:
            out = []
            pdf = pdf[pdf[text].notna()]
            for i, lab, found in zip(pdf[id_col], pdf[label], languages_of(pdf[text].tolist(), block), strict=True):
                if not found:
                    continue
                main = max(LANGUAGES, key=lambda x: found.get(x, (0, 0.0))[0])
                if named_language(lab) != main:
                    out.append((i, "label", main, found[main][1]))
                if len(found) > 1:
                    out += [(i, "part", x, c) for x, (_, c) in found.items()]
            yield pd.DataFrame(out, columns=schema.names)

    return docs.select(id_col, text, label).mapInPandas(run, schema)
