"""Encoding a corpus with a public byte-level BPE vocabulary by walking a prefix trie of its words.

A word's encoding is determined by the last token of each of its prefixes: the last token of a
prefix is the one token that ends there and may follow the last token of what is before it.
Distinct words of a batch are taken in sorted order, which is a depth-first walk of their trie;
the states of a shared prefix are kept on the walk's stack and computed once.

The work is a map over Arrow batches: no shuffle, one row in, one row out, whatever the sizes of
documents or the repeats of words.  The vocabulary's tables are built once per Python worker
from the file at ``path`` (a parameter); each worker keeps a bounded cache of encoded words.

Defined results.  Null and empty texts give an empty list.  Strings that look like special tokens
are ordinary text; no special token is added.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers.
CACHE_WORDS = 1_000_000
#: Documents encoded at once.
SLICE = 1024


class Vocabulary:
    """Tables for deciding which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # a trie over token bytes: node -> {byte: node}; a token's id at its node
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, n in ranks.items():
            node = 0
            for byte in word:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = n
        # the merge that makes each token: found by merging its bytes with earlier merges only
        self.parts: list[tuple[int, int] | None] = [None] * (max(ranks.values(), default=-1) + 1)
        self.merged: dict[tuple[int, int], int] = {}
        for word, n in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) > 1 and (pair := self._halves(word, n)):
                self.parts[n] = pair
                self.merged[pair] = n
        self.may: dict[tuple[int, int], bool] = {}

    def _halves(self, word: bytes, below: int) -> tuple[int, int] | None:
        have = [word[i : i + 1] for i in range(len(word))]
        while len(have) > 2:
            best, at = below, -1
            for i in range(len(have) - 1):
                n = self.ranks.get(have[i] + have[i + 1], below)
                if n < best:
                    best, at = n, i
            if at < 0:
                return None
            have[at : at + 2] = [have[at] + have[at + 1]]
        return self.ranks[have[0]], self.ranks[have[1]]

    def follows(self, left: int, right: int) -> bool:
        """Would the merges leave the border between these two tokens alone?

        The two are taken apart in the reverse order of the merges, always the later merge first; a
        merge across the border with an earlier rank than what still stands beside it would have won.
        """
        key = (left, right)
        known = self.may.get(key)
        if known is not None:
            return known
        a, b, bound, answer = left, right, 1 << 62, True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                answer = False
                break
            pa_, pb = self.parts[a], self.parts[b]
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                bound, a = a, pa_[1]
            else:
                # an equal rank to the left merges first
                bound, b = b + 1, pb[0]
        if len(self.may) > 4_000_000:
            self.may.clear()
        self.may[key] = answer
        return answer

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The encodings of distinct words in sorted order: a depth-first walk of their trie."""
        nxt, token, follows = self.next, self.token, self.follows
        out: list[list[int]] = []
        before = b""
        last: list[int] = [-1]  # by prefix length: its last token
        start: list[int] = [0]  # ... and where that starts
        open_: list[list[tuple[int, int]]] = [[]]  # ... and (start, node) of token beginnings that reach it
        for word in words:
            n = min(len(word), len(before))
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :], open_[same + 1 :]
            for i in range(same, len(word)):
                byte = word[i]
                reach = []
                chosen, at = -1, i
                for s, node in (*open_[i], (i, 0)):
                    to = nxt[node].get(byte)
                    if to is not None:
                        reach.append((s, to))
                        t = token[to]
                        if chosen < 0 and t >= 0 and (s == 0 or follows(last[s], t)):
                            chosen, at = t, s
                last.append(chosen)
                start.append(at)
                open_.append(reach)
            ids = []
            i = len(word)
            while i > 0:
                ids.append(last[i])
                i = start[i]
            ids.reverse()
            out.append(ids)
            before = word
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


_WORDS = regex.compile(PATTERN)
_CACHE: dict[str, dict[str, np.ndarray]] = {}


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the texts' encodings."""
    vocab, cache = vocabulary(path), _CACHE.setdefault(path, {})
    cut = [_WORDS.findall(t) if t else [] for t in texts]
    fresh = {w for ws in cut for w in ws if w not in cache}
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = {w for ws in cut for w in ws}
    coded = sorted((w.encode("utf-8", "replace"), w) for w in fresh)
    for (_, w), ids in zip(coded, vocab.encode_sorted([b for b, _ in coded]), strict=True):
        cache[w] = ids
    flat: list[int] = []
    offsets = [0]
    for ws in cut:
        for w in ws:
            flat += cache[w]
        offsets.append(len(flat))
    return np.asarray(offsets, dtype=np.int32), np.asarray(flat, dtype=np.int32)


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of each row."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                offsets, flat = encode_texts(b.column(1).to_pylist(), path)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of each row's text."""
    path = path or vocabulary_path()
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                offsets, _ = encode_texts(b.column(b.num_columns - 1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets).astype(np.int64))], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
