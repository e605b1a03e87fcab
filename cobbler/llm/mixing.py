"""Mixing sources to target shares of tokens by balanced (cube) sampling.

The mix is as large as the caps on repeats allow: the total T is the least, over sources, of
max_repeats x tokens / share.  A source then needs share x T tokens, which is a whole number of
repeats of all its texts plus a fraction; the fraction is every text's inclusion probability for one
more copy.  Which texts get it is drawn by the cube method: inclusion probabilities walk through the
null space of the balancing constraints (documents and tokens), so both totals stay exact while one
text after the other reaches 0 or 1, until no step is left; a landing problem of a few texts per
source is settled by enumeration and a few exchanges of two texts.

Scale.  The walk is run in blocks of about ``BLOCK`` texts of one source (by hash of the id), side by
side; each leaves at most two texts undecided, which are walked on together in the next round.  A
source with a third of all texts is so many blocks.  Rounds shrink a thousandfold and are checkpointed.
The target table is the small fixed side: it is collected, with a bound of ``MOST_SOURCES``.

Defined results.  Texts that are null or without tokens, of no source, or of a source that has no
target are not in the mix.  Target sources without texts reach a share of 0 and their share goes to
the others in proportion; shares are scaled to add up to 1.  Null shares and caps count as 0, and a
source with share 0 or cap 0 contributes nothing.  Rows repeated under one id count once.
"""

from __future__ import annotations

import bisect
import itertools
import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobbler.llm.tokenizing import count_tokens
from cobbler.plans.durable import cut, written

#: Texts that are walked in one block; sources with a target at most.
BLOCK, MOST_SOURCES = 2_000, 10_000
#: Pairs of texts exchanged at most when a source is landed.
EXCHANGES = 4
_EPS = 1e-9


def _null_vector(x: float, y: float, z: float) -> tuple[float, float, float]:
    """A direction that changes neither the number nor the tokens of three texts."""
    u = (z - y, x - z, y - x)
    return u if any(u) else (1.0, -1.0, 0.0)


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Walks the chances to 0 or 1, keeping their sum and their size-weighted sum; at most two stay between."""
    p = list(chances)
    open_: list[int] = []
    for k in range(len(p)):
        if p[k] <= _EPS or p[k] >= 1 - _EPS:
            p[k] = round(p[k])
            continue
        open_.append(k)
        while len(open_) == 3:
            u = _null_vector(*(sizes[i] for i in open_))
            up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(open_, u, strict=True) if d)
            down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(open_, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(open_, u, strict=True):
                p[i] += step * d
                if p[i] <= _EPS or p[i] >= 1 - _EPS:
                    p[i] = round(p[i])
            open_ = [i for i in open_ if 0 < p[i] < 1]
    return p


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """Settles the few chances still open so that the sizes' total moves least."""
    open_ = [i for i, x in enumerate(chances) if 0 < x < 1]
    aim = sum(sizes[i] * chances[i] for i in open_)
    best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda c: (abs(sum(sizes[i] * x for i, x in zip(open_, c, strict=True)) - aim), c))
    out = list(chances)
    for i, x in zip(open_, best, strict=True):
        out[i] = x
    off = sum(sizes[i] * out[i] for i in open_) - aim
    # what one text's size still leaves is taken back by exchanging two texts, the number staying the same
    for _ in range(EXCHANGES):
        taken = sorted((sizes[i], i) for i, x in enumerate(out) if x == 1)
        spare = sorted((sizes[i], i) for i, x in enumerate(out) if x == 0)
        if not spare or not taken or not off:
            break
        gains = []
        for size, i in taken:
            k = bisect.bisect_left(spare, (size - off, -1))
            gains += [(abs(off - size + s), i, j) for s, j in spare[max(0, k - 1) : k + 1]]
        left, i, j = min(gains)
        if left >= abs(off):
            break
        off += sizes[j] - sizes[i]
        out[i], out[j] = 0, 1
    return out


def _walk(seed: int, turn: int):
    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lone, block = bool(pdf["lone"].iloc[0]), int(pdf["block"].iloc[0])
        pdf = pdf[["id", "source", "size", "chance"]]
        if block == 0 and not lone:
            return pdf  # kept whole for the last round, so that landing has texts to exchange
        rng = random.Random(zlib.crc32(f"{seed} {turn} {key[0]} {key[1]}".encode()))
        # largest texts first, so that the few left to the landing are small; chance decides among equals
        pdf = pdf.sort_values("id").sample(frac=1, random_state=rng.randrange(1 << 31)).sort_values("size", ascending=False, kind="stable")
        sizes = [float(x) for x in pdf["size"]]
        p = flight(sizes, pdf["chance"].tolist(), rng)
        return pdf[["id", "source", "size"]].assign(chance=[float(x) for x in (landing(sizes, p) if lone else p)])

    return walk


def balanced_sample(df: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``df``: id, source, size, chance in (0, 1); gives (id, source, size, taken 0 or 1), balanced in each source."""
    schema = "id long, source string, size long, chance double"
    done: list[DataFrame] = []
    left = df.select("id", "source", "size", "chance")
    for turn in itertools.count():
        counts = {r["source"]: r["count"] for r in left.groupBy("source").count().collect()}  # one row per source of the bounded target table
        if not counts:
            break
        blocks = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, max(1, -(-n // block)))])[F.col("source")]
        keyed = left.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(seed + turn)), blocks).cast("int"), "lone": blocks == 1})
        walked = cut(keyed.groupBy("source", "block").applyInPandas(_walk(seed, turn), schema))
        done.append(walked.where("chance = 0 or chance = 1"))
        if all(n <= block for n in counts.values()):
            break
        left = walked.where("chance > 0 and chance < 1")
    if not done:
        return df.select("id", "source", "size", F.lit(0).alias("taken")).limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "source", "size", F.col("chance").cast("int").alias("taken"))


def _plan(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, int, float]]:
    """source -> (share, whole repeats, chance of one more copy)."""
    usable = {s: (share, cap) for s, share, cap in targets if totals.get(s, 0) > 0 and share > 0 and cap > 0}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    total = min(cap * totals[s] / (share / whole) for s, (share, cap) in usable.items())
    out = {}
    for s, (share, cap) in usable.items():
        times = min(share / whole * total / totals[s], float(cap))
        base = int(times + 1e-12)
        out[s] = (share / whole, base, max(0.0, times - base))
    return out


def mix(docs: DataFrame, targets: DataFrame, id_col: str, text: str, source: str, seed: int = 0) -> DataFrame:
    """(id, source, n_tokens, copies) of every text of a target source; copies may be 0."""
    if (n := targets.count()) > MOST_SOURCES:
        raise ValueError(f"{n} target sources; {MOST_SOURCES} at most")
    rows = [(r[0], float(r[1] or 0.0), int(r[2] or 0)) for r in targets.collect() if r[0] is not None]
    listed = docs.where(F.col(source).isin([s for s, *_ in rows]) & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    sized = written(count_tokens(listed, text, [id_col, source]).where("n_tokens > 0").select(F.col(id_col).alias("id"), F.col(source).alias("source"), "n_tokens").groupBy("id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("id", "s.*"), "sized")
    totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plan = _plan(totals, rows)
    if not plan:
        return sized.select("id", "source", "n_tokens", F.lit(0).alias("copies"))
    at = lambda k: F.create_map(*[F.lit(x) for s, v in plan.items() for x in (s, v[k])])[F.col("source")]
    planned = sized.select("id", "source", F.col("n_tokens").alias("size"), F.coalesce(at(2), F.lit(0.0)).alias("chance"), F.coalesce(at(1), F.lit(0)).alias("base"))
    drawn = balanced_sample(planned.where("chance > 0"), seed).select("id", "taken")
    return planned.join(drawn, "id", "left").select("id", "source", F.col("size").alias("n_tokens"), (F.col("base") + F.coalesce("taken", F.lit(0))).cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, tokens, texts used and the most repeats."""
    by = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    whole = float(by.agg(F.sum("tokens")).first()[0] or 0)
    out = targets.join(by, "source", "left")
    return out.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(whole)), F.lit(0.0)).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "copies", "most_copies")], "max_repeats")
