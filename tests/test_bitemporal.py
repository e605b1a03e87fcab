import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cobbler.operators.bitemporal import Ledger

SCHEMA = "shop int, ext string, price int, was int, stock boolean, seen timestamp, got timestamp, kind string, valid_from string"
ARGS = {"keys": ["shop", "ext"], "valid": "seen", "recorded": "got", "attrs": ["price", "was", "stock"], "required": ["price", "stock"]}
T0 = datetime(2025, 1, 1, tzinfo=UTC)


def readings(seed, n=260):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = (1, "hot") if rng.random() < 0.6 else (rng.choice([1, 2, None]), rng.choice(["a", "b", None]))
        v = T0 + timedelta(minutes=rng.randrange(80))
        r = v + timedelta(minutes=rng.choice([0, 1, 1, 2, 40, 90]))
        out.append((*key, rng.choice([10, 10, 20, None]), rng.choice([None, 30]), rng.choice([True, True, False, None]), v, None if rng.random() < 0.02 else r, "x", "clash"))
    return out + out[:20]


def us(t):
    return int((t - T0).total_seconds() * 1e6)


def known(rows, key, at):
    """valid time -> state, as believed at a recorded time."""
    best = {}
    for s, e, p, w, k, v, r, *_ in rows:
        if (s, e) != key or p is None or k is None:
            continue
        r = max(v, r or v)
        state = (p, -1 if w is None else w, k)
        if us(r) <= at:
            best[us(v)] = max(best.get(us(v), (-1, state)), (us(r), state))
    return {v: s for v, (_, s) in best.items()}


@pytest.mark.parametrize(("seed", "stretches"), [(1, 1), (2, 5), (3, 23), (4, None)])
def test_against_brute_force(spark, seed, stretches):
    rows = readings(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    ledger = Ledger(df, **ARGS, stretches=stretches)
    off = lambda c: (F.unix_micros(c) - us(T0) - int(T0.timestamp() * 1e6)).alias(c)
    got = [tuple(r) for r in ledger.rows().select("shop", "ext", "price", F.coalesce("was", F.lit(-1)), "stock", *map(off, ("valid_from", "valid_to", "recorded_from", "recorded_to"))).collect()]
    keys = {(s, e) for s, e, *_ in rows if s is not None and e is not None}
    times = sorted({us(max(r[5], r[6] or r[5])) for r in rows})
    for key in keys:
        mine = [g for g in got if g[:2] == key]
        for at in times:
            belief = known(rows, key, at)
            vs = sorted(belief)
            want = [(v, vs[i + 1] if i + 1 < len(vs) else None, belief[v]) for i, v in enumerate(vs)]
            have = sorted(((g[5], g[6], g[2:5]) for g in mine if g[7] <= at and (g[8] is None or g[8] > at)), key=lambda x: x[0])
            assert have == want, (key, at)
    versions = {tuple(r) for r in ledger.versions().select("shop", "ext", (F.col("valid_from_us") - int(T0.timestamp() * 1e6)).alias("v")).collect()}
    want = set()
    for key in keys:
        belief, before = known(rows, key, 1 << 60), None
        for v in sorted(belief):
            if belief[v] != before:
                want.add((*key, v))
            before = belief[v]
    assert versions == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Ledger(df, **ARGS).rows().count() == 0
    assert Ledger(df, **ARGS).versions().count() == 0
