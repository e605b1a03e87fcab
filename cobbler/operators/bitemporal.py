"""Bitemporal ledger of attribute histories, built from readings that may come late, twice or corrected.

``bitemporal_ledger`` turns readings (entity key, valid time, recorded time, attributes) into
rows ``[valid_from, valid_to) x [recorded_from, recorded_to)``.  A late reading splits the
interval it falls into: the overlapped row is closed in recorded time and shorter ones are
opened; no row is overwritten.  ``versions`` reads off what is believed now: of the swept rows
those that are open in recorded time, neighbours of equal attributes merged.

How it scales.  Readings are range-partitioned by (key, valid time), so a key that holds a third of
all rows is spread over as many tasks as its rows need; which task gets what is Spark's own sampled
split, and no cut points are kept or broadcast.  A task is a stretch of valid time of its first and
its last key, and holds all of the keys between.  Each stretch is swept from its latest valid time
to its earliest with a stack of the readings known so far (amortised O(1) a row).  What a stretch
can't know (a successor in a later stretch) leaves it as border rows: readings still open
towards later stretches, and the prefix minima that earlier stretches need.  Border rows are
range-partitioned again and settled by the same sweep in fewer tasks, until one task is enough.
They are few where readings come roughly in order; readings delivered wholly backwards leave one
prefix minimum each, and the last round then holds them all.

Defined results.  Readings with a null key part, a null valid time or a null attribute that is
``required`` say nothing and are left out; a null recorded time counts as the valid time, and a
recorded time before the valid time as the valid time (nothing is known before it happens).
Exact repeats count once.  Of several readings with one valid time the last recorded counts;
among equal recorded times the greatest attribute tuple (nulls first).  An empty table gives an
empty ledger.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobbler.plans.durable import written

#: Bytes of files that one stretch holds at most, by the optimizer's estimate; border rows that one task settles, as long as there is more than one.
STRETCH_BYTES, SETTLED_ROWS = 64 << 20, 200_000
#: What an emitted row is: a ledger row, a reading open towards later stretches, a prefix minimum for
#: earlier ones; the start of a version; the first and the last reading believed now of a stretch.
ROW, OPEN, MINIMUM, VERSION, FIRST, LAST = range(6)


def _readings(df: DataFrame, keys: list[str], valid: str, recorded: str, attrs: list[str], required: list[str]) -> DataFrame:
    v = F.unix_micros(F.col(valid).cast("timestamp"))
    r = F.greatest(F.coalesce(F.unix_micros(F.col(recorded).cast("timestamp")), v), v)
    kept = df.where(F.col(valid).isNotNull())
    for c in [*keys, *required]:
        kept = kept.where(F.col(c).isNotNull())
    return kept.select(F.struct(*[F.col(k) for k in keys]).alias("_k"), v.alias("_v"), r.alias("_r"), F.struct(*[F.col(a) for a in attrs]).alias("_s"))


def _changes(a: pa.StructArray) -> np.ndarray:
    """True where a row differs from the row before; nulls equal nulls.  The first row counts as differing."""
    n = len(a)
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
    for i in range(a.type.num_fields):
        codes = a.field(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if n else np.zeros(0)
        if n > 1:
            out[1:] |= codes[1:] != codes[:-1]
    return out


def _sweep(v: np.ndarray, r: np.ndarray, last: bool) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int], list[tuple[int, int]]]:
    """Ledger rows of one key's readings, in order of valid time (one reading a valid time and recorded time).

    Returns index, valid_to, recorded_from, recorded_to (-1: open or unbounded) of the rows; indices and
    recorded bounds of what stays open towards later stretches; and the prefix minima (valid, recorded)
    that earlier stretches need.  ``last`` tells that the key may go on in a later stretch.
    """
    idx: list[int] = []
    to: list[int] = []
    rf: list[int] = []
    rt: list[int] = []
    pend: list[int] = []
    pend_to: list[int] = []
    stack: list[tuple[int, int]] = []
    vs, rs = v.tolist(), r.tolist()
    end = vs[-1]
    n = len(vs)
    for i in range(n - 1, -1, -1):
        vi, ri = vs[i], rs[i]
        known = -1  # recorded time up to which the rows of i have been given, going back; -1: open
        if i + 1 < n and vs[i + 1] == vi:
            # a correction of the same valid time: the reading holds only until it is corrected
            known = rs[i + 1]
            if known <= ri:
                continue
        while stack:
            vj, rj = stack[-1]
            if known != -1 and rj >= known:
                stack.pop() if rj > ri else None
                if rj <= ri:
                    break
                continue
            start = rj if rj > ri else ri
            idx.append(i)
            to.append(vj)
            rf.append(start)
            rt.append(known)
            known = start
            if rj > ri:
                stack.pop()
            else:
                break
        if known == -1 or known > ri:
            # before `known`, no later reading of this stretch was recorded
            if last and (known == -1 or known > end):
                pend.append(i)
                pend_to.append(known)
            else:
                idx.append(i)
                to.append(-1)
                rf.append(ri)
                rt.append(known)
        stack.append((vi, ri))
    return idx, to, rf, rt, pend, pend_to, stack[::-1]


def _flat(x: pa.ChunkedArray | pa.Array) -> pa.Array:
    x = x.combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def _settled(kind: list[int], v: list[int], r: list[int], known: list[int], last: bool) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Walks one key's border rows from the latest valid time to the earliest; of one valid time open rows come last in the lists.

    Returns ledger rows (index, valid_to, recorded_from, recorded_to), what is still open (index, recorded_to)
    and the prefix minima.
    """
    rows, still = [], []
    vs: list[int] = []  # the stack, its top last: valid times fall, recorded times rise
    rs: list[int] = []
    end = v[-1]
    for i in range(len(v) - 1, -1, -1):
        if kind[i] == MINIMUM:
            while rs and rs[-1] >= r[i]:
                rs.pop()
                vs.pop()
            vs.append(v[i])
            rs.append(r[i])
            continue
        at = known[i]
        for j in range((len(rs) if at == -1 else bisect_left(rs, at)) - 1, -1, -1):
            start = max(rs[j], r[i])
            rows.append((i, vs[j], start, at))
            at = start
            if rs[j] <= r[i]:
                break
        if at == -1 or at > r[i]:
            if last and (at == -1 or at > end):
                still.append((i, at))
            else:
                rows.append((i, -1, r[i], at))
    return rows, still, list(zip(vs, rs, strict=True))[::-1]


def _flat(x: pa.ChunkedArray | pa.Array) -> pa.Array:
    x = x.combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def _batch(k: pa.Array, s: pa.Array, v: np.ndarray, parts: list[tuple]) -> pa.RecordBatch:
    """``parts``: (index, valid_to, recorded_from, recorded_to, kind), and for minima (index, valid time, recorded time)."""
    i, to, rf, rt = (np.concatenate([np.asarray(p[n], dtype=np.int64) for p in parts]) for n in range(4))
    kind = np.concatenate([np.full(len(p[0]), p[4], dtype=np.int8) for p in parts])
    at = np.where(kind == MINIMUM, to, v[i])
    none = lambda x: pa.array(x, mask=x < 0)
    to = np.where(kind == MINIMUM, -1, to)
    return pa.RecordBatch.from_arrays([k.take(pa.array(i)), s.take(pa.array(i)), pa.array(at), none(to), pa.array(rf), none(rt), pa.array(kind)], names=["_k", "_s", "valid_from", "valid_to", "recorded_from", "recorded_to", "kind"])


def _by_key(emit):
    """Feeds ``emit(block, first, last)`` blocks of whole keys; first and last tell that it holds the task's first or last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("_k")[0] != batch.column("_k")[-1]:
                block = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(_changes(_flat(block.column("_k"))))[-1])
                yield emit(block.slice(0, cut), first, False)
                first = False
                held = block.slice(cut).combine_chunks().to_batches()
        if held:
            yield emit(pa.Table.from_batches(held), first, True)

    return run


def _sweeping(versions: bool):
    """Sweeps readings: ledger rows and border rows, or the versions believed now and what stitches them."""

    def emit(block: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        k, s = _flat(block.column("_k")), _flat(block.column("_s"))
        v, r = (block.column(x).to_numpy() for x in ("_v", "_r"))
        new = _changes(k)
        keep = np.ones(len(v), dtype=bool)  # exact repeats, and equal recorded times of one valid time: the last stays
        keep[:-1] = new[1:] | (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        if not keep.all():
            rows = np.flatnonzero(keep)
            k, s, v, r = k.take(pa.array(rows)), s.take(pa.array(rows)), v[rows], r[rows]
            new = _changes(k)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(v))
        idx, to, rf, rt, open_, open_to, minima = [], [], [], [], [], [], []
        for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            i, t, f, u, p, pt, m = _sweep(v[a:b], r[a:b], last and g == len(starts) - 1)
            idx += [x + a for x in i] if a else i
            to += t
            rf += f
            rt += u
            open_ += [x + a for x in p]
            open_to += pt
            if first and g == 0:
                minima = m
        if not versions:
            border = [(open_, [-1] * len(open_), r[open_] if open_ else [], open_to, OPEN), ([0] * len(minima), [x for x, _ in minima], [y for _, y in minima], [-1] * len(minima), MINIMUM)]
            return _batch(k, s, v, [(idx, to, rf, rt, ROW), *border])
        # the swept rows that nothing has closed, one for each valid time
        rows, closed = np.asarray(idx, dtype=np.int64), np.asarray(rt, dtype=np.int64)
        now = np.sort(np.concatenate([rows[closed == -1], np.asarray([i for i, t in zip(open_, open_to, strict=True) if t == -1], dtype=np.int64)]))
        owner = np.searchsorted(starts, now, side="right")
        begin = _changes(s.take(pa.array(now)))
        begin[1:] |= owner[1:] != owner[:-1]
        parts = []
        if first:
            begin[0] = False  # depends on the stretch before
            parts.append((now[:1], [-1], r[now[:1]], [-1], FIRST))
        if last:
            parts.append((now[-1:], [-1], r[now[-1:]], [-1], LAST))
        inner = now[begin]
        return _batch(k, s, v, [(inner, np.full(len(inner), -1), r[inner], np.full(len(inner), -1), VERSION), *parts])

    return _by_key(emit)


def _settling(more: bool):
    """Settles border rows; ``more`` tells that other tasks may hold later ones of the last key."""

    def emit(block: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        k, s = _flat(block.column("_k")), _flat(block.column("_s"))
        v, r = (block.column(x).to_numpy() for x in ("valid_from", "recorded_from"))
        kind = block.column("kind").to_numpy()
        known = _flat(block.column("recorded_to")).fill_null(-1).to_numpy()
        starts = np.flatnonzero(_changes(k))
        parts = [([], [], [], [], ROW)]
        for g, (a, b) in enumerate(zip(starts.tolist(), np.append(starts[1:], len(v)).tolist(), strict=True)):
            rows, still, minima = _settled(*(x[a:b].tolist() for x in (kind, v, r, known)), more and last and g == len(starts) - 1)
            if rows:
                i, to, rf, rt = zip(*rows, strict=True)
                parts.append((np.asarray(i) + a, to, rf, rt, ROW))
            if still:
                i, rt = zip(*still, strict=True)
                i = np.asarray(i) + a
                parts.append((i, [-1] * len(i), r[i], rt, OPEN))
            if more and first and g == 0 and minima:
                parts.append(([a] * len(minima), [x for x, _ in minima], [y for _, y in minima], [-1] * len(minima), MINIMUM))
        return _batch(k, s, v, parts)

    return _by_key(emit)


def _raw(df: DataFrame, keys: list[str], attrs: list[str]) -> T.StructType:
    k = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keys])
    s = T.StructType([T.StructField(c, df.schema[c].dataType) for c in attrs])
    return T.StructType([T.StructField("_k", k), T.StructField("_s", s), *[T.StructField(c, T.LongType()) for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")], T.StructField("kind", T.ByteType())])


class Ledger:
    """Ledger of ``df``; the methods sweep it and give DataFrames.  ``stretches``: tasks of the sweep; if None, the session's shuffle partitions, or more where the input is large."""

    def __init__(self, df: DataFrame, keys: list[str], valid: str, recorded: str, attrs: list[str], required: list[str] | None = None, stretches: int | None = None):
        self.keys, self.attrs = keys, attrs
        self.readings = _readings(df, keys, valid, recorded, attrs, required or [])
        size = int(str(self.readings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        size = 0 if size >= 1 << 60 else size  # what is no file has no estimate
        self.stretches = stretches or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // STRETCH_BYTES)
        self.schema = _raw(df, keys, attrs)

    def _sorted(self, df: DataFrame, tasks: int, *order: str | Column) -> DataFrame:
        by = [F.col("_k").getField(k) for k in self.keys]
        return df.repartitionByRange(tasks, *by, order[0]).sortWithinPartitions(*by, *order)

    def _swept(self, versions: bool) -> DataFrame:
        # written before it is read twice: another evaluation may split the range elsewhere
        return written(self._sorted(self.readings, self.stretches, "_v", "_r", "_s").mapInArrow(_sweeping(versions), self.schema), "ledger")

    def rows(self) -> DataFrame:
        """Every ledger row: keys, attributes, valid_from, valid_to, recorded_from, recorded_to (null: unbounded)."""
        swept = self._swept(versions=False)
        done = swept.where(F.col("kind") == ROW)
        tasks = self.stretches
        while left := (border := swept.where(F.col("kind") != ROW)).count():
            tasks = max(1, min(math.ceil(left / SETTLED_ROWS), tasks // 2))
            ordered = self._sorted(border, tasks, "valid_from", F.col("kind").desc())
            swept = written(ordered.mapInArrow(_settling(tasks > 1), self.schema), "border")
            done = done.unionByName(swept.where(F.col("kind") == ROW))
        return done.select("_k.*", "_s.*", *[F.timestamp_micros(F.col(c)).alias(c) for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")])

    def versions(self) -> DataFrame:
        """What is believed now: keys, attributes and valid_from_us of each unbroken run of equal attributes."""
        swept = self._swept(versions=True)
        # at most two border rows a task: the first reading of a stretch starts a version if the stretch before ends otherwise
        w = Window.partitionBy("_k").orderBy("valid_from", "kind")
        border = swept.where(F.col("kind").isin(FIRST, LAST)).withColumns({"_p": F.lag("_s").over(w), "_n": F.row_number().over(w)})
        stitched = border.where((F.col("kind") == FIRST) & ((F.col("_n") == 1) | ~F.col("_s").eqNullSafe(F.col("_p"))))
        both = swept.where(F.col("kind") == VERSION).select("_k", "_s", "valid_from").unionByName(stitched.select("_k", "_s", "valid_from"))
        return both.select("_k.*", "_s.*", F.col("valid_from").alias("valid_from_us"))


def bitemporal_ledger(df: DataFrame, keys: list[str], valid: str, recorded: str, attrs: list[str], required: list[str] | None = None) -> DataFrame:
    """See the module's text; the ledger rows of all readings."""
    return Ledger(df, keys, valid, recorded, attrs, required).rows()
