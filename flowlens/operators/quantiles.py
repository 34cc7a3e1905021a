"""Exact quantiles without holding a column's values in one task.

The wanted order statistics (the rank-k values of a column) are bracketed by
Spark's own sketches and then counted, the same way at every size:

1. one pass: count, min and max of each column;
2. twice: each task hands on every ``STEP``-th value of an open interval, in
   order, and ``percentile_approx`` of these on a grid gives the values next to
   each wanted rank (a few KB of sketch per map task); one pass
   then counts the rows between and at these values (partial aggregation, a
   handful of groups per rank). The exact counts tell which value a rank has,
   or between which two it lies, however good the sketch was;
3. what is still open lies in intervals of about 1/grid² of the rows: their
   values are collapsed to (value, copies) and the running count per interval
   gives the rank.

Values that are held by many rows are grid values themselves and are found by
the counting alone. Only per-rank state reaches the driver. The passes
place the values with numpy, a binary search for each column and Arrow batch.
Linear interpolation between the two neighbouring order statistics gives the
percentile: ``lo + (hi − lo) · d`` with position ``(n − 1) · p``.

Nulls and NaN are left out; an infinite value is an error that names the
column; a column without values has no quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import ship_package

#: Grid of the sketches: an interval shrinks to about 1/GRID of its rows a round.
GRID = 256
ROUNDS = 2
#: Of the values that a task holds, up to ``HELD`` at once, every ``STEP``-th goes to the sketches.
STEP = 32
HELD = 1 << 18
#: Columns of one aggregation; with many more, its generated code takes three times as long.
TOGETHER = 13


@dataclass
class _Target:
    col: int
    rank: int            # 0-based rank wanted
    count: int           # values inside the open interval (lo, hi)
    lo: float = -math.inf
    hi: float = math.inf
    base: int = 0        # values at or below ``lo``
    value: float | None = None


def _batches(df: DataFrame, cols: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` over Arrow batches of the columns as double."""
    ship_package(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, schema)


def _numbers(b: pa.RecordBatch) -> list[np.ndarray]:
    """The values of each column; null is NaN."""
    return [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in b.columns]


def _column_stats(df: DataFrame, cols: list[str]) -> dict[int, tuple[int, float, float]]:
    """{column index: (count, min, max)} of the columns that have values. NaN
    counts as the largest value of all, so only columns whose largest is NaN are
    read again without it."""
    def ends(at: list[int], without_nan: bool) -> dict[int, tuple]:
        out = {}
        for s in range(0, len(at), TOGETHER):
            x = {i: F.col(f"`{cols[i]}`").cast("double") for i in at[s:s + TOGETHER]}
            if without_nan:
                x = {i: F.when(~F.isnan(v), v) for i, v in x.items()}
            row = df.agg(*[f(v) for v in x.values() for f in (F.count, F.min, F.max)]).first()
            out |= {i: tuple(row[3 * j:3 * j + 3]) for j, i in enumerate(x)}
        return out

    found = ends(list(range(len(cols))), False)
    found |= ends([i for i, (_, _, hi) in found.items() if hi is not None and math.isnan(hi)], True)
    stats = {}
    for i, (n, lo, hi) in found.items():
        if not n:
            continue
        if math.isinf(lo) or math.isinf(hi):
            raise ValueError(f"column {cols[i]!r} holds an infinite value")
        stats[i] = (int(n), float(lo), float(hi))
    return stats


def order_statistics(df: DataFrame, cols: list[str], ranks: dict[int, list[int]],
                     stats: dict[int, tuple[int, float, float]],
                     grid: int = GRID, rounds: int = ROUNDS) -> dict[tuple[int, int], float]:
    """Values at the given 0-based ranks (per column index)."""
    targets = []
    for ci, rs in ranks.items():
        n, mn, mx = stats[ci]
        targets += [_Target(ci, r, n, value=mn if mn == mx else None) for r in sorted(set(rs))]
    for _ in range(rounds):
        _narrow(df, cols, _open(targets), grid)
    _rank(df, cols, _open(targets))
    return {(t.col, t.rank): t.value for t in targets}


def _open(targets: list[_Target]) -> list[list[_Target]]:
    """Targets without a value, those of one interval together. The intervals
    of a column don't overlap."""
    groups: dict[tuple[int, float, float], list[_Target]] = {}
    for t in targets:
        if t.value is None:
            groups.setdefault((t.col, t.lo, t.hi), []).append(t)
    return list(groups.values())


def _intervals(groups: list[list[_Target]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each column with open intervals, their lo, hi and number, by lo."""
    by: dict[int, list[tuple[float, float, int]]] = {}
    for g, (t, *_) in enumerate(groups):
        by.setdefault(t.col, []).append((t.lo, t.hi, g))
    return {c: tuple(np.array(v) for v in zip(*sorted(spans), strict=True)) for c, spans in by.items()}


def _inside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval and value of the values that lie inside one of a column's open intervals."""
    at = np.searchsorted(lo, x, "left") - 1
    ok = (at >= 0) & (x < hi[at])  # NaN is in none
    return number[at[ok]], x[ok]


def _cells(df: DataFrame, cols: list[str], groups: list[list[_Target]]) -> DataFrame:
    """(g, x): the values inside interval ``g``; one entry a row and column at most."""
    spans = _intervals(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_inside(x, *s) for x, s in zip(_numbers(b), spans.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g for g, _ in got]), pa.int32()),
                                              pa.array(np.concatenate([x for _, x in got]), pa.float64())], names=["g", "x"])

    return _batches(df, [cols[c] for c in spans], run, "g int, x double")


def _thinned(df: DataFrame, cols: list[str], groups: list[list[_Target]]) -> DataFrame:
    """As ``_cells``, of each interval every ``STEP``-th value in order that a
    task holds, and one at least."""
    spans = _intervals(groups)

    def thin(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g, x = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.lexsort((x, g))
        g, x = g[order], x[order]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        n = np.diff(first, append=len(g))
        at = np.arange(len(g)) - np.repeat(first, n)
        keep = at % STEP == np.repeat(np.minimum(STEP // 2, (n - 1) // 2), n)
        return pa.RecordBatch.from_arrays([pa.array(g[keep], pa.int32()), pa.array(x[keep], pa.float64())], names=["g", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x, span in zip(_numbers(b), spans.values(), strict=True):
                held.append(_inside(x, *span))
                size += len(held[-1][1])
            if size >= HELD:
                yield thin(held)
                held, size = [], 0
        if size:
            yield thin(held)

    return _batches(df, [cols[c] for c in spans], run, "g int, x double")


def _segments(df: DataFrame, cols: list[str], groups: list[list[_Target]], bounds: dict[int, list[float]]) -> DataFrame:
    """(g, seg, n): the values of interval ``g`` between its bounds k-1 and k
    (seg 2k) and equal to bound k (2k+1). A row for each task and segment."""
    spans = _intervals(groups)
    start = np.cumsum([0] + [2 * len(bounds[g]) + 1 for g in range(len(groups))])
    # a column's intervals don't overlap, so its bounds in their order are ascending
    every, shift = {}, np.zeros(len(groups), np.int64)
    for c, (_, _, number) in spans.items():
        every[c] = np.array([x for g in number.tolist() for x in bounds[g]])
        before = np.cumsum([0] + [len(bounds[g]) for g in number.tolist()])[:-1]
        shift[number] = start[number] - 2 * before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(start[-1], np.int64)
        for b in batches:
            for x, c in zip(_numbers(b), spans, strict=True):
                g, x = _inside(x, *spans[c])
                seg = np.searchsorted(every[c], x, "left") + np.searchsorted(every[c], x, "right")
                total += np.bincount(shift[g] + seg, minlength=len(total))
        at = np.flatnonzero(total)
        g = np.searchsorted(start, at, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(at - start[g], pa.int32()), pa.array(total[at])],
                                         names=["g", "seg", "n"])

    return _batches(df, [cols[c] for c in spans], run, "g int, seg int, n long")


def _narrow(df: DataFrame, cols: list[str], groups: list[list[_Target]], grid: int) -> None:
    if not groups:
        return
    probs = [i / grid for i in range(grid + 1)]
    sketches = _thinned(df, cols, groups).groupBy("g").agg(F.percentile_approx("x", probs, 4 * grid).alias("cuts")).collect()
    cuts = {r["g"]: r["cuts"] for r in sketches}
    bounds = {}
    for g, ts in enumerate(groups):
        near = set()
        for t in ts:
            i = (t.rank - t.base) * grid // t.count
            near.update(cuts[g][max(0, i - 1):i + 3])
        bounds[g] = sorted(near)     # a handful of values per wanted rank
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in _segments(df, cols, groups, bounds).groupBy("g", "seg").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["g"], []).append((r["seg"], r["n"]))
    for g, ts in enumerate(groups):
        for t in ts:
            for s, n in sorted(counts[g]):
                if t.rank - t.base < n:
                    break
                t.base += n
            k = s // 2
            if s % 2:
                t.value = bounds[g][k]
            else:
                t.count = n
                if k > 0:
                    t.lo = bounds[g][k - 1]
                if k < len(bounds[g]):
                    t.hi = bounds[g][k]


def _rank(df: DataFrame, cols: list[str], groups: list[list[_Target]]) -> None:
    if not groups:
        return
    copies = _cells(df, cols, groups).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    want = [(g, off) for g, ts in enumerate(groups) for off in sorted({t.rank - t.base for t in ts})]
    table = df.sparkSession.createDataFrame(want, "g int, off long")      # one row per wanted rank
    hit = (copies.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(table), "g")
                 .where("upto - n <= off and off < upto").select("g", "off", "x").collect())
    found = {(r["g"], r["off"]): float(r["x"]) for r in hit}
    for g, ts in enumerate(groups):
        for t in ts:
            t.value = found[(g, t.rank - t.base)]


def _cut_ranks(n: int, bins: int) -> list[int]:
    return sorted({min(n - 1, (j * n) // bins) for j in range(1, bins)})


def percentiles_and_cuts(df: DataFrame, cols: list[str], probs: list[float], bins: int, **kw) -> tuple[dict, dict[str, list[float]]]:
    """``exact_percentiles`` and ``frequency_cuts`` of the same columns, by one search."""
    stats = _column_stats(df, cols)
    ranks = {i: [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))] + _cut_ranks(n, bins)
             for i, (n, _, _) in stats.items()}
    vals = order_statistics(df, cols, ranks, stats, **kw)
    out, cuts = {}, {}
    for i, c in enumerate(cols):
        if i not in stats:
            out[c], cuts[c] = (None, None, None, 0), []
            continue
        n, mn, mx = stats[i]
        qs = []
        for p in probs:
            at = (n - 1) * p
            a, b = vals[(i, math.floor(at))], vals[(i, math.ceil(at))]
            qs.append(a if a == b else a + (b - a) * (at - math.floor(at)))
        out[c] = (qs, mn, mx, n)
        cuts[c] = sorted({vals[(i, r)] for r in _cut_ranks(n, bins)})
    return out, cuts


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict:
    """{column: ([p-quantiles], min, max, n)} with linear interpolation."""
    return percentiles_and_cuts(df, cols, probs, 1, **kw)[0]


def frequency_cuts(df: DataFrame, cols: list[str], bins: int, **kw) -> dict[str, list[float]]:
    """Equal-frequency cut points per column: the distinct order statistics at
    0-based ranks floor(i·n/bins), i = 1 … bins−1 (exact, distributed)."""
    return percentiles_and_cuts(df, cols, [], bins, **kw)[1]
