"""Exact quantiles from additive counts (inventory A1, A3, A4, A8, A15, V1, D1, D3).

No task ever holds a value -> count map of a whole column. A double has an
order-preserving 64-bit key; the keys between a column's least and greatest
are cut into equal buckets, and one pass counts rows by (column, bucket,
group). Counts add up, so "all rows but fold k" is the total minus fold k, and
constant fills of missing cells are counts that nobody has to write into rows.
Only buckets that hold a wanted rank are cut again, until a bucket holds one
value, or few enough rows are left to read their values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c as named
from ..session import ship_package

#: Buckets that one column's wanted intervals are cut into, in all.
BUCKETS = 1024
#: With so few rows left in the wanted buckets, their values are read.
LAST_ROWS = 20_000
#: Up to so many groups of a batch are sorted one by one.
FEW_GROUPS = 64
#: Counts of a column that batches may add before they are merged.
HELD = 50_000
ALL = -1


def to_keys(v: np.ndarray) -> np.ndarray:
    """Order-preserving int64 keys of doubles (NaN greatest, -0.0 as 0.0)."""
    bits = np.ascontiguousarray(v + 0.0, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def to_values(keys: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(keys, np.int64)
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


class _Cut:
    """Disjoint sorted key intervals of one column, each in equal buckets."""

    def __init__(self, spans: list[tuple[int, int]], whole: bool, buckets: int):
        n = 1 if whole else max(2, buckets // max(1, len(spans)))
        self.lo = np.array([a for a, _ in spans], np.int64)
        self.hi = np.array([b for _, b in spans], np.int64)
        self.width = np.array([(b - a) // n + 1 for a, b in spans], np.uint64)
        self.n = n

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows within an interval, their cell numbers)."""
        at = np.searchsorted(self.lo, keys, "right") - 1
        rows = np.flatnonzero((at >= 0) & (keys <= self.hi[np.maximum(at, 0)]))
        at = at[rows]
        off = keys[rows].view(np.uint64) - self.lo[at].view(np.uint64)
        return rows, at * self.n + (off // self.width[at]).astype(np.int64)


def _ordered(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and groups by group, then key. Plain sorts of a few groups take a
    small part of the time of an order by two columns."""
    groups = np.unique(group)
    if len(groups) > FEW_GROUPS:
        order = np.lexsort((keys, group))
        return keys[order], group[order]
    parts = [np.sort(keys[group == g]) for g in groups]
    return (np.concatenate(parts) if parts else keys), np.repeat(groups, [len(p) for p in parts])


def _starts(cell: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where a new (group, cell) begins in sorted ones."""
    return np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (group[1:] != group[:-1])])


def _merged(parts: list[tuple]) -> tuple:
    """Counts (cell, grp, n, lo, hi) with one entry for each cell and group."""
    cell, group, n, lo, hi = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((cell, group))
    cell, group, n, lo, hi = (c[order] for c in (cell, group, n, lo, hi))
    new = _starts(cell, group)
    return cell[new], group[new], np.add.reduceat(n, new), np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new)


def _count(cuts: list[_Cut], exact: bool) -> Callable:
    """(column, cell, grp, n, lo, hi) of a partition; with ``exact`` each key is
    a cell of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in cuts]
        held, room = [0] * len(cuts), [HELD] * len(cuts)
        for batch in batches:
            group = batch.column(0)
            for i, cut in enumerate(cuts):
                col = batch.column(i + 1)
                g, v = group, col
                if col.null_count:
                    keep = col.is_valid()
                    g, v = group.filter(keep), col.filter(keep)
                keys = to_keys(v.to_numpy(zero_copy_only=False))
                rows = cut.cells(keys)[0]
                if not len(rows):
                    continue
                keys, g = _ordered(keys[rows], g.to_numpy(zero_copy_only=False)[rows])
                cell = keys if exact else cut.cells(keys)[1]     # rises with the keys
                new = _starts(cell, g)
                end = np.r_[new[1:], len(keys)]
                found[i].append((cell[new], g[new], end - new, keys[new], keys[end - 1]))
                held[i] += len(new)
                if held[i] > room[i]:
                    found[i] = [_merged(found[i])]
                    held[i] = len(found[i][0][0])
                    room[i] = 2 * held[i] + HELD
        rows = [(np.full(len(m[0]), i), *m) for i, parts in enumerate(found) if parts for m in [_merged(parts)]]
        cols = [np.concatenate(c) for c in zip(*rows)] if rows else [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         ["column", "cell", "grp", "n", "lo", "hi"])
    return run


def _models(groups: list[int], rest: bool) -> dict[int, list[tuple[int, int]]]:
    """Each model's group counts as (group, sign) terms; ``ALL`` is every row."""
    everything = [(g, 1) for g in groups]
    if not rest:
        return {g: [(g, 1)] for g in groups}
    return {g: everything + [(g, -1)] for g in groups} | {ALL: everything}


def quantiles_of(df: DataFrame, cols, probs, group: str | None = None, rest: bool = False,
                 fills: dict | None = None, buckets: int | None = None,
                 last_rows: int | None = None) -> dict:
    """{model: {column: [a quantile a prob] or None}}, interpolated as SQL's
    ``quantile_cont``; nulls are left out, a column without values gives None.

    Without ``group`` the one model is ``ALL`` (-1). With it (a whole-number
    column) every group is a model; with ``rest`` the model of group g is all
    rows outside g, and ``ALL`` all rows. ``fills``: {model: {column: (value,
    n)}}, n more rows of a value in that model. ``cols``: names, or {name:
    Column}. ``probs`` may be a function from a model's number of values to
    positions in their order (0 the least). The driver holds at most ``buckets`` counts a column and group."""
    buckets, last_rows = buckets or BUCKETS, LAST_ROWS if last_rows is None else last_rows
    exprs = cols if isinstance(cols, dict) else {x: named(x) for x in cols}
    names = list(exprs)
    positions = probs if callable(probs) else lambda n: [p * (n - 1) for p in probs]
    ship_package(df.sparkSession)
    g = F.col(group).cast("long") if group else F.lit(ALL).cast("long")
    flat = df.select(g.alias("_g"), *[e.cast("double").alias(f"_{i}") for i, e in enumerate(exprs.values())])
    ends = flat.groupBy("_g").agg(*[F.count(f"_{i}").alias(f"n{i}") for i in range(len(names))],
                                  *[F.min(f"_{i}").alias(f"a{i}") for i in range(len(names))],
                                  *[F.max(f"_{i}").alias(f"b{i}") for i in range(len(names))]).collect()
    groups = sorted(r["_g"] for r in ends if r["_g"] is not None) if group else [ALL]
    models = _models(groups, rest and group is not None)
    rows_of = {(i, r["_g"]): r[f"n{i}"] for r in ends for i in range(len(names))}
    extra = {(m, names.index(x)): (int(to_keys(np.array([v]))[0]), n)
             for m, per in (fills or {}).items() for x, (v, n) in per.items() if n}

    # what is wanted of column i: ranks of each model, within an interval of keys
    wanted, spans, known = [], [], []
    for i in range(len(names)):
        low = [to_keys(np.array([r[f"a{i}"]]))[0] for r in ends if r[f"a{i}"] is not None]
        top = [to_keys(np.array([r[f"b{i}"]]))[0] for r in ends if r[f"b{i}"] is not None]
        low += [k for (_, j), (k, _) in extra.items() if j == i]
        top += [k for (_, j), (k, _) in extra.items() if j == i]
        want = {}
        for m, terms in models.items():
            n = sum(s * rows_of.get((i, x), 0) for x, s in terms) + extra.get((m, i), (0, 0))[1]
            if n:
                pos = positions(n)
                for r in {f(x) for x in pos for f in (math.floor, math.ceil)}:
                    want[m, r] = (0, r)                      # (interval, rank within it)
        wanted.append(want)
        spans.append([(int(min(low)), int(max(top)))] if want else [])
        known.append({})

    left = sum(rows_of.values())
    while any(wanted):
        exact = left <= last_rows
        cuts = [_Cut(s, exact, buckets) if w else None for s, w in zip(spans, wanted)]
        open_ = [i for i, cut in enumerate(cuts) if cut]     # only columns that still want a rank are sent
        found = (flat.where("_g is not null").select("_g", *[f"_{i}" for i in open_]).mapInArrow(
            _count([cuts[i] for i in open_], exact), "column int, cell long, grp long, n long, lo long, hi long")
            .groupBy("column", "cell", "grp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"),
                                                  F.max("hi").alias("hi")).toArrow())
        rows_by = {}
        for row in zip(*[c.to_pylist() for c in found.columns]):
            rows_by.setdefault(open_[row[0]], []).append(row[1:])
        left = 0
        for i in range(len(names)):
            if wanted[i]:
                rows = rows_by.get(i, [])
                left += _narrow(cuts[i], rows, models, {m: e for (m, j), e in extra.items() if j == i},
                                exact, wanted, spans, known, i)
    out = {}
    for m in models:
        out[m] = {}
        for i, x in enumerate(names):
            n = sum(s * rows_of.get((i, k), 0) for k, s in models[m]) + extra.get((m, i), (0, 0))[1]
            out[m][x] = None if not n else [_between(known[i], m, p) for p in positions(n)]
    return out


def _between(known: dict, m: int, pos: float) -> float:
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = (float(to_values(np.array([known[m, r]]))[0]) for r in (lo, hi))
    return a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b


def _narrow(cut, rows, models, extra, exact, wanted, spans, known, i) -> int:
    """Find the cells of the wanted ranks of column ``i``; cells of one key are
    answers, the others the next intervals. Returns the rows left in these."""
    cells = {}
    for cell, group, n, a, b in rows:
        counts, lo, hi = cells.get(cell, ({}, a, b))
        counts[group] = n
        cells[cell] = (counts, min(lo, a), max(hi, b))
    virtual = {}
    for m, (key, n) in extra.items():
        at, cell = cut.cells(np.array([key], np.int64))
        if len(at):
            cell = key if exact else int(cell[0])
            virtual.setdefault(cell, {})[m] = n
            counts, lo, hi = cells.get(cell, ({}, key, key))
            cells[cell] = (counts, min(lo, key), max(hi, key))
    order = sorted(cells)
    keys = np.array([cells[x][1] for x in order], np.int64)
    owner = cut.cells(keys)[1] // cut.n                      # rises with the cells
    following, left, still, by_model = {}, 0, {}, {}
    for (m, r), where in wanted[i].items():
        by_model.setdefault(m, []).append((r, *where))
    for m, wishes in by_model.items():
        mine = np.array([sum(s * cells[x][0].get(g, 0) for g, s in models[m]) + virtual.get(x, {}).get(m, 0)
                         for x in order], np.int64)
        total = np.r_[0, np.cumsum(mine)]
        for r, span, rank in wishes:
            first = int(np.searchsorted(owner, span))
            k = int(np.searchsorted(total, total[first] + rank, "right")) - 1
            cell = order[k]
            counts, lo, hi = cells[cell]
            if lo == hi:
                known[i][m, r] = lo
                continue
            if cell not in following:
                following[cell] = (lo, hi)
                left += sum(counts.values())
            still[m, r] = (cell, rank - int(total[k] - total[first]))
    numbers = {cell: k for k, cell in enumerate(sorted(following))}
    spans[i] = [following[x] for x in sorted(following)]
    wanted[i] = {key: (numbers[cell], rank) for key, (cell, rank) in still.items()}
    return left
