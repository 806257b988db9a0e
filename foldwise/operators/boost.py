"""Histogram boosting of many models in shared passes (inventory M3-M6, V12).

Rows are binned once into written blocks. One pass over the blocks sums the
gradients by (model, node, feature, bin) for every model at once: folds,
candidates and target variants all ride on the same scan, so the number of
jobs follows the deepest tree, not the number of models. The driver holds the
histograms of the nodes that are asked for, never rows.

Trees grow leaf-wise: the split of largest gain first, up to ``leaves``. Which
nodes that order takes is known once all of its candidates have histograms, so
a pass asks for the children of every node that could still be taken, a level
at a time, and the finished tree is the one that strict best-first order gives.
A model waits for no other: each starts its next tree in the next pass.

Models whose rows fit a task (``TASK_BYTES``) need no passes: each is grown by
the same rules in one task, which reads the blocks once and keeps the rows of
every open node; of two children only the smaller one is summed.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c as named
from ..session import ensure_checkpoint_dir, ship_package
from .cv import ES_SPLIT_SEED, stop_masks  # noqa: F401
from .quantiles import quantiles_of

# ---- fixed values ----
FINAL_TREE_FACTOR, FINAL_MIN_TREES = 1.15, 50
# ----------------------
ALL = -1
BLOCK_ROWS = 32_768
#: States of the blocks that build on each other on local disks before one is
#: written: what a lost executor has to compute again.
CHAIN = 24
#: Rows of a partition: few in a small table, so that all cores take part.
SMALL_PART, LARGE_PART = 8_192, 50_000
#: Partial histograms of so few partitions are added on the driver.
DIRECT_PARTS = 16
#: Bytes of histograms that a pass asks of a partition; models beyond wait.
PASS_BYTES = 32 << 20
#: Bytes of a model's rows that one task may hold; larger models go by passes.
TASK_BYTES = 224 << 20
#: Size of the row groups of written blocks, looked at after every row.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(1 << 20),
          "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
          "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
          "parquet.enable.dictionary": "false"}
#: Rows whose bag is drawn at a time in a task.
BAG_ROWS = 1 << 18


@dataclass(frozen=True)
class Params:
    """Settings of one model; the defaults are the quick ones."""

    rounds: int = 500
    leaves: int = 31
    rate: float = 0.05
    l1: float = 0.1
    l2: float = 1.0
    min_child: int | None = None           # None: max(3, rows / 30)
    max_bin: int = 255
    colsample: float = 0.8
    subsample: float = 0.8
    patience: int | None = 50              # None: all rounds
    extra_trees: bool = False
    averaged: bool = False                 # a forest: trees of the same target, averaged
    seed: int = 42


@dataclass
class Job:
    """A model to fit: without the rows of ``fold`` (-1: on all rows), on the
    target ``label``. ``follows``: it has no rounds of its own but, when all
    other jobs of the call are done, their mean best round times a factor (M5,
    see :func:`rounds_of`); it grows along with them until then."""

    fold: int
    params: Params
    label: int = 0
    follows: bool = False


@dataclass
class Tree:
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])       # bin at or below which a row goes left
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        for column, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([v, v])
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        return a, a + 1

    def nodes(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The node where each row (or each of ``rows``) ends, from its bins
        (features x rows)."""
        at = np.zeros(bins.shape[1], np.int32)
        todo = [(0, np.arange(bins.shape[1]) if rows is None else rows)]
        while todo:
            node, some = todo.pop()
            if self.feature[node] < 0:
                at[some] = node
                continue
            low = bins[self.feature[node]][some] <= self.cut[node]
            todo += [(self.left[node], some[low]), (self.right[node], some[~low])]
        return at if rows is None else at[rows]

    def rows_at(self, bins: np.ndarray, rows: np.ndarray, asked: list[int]) -> list[np.ndarray]:
        """Those of ``rows`` that end at each of the nodes ``asked``, in their
        order. Only branches that lead there are followed."""
        above = dict(zip(self.left, range(len(self.left)))) | dict(zip(self.right, range(len(self.right))))
        way = set()
        for node in asked:
            while node and node not in way:
                way.add(node)
                node = above[node]
        found: dict = {}
        todo = [(0, rows)]
        while todo:
            node, some = todo.pop()
            if self.feature[node] < 0:
                found[node] = some
                continue
            a, b = self.left[node], self.right[node]
            low = bins[self.feature[node]][some] <= self.cut[node]
            todo += [(child, some[part]) for child, part in ((a, low), (b, ~low)) if child in way]
        return [found[node] for node in asked]

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """A fitted model: ``edges`` cut each feature into bins."""

    features: list
    fills: list
    edges: list
    start: float
    trees: list
    rate: float
    grown: int                              # trees grown before the best round was taken
    scores: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return bin_rows(x, self.fills, [np.array(e) for e in self.edges])

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bins(x), np.full(len(x), self.start)
        for t in self.trees:
            out += self.rate * t.values(bins)
        return out

    def split_counts(self) -> dict:
        """M9: how often each feature is split on."""
        counts = dict.fromkeys(self.features, 0)
        for t in self.trees:
            for f in t.feature:
                if f >= 0:
                    counts[self.features[f]] += 1
        return counts

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Boosted:
        return Boosted(**{**d, "trees": [Tree(**t) for t in d["trees"]]})


def bin_rows(x: np.ndarray, fills, edges) -> np.ndarray:
    """Bins (features x rows) of rows of values, missing ones filled."""
    out = np.empty(x.shape[::-1], np.uint16)
    for j, e in enumerate(edges):
        v = x[:, j]
        out[j] = np.searchsorted(e, np.where(np.isnan(v), fills[j], v), "left")
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def number_of(*parts) -> int:
    """A 60-bit number that names its parts (md5)."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def in_bag(h: np.ndarray, p: Params, tree: int) -> np.ndarray:
    """Rows (by their hashes) that a tree learns from."""
    if p.subsample >= 1:
        return np.ones(len(h), bool)
    return _mix(h ^ np.uint64(number_of(p.seed, tree))) < np.uint64(int(p.subsample * 2**64))


def columns_of(p: Params, tree: int, d: int) -> list[int]:
    """Features that a tree may split on."""
    n = max(1, round(p.colsample * d))
    return sorted(sorted(range(d), key=lambda j: number_of(p.seed, tree, "column", j))[:n])


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(g: np.ndarray, n: np.ndarray, columns, p: Params, min_child: int, name: str):
    """(gain, feature, cut) of a node's histograms (features x bins), or None.
    The first of equal gains. ``extra_trees`` looks at one threshold a
    feature, drawn by md5 between the node's own least and greatest bin."""
    return best_splits(g[None], n[None], columns, p, min_child, [name])[0]


def best_splits(g: np.ndarray, n: np.ndarray, columns, p: Params, min_child: int, names, widths=None) -> list:
    """`best_split` of several nodes (nodes x features x bins). ``widths``: bins
    of each feature, where they are fewer than the histograms hold."""
    def score(a, b):
        out = np.abs(a)
        out -= p.l1
        np.maximum(out, 0, out=out)
        out *= out
        out /= np.maximum(b + p.l2, 1e-12)
        return out

    nodes = np.arange(len(g))
    top, at, where = np.full(len(g), -np.inf), np.zeros(len(g), int), np.zeros(len(g), int)
    for j, column in enumerate(columns):
        width = widths[column] if widths else g.shape[2]
        gl, nl = np.cumsum(g[:, j, :width], axis=1), np.cumsum(n[:, j, :width], axis=1)
        total, rows = gl[:, -1:].copy(), nl[:, -1:].copy()
        if p.extra_trees:
            cuts = np.full(len(g), -1)
            for i, name in enumerate(names):
                full = np.flatnonzero(n[i, j, :width])
                if len(full) > 1:
                    cuts[i] = full[0] + number_of(name, column) % (full[-1] - full[0])
            gl, nl = gl[nodes, cuts][:, None], nl[nodes, cuts][:, None]
        gain = score(gl, nl)
        gain += score(total - gl, rows - nl)
        gain -= score(total, rows)
        gain[(nl < min_child) | (rows - nl < min_child)] = -np.inf
        k = np.argmax(gain, axis=1)
        best = gain[nodes, k]
        if p.extra_trees:
            best[cuts < 0], k = -np.inf, cuts
        more = best > top
        top[more], at[more], where[more] = best[more], j, k[more]
    return [(t, columns[j], k) if t > 1e-12 else None for t, j, k in zip(top.tolist(), at.tolist(), where.tolist())]


class _Growth:
    """A model while it is fitted: its trees, and the one that is growing."""

    def __init__(self, number: int, job: Job, slot: int, view: int, size: int, rows: int, start: float, d: int,
                 widths: list[int] | None = None):
        self.number, self.job, self.slot, self.view, self.size, self.widths = number, job, slot, view, size, widths
        self.start, self.d = start, d
        self.p = job.params
        self.min_child = self.p.min_child or max(3, rows // 30)
        self.rate = 1.0 if self.p.averaged else self.p.rate
        self.done_trees: list[Tree] = []
        self.held = 0                        # trees whose effect the blocks hold
        self.scores: list[float] = []
        self.finished = False
        self.new_tree()

    def new_tree(self):
        self.tree, self.splits, self.sums = Tree(), {}, {}
        self.columns = columns_of(self.p, len(self.done_trees), self.d)
        self.asked = [0]

    @property
    def bytes(self) -> int:
        return 16 * len(self.asked) * len(self.columns) * self.size

    def request(self) -> dict:
        return {"number": self.number, "slot": self.slot, "size": self.size, "view": self.view, "fold": self.job.fold, "label": self.job.label,
                "params": self.p, "tree_number": len(self.done_trees), "start": self.start, "rate": self.rate,
                "recent": [] if self.p.averaged else self.done_trees[self.held:], "tree": self.tree, "asked": self.asked, "columns": self.columns}

    def receive(self, squares: float, rows: int, g: np.ndarray, n: np.ndarray) -> None:
        if self.asked == [0]:                # the state before this tree
            if rows:
                self.scores.append(squares / rows)
                best = int(np.argmin(self.scores))
                if self.p.patience is not None and len(self.scores) - 1 - best >= self.p.patience:
                    self.finished = True
            if not self.job.follows and len(self.done_trees) >= self.p.rounds:
                self.finished = True
            if self.finished:
                return
        names = [f"{self.p.seed}|{len(self.done_trees)}|{node}" for node in self.asked]
        for k, (node, split) in enumerate(zip(self.asked, best_splits(
                g, n, self.columns, self.p, self.min_child, names, self.widths))):
            self.sums[node] = (float(g[k, 0].sum()), int(n[k, 0].sum()))
            if split:
                _, feature, cut = split
                j = self.columns.index(feature)
                split += (float(g[k, j, :cut + 1].sum()), int(n[k, j, :cut + 1].sum()))
            self.splits[node] = split
        self.grow()

    def grow(self) -> None:
        """Follow best-first order; ask for what it may need next."""
        taken = self._taken()
        ask = []
        for node in taken:
            if self.tree.feature[node] < 0:
                _, feature, cut, gl, nl = self.splits[node]
                a, b = self.tree.split(node, feature, cut)
                g, n = self.sums[node]
                for child, cg, cn in ((a, gl, nl), (b, g - gl, n - nl)):
                    self.sums[child] = (cg, cn)
                    if cn >= 2 * self.min_child:
                        ask.append(child)
                    else:
                        self.splits[child] = None
        if ask:
            self.asked = ask
            return
        self.done_trees.append(self._cut_back(set(taken)))
        self.new_tree()

    def _taken(self) -> list[int]:
        """Nodes split in best-first order, as far as histograms are known."""
        heap, taken = [], []

        def push(node):
            if self.splits.get(node):
                heapq.heappush(heap, (-self.splits[node][0], node))

        push(0)
        while heap and len(taken) < self.p.leaves - 1:
            _, node = heapq.heappop(heap)
            taken.append(node)
            if self.tree.feature[node] >= 0:
                push(self.tree.left[node])
                push(self.tree.right[node])
        return taken

    def _cut_back(self, taken: set) -> Tree:
        """The grown tree without the nodes that were only looked at."""
        out = Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop(0)
            if old in taken:
                a, b = out.split(new, self.tree.feature[old], self.tree.cut[old])
                todo += [(self.tree.left[old], a), (self.tree.right[old], b)]
            else:
                g, n = self.sums[old]
                out.value[new] = float(-_shrunk(g, self.p.l1) / max(n + self.p.l2, 1e-12))
        return out

    def best(self) -> int:
        """Rounds of the best score, or all."""
        return max(1, int(np.argmin(self.scores))) if self.scores else self.p.rounds

    def result(self, features, fills, edges) -> Boosted:
        trees, rate = self.done_trees, self.rate
        if not self.p.averaged:
            trees = trees[:self.best()]
        if self.p.averaged:
            rate = 1.0 / max(1, len(trees))
        return Boosted(list(features), list(fills), [list(map(float, e)) for e in edges], self.start, trees, rate,
                       len(self.done_trees), self.scores)


BLOCK = "block long, n int, h binary, fold binary, stop binary, y binary, bins binary, pred binary"


def _blocks(d: int, labels: int, views: list, models: int) -> Callable:
    """Rows (h, fold, stop, labels.., features..) as blocks of arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block():
            rows = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(rows[0], kind="stable")
            h, fold, stop, *cols = [c[order] for c in rows]
            x = np.column_stack(cols[labels:])
            bins = np.stack([bin_rows(x, fills, edges) for fills, edges in views])
            pred = np.zeros((models, len(h)))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([int(h[0])], pa.int64()), "n": pa.array([len(h)], pa.int32()),
                "h": [h.tobytes()], "fold": [fold.astype(np.int32).tobytes()], "stop": [stop.tobytes()],
                "y": [np.stack(cols[:labels]).astype(float).tobytes()], "bins": [bins.tobytes()],
                "pred": [pred.tobytes()]})

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) if i < 3 else
                         c.to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(batch.columns)])
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield block()
                held, count = [], 0
        if count:
            yield block()
    return run


class _Block:
    def __init__(self, row, d: int, labels: int, views: int):
        n = self.n = row["n"]
        self.h = np.frombuffer(row["h"], np.int64).view(np.uint64)
        self.fold = np.frombuffer(row["fold"], np.int32)
        self.stop = np.frombuffer(row["stop"], np.int64)
        self.y = np.frombuffer(row["y"]).reshape(labels, n)
        self.bins = np.frombuffer(row["bins"], np.uint16).reshape(views, d, n)
        self.pred = np.frombuffer(row["pred"]).reshape(-1, n)

    def with_state(self, pred: np.ndarray) -> _Block:
        out = copy.copy(self)
        out.pred = pred
        return out

    def state(self, q: dict, rows: np.ndarray | None = None) -> np.ndarray:
        """The model's predictions so far, of all rows or of ``rows``."""
        if q["params"].averaged:
            return np.full(self.n if rows is None else len(rows), q["start"])
        pred, bins = self.pred[q["slot"]], self.bins[q["view"]]
        out = q["start"] + (pred if rows is None else pred[rows])
        for t in q["recent"]:
            out = out + q["rate"] * np.array(t.value)[t.nodes(bins, rows)]
        return out


def _sums(requests: list[dict], own: bool) -> Callable:
    """(model, (squares, rows, gradient and count histograms)) of a partition."""
    def run(blocks: Iterator[_Block]) -> Iterator[tuple]:
        held: dict = {}
        for b in blocks:
            for q in requests:
                _add(held, b, q, own)
        return iter(held.items())
    return run


def _add(held: dict, b: _Block, q: dict, own: bool) -> None:
    p, bins, size = q["params"], b.bins[q["view"]], q["size"]
    y = b.y[q["label"]]
    trains = (b.fold == q["fold"]) if own else (b.fold != q["fold"])
    stops = trains & (b.stop >> max(q["fold"], 0) & 1).astype(bool) if q["fold"] != ALL else np.zeros(b.n, bool)
    if p.patience is None or p.averaged:
        stops[:] = False
    asked, columns = q["asked"], q["columns"]
    known = ~np.isnan(y)
    rows_in = np.flatnonzero(trains & ~stops & known & in_bag(b.h, p, q["tree_number"]))
    squares = rows = 0
    if asked == [0]:
        held_out = np.flatnonzero(stops & known)
        e = b.state(q, held_out) - y[held_out]
        squares, rows = float(e @ e), len(e)
        parts = [rows_in]
    else:
        parts = q["tree"].rows_at(bins, rows_in, asked)
        rows_in = np.concatenate(parts)
    base = np.repeat(np.arange(len(asked)) * size, [len(part) for part in parts])
    gradient = b.state(q, rows_in) - y[rows_in]
    g = np.zeros((len(asked), len(columns), size))
    n = np.zeros((len(asked), len(columns), size), np.int64)
    for k, j in enumerate(columns):
        cell = base + bins[j][rows_in]
        g[:, k] = np.bincount(cell, gradient, len(asked) * size).reshape(-1, size)
        n[:, k] = np.bincount(cell, minlength=len(asked) * size).reshape(-1, size)
    old = held.get(q["number"])
    held[q["number"]] = (squares, rows, g, n) if old is None else (
        old[0] + squares, old[1] + rows, old[2] + g, old[3] + n)


def _advanced(requests: list[dict]) -> Callable:
    """A block with the effect of the recent trees."""
    def run(b: _Block) -> _Block:
        pred = b.pred.copy()
        for q in requests:
            pred[q["slot"]] = b.state(q) - q["start"]
        return b.with_state(pred)
    return run


def fit_models(df: DataFrame, features, labels, key: str, fold: str, jobs: list[Job],
               n_rows: int | None = None, passes: list | None = None, own: bool = False,
               tasks: bool = True) -> list[Boosted]:
    """Fit every job in shared passes. ``labels``: target columns; a row whose
    label is null does not take part in models of that label. Missing feature
    cells are filled with the median of the model's own training rows, and
    bins are quantiles of them. ``own``: a job learns from the rows of its fold
    (a long frame with a copy of the rows for each model). ``passes``: receives the number of models of
    each pass (for tests and reports). ``tasks``: models that fit a task are
    grown there; sums are added in another order than by passes, which decides
    between splits of equal gain."""
    spark = df.sparkSession
    ship_package(spark)
    features, labels = list(features), list(labels)
    names = [f"_x{i}" for i in range(len(features))]
    flat = df.select(F.col(key).cast("string").alias("_key"), F.col(fold).cast("int").alias("_fold"),
                     *[named(y).cast("double").alias(f"_y{i}") for i, y in enumerate(labels)],
                     *[named(x).cast("double").alias(n) for n, x in zip(names, features)])
    folds = sorted({j.fold for j in jobs})
    counts = {r["_fold"]: r for r in flat.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_y{i}").alias(f"s{i}") for i in range(len(labels))],
        *[F.count(f"_y{i}").alias(f"c{i}") for i in range(len(labels))]).collect()}
    n = n_rows or sum(r["n"] for r in counts.values())
    keys = sorted({(j.fold, j.params.max_bin) for j in jobs})
    views = _views(flat, names, keys, own)
    stop = stop_masks(flat, "_key", "_fold", [f for f in folds if any(
        j.fold == f and j.params.patience is not None and not j.params.averaged for j in jobs)], own)
    parts = max(min(n // SMALL_PART + 1, DIRECT_PARTS), n // LARGE_PART + 1)
    parts = min(parts, max(DIRECT_PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = flat.select(F.xxhash64("_key").alias("h"), "_fold", stop.alias("stop"),
                       *[f"_y{i}" for i in range(len(labels))], *names).repartition(parts, "h")
    alone = tasks and all(sum(r["n"] for f, r in counts.items() if (f == fold) == own)
                          * _row_bytes(len(names), len(labels), views[v][1]) <= TASK_BYTES for v, (fold, _) in enumerate(keys))
    slots = [] if alone else [m for m, j in enumerate(jobs) if not j.params.averaged]
    dims = (len(names), len(labels), len(views))
    blocks = _written(rows.mapInArrow(_blocks(*dims[:2], views, len(slots)), BLOCK))
    growing = []
    for m, job in enumerate(jobs):
        trains = [r for f, r in counts.items() if (f == job.fold) == own]
        have = sum(r[f"c{job.label}"] for r in trains)
        start = sum(r[f"s{job.label}"] or 0.0 for r in trains) / max(1, have)
        view = keys.index((job.fold, job.params.max_bin))
        widths = [len(e) + 1 for e in views[view][1]]
        growing.append(_Growth(m, job, slots.index(m) if m in slots else -1, view, max(widths), have, start, len(names),
                               widths))
    if alone:
        if passes is not None:
            passes.append(len(jobs))
        rows_of = {f: sum(r["n"] for g, r in counts.items() if (g == f) == own) for f in folds}
        _grow_in_tasks(blocks, growing, dims[:2], rows_of, own)
        return [g.result(features, *views[g.view]) for g in growing]
    # the written blocks are read again by every pass until a state is made:
    # megabytes a row in the heap's cache leave the tasks none
    blocks = blocks.rdd.map(lambda r: _Block(r, *dims))
    links, old = 0, []
    while active := [g for g in growing if not g.finished]:
        if passes is not None:
            passes.append(len(active))
        room, turn = PASS_BYTES, []
        for g in sorted(active, key=lambda g: (g.asked == [0], len(g.done_trees), g.number)):
            room -= g.bytes                                  # begun trees first
            if room >= 0 or not turn:
                turn.append(g)
        got = blocks.mapPartitions(_sums([g.request() for g in turn], own))
        for m, sums in sorted(_added(got, parts).items()):
            growing[m].receive(*sums)
        if all(g.finished or g.job.follows for g in growing):
            rounds = rounds_of([g.best() for g in growing if not g.job.follows])
            for g in growing:
                if g.job.follows:
                    g.p = replace(g.p, rounds=rounds)
                    g.finished = len(g.done_trees) >= rounds
        # trees that the blocks do not hold yet: a new state builds on the last
        # one on local disks, and is made by the pass that first needs it
        pending = sum(len(g.done_trees) - g.held for g in active if not g.p.averaged)
        for x in old:
            x.unpersist()
        old = []
        if pending >= max(1, len(active)):
            old, links = [blocks], links + 1
            blocks = blocks.map(_advanced([g.request() for g in growing if g.slot >= 0]))
            blocks = blocks.persist(StorageLevel.DISK_ONLY)
            if links % CHAIN == 0:
                blocks.checkpoint()
            for g in growing:
                g.held = len(g.done_trees)
    for x in [*old, blocks]:
        x.unpersist()
    return [g.result(features, *views[g.view]) for g in growing]


def _row_bytes(d: int, labels: int, edges: list) -> int:
    """Bytes of a row in a task: hash, targets, places in nodes, bins."""
    return 24 + 8 * labels + d * (1 if max(map(len, edges), default=0) < 256 else 2)


class _Rows:
    """The rows that the models of one view learn from, in one task."""

    def __init__(self, blocks: Iterator, n: int, d: int, labels: list[int], of: int, fold: int, own: bool, small: bool):
        self.h, self.stop = np.empty(n, np.uint64), np.zeros(n, bool)
        self.y = {i: np.empty(n) for i in labels}
        self.bins = np.empty((d, n), np.uint8 if small else np.uint16)
        at = 0
        for r in blocks:
            code = np.frombuffer(r["fold"], np.int32)
            mine = np.flatnonzero((code == fold) if own else (code != fold))
            to = slice(at, at + len(mine))
            self.h[to] = np.frombuffer(r["h"], np.uint64)[mine]
            if fold != ALL:
                self.stop[to] = (np.frombuffer(r["stop"], np.int64)[mine] >> fold & 1).astype(bool)
            y = np.frombuffer(r["y"]).reshape(of, -1)
            for i in labels:
                self.y[i][to] = y[i][mine]
            for j, b in enumerate(np.frombuffer(r["bins"], np.uint16).reshape(d, -1)):
                self.bins[j, to] = b[mine]
            at += len(mine)
        assert at == n, f"{at} rows of {n}"

    def bag(self, inside: np.ndarray, p: Params, tree: int) -> np.ndarray:
        """Places of the rows ``inside`` that a tree learns from."""
        parts = []
        for a in range(0, len(inside), BAG_ROWS):
            some = slice(a, a + BAG_ROWS)
            parts.append((np.flatnonzero(inside[some] & in_bag(self.h[some], p, tree)) + a).astype(np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def sums(self, parts: list[np.ndarray], columns: list[int], size: int, miss: np.ndarray) -> tuple:
        """Histograms of the gradient and the rows of nodes (nodes x features x bins)."""
        g = np.empty((len(parts), len(columns), size))
        n = np.empty((len(parts), len(columns), size), np.int64)
        rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
        base = np.repeat(np.arange(len(parts)) * size, [len(part) for part in parts]) if len(parts) > 1 else 0
        weight = miss[rows]
        for k, j in enumerate(columns):
            cell = self.bins[j][rows] + base
            g[:, k] = np.bincount(cell, weight, len(parts) * size).reshape(-1, size)
            n[:, k] = np.bincount(cell, minlength=len(parts) * size).reshape(-1, size)
        return g, n


def _grow(g: _Growth, data: _Rows, miss: np.ndarray) -> None:
    """All trees of a model. ``miss``: its targets, which become the gradient."""
    known = ~np.isnan(miss)
    stops = data.stop & known if g.p.patience is not None and not g.p.averaged else np.zeros(len(known), bool)
    inside, held = known & ~stops, np.flatnonzero(stops)
    del known, stops
    np.subtract(g.start, miss, out=miss)
    while not g.finished:
        tree, number = g.tree, len(g.done_trees)
        rows = data.bag(inside, g.p, number)
        at, seen = {0: rows}, {}
        squares = float(miss[held] @ miss[held])
        while not g.finished and len(g.done_trees) == number:
            if g.asked == [0]:
                a, n = data.sums([rows], g.columns, g.size, miss)
            else:
                a, n = _children(g, data, miss, at, seen)
            asked = g.asked
            g.receive(squares, len(held), a, n)
            seen |= {node: (a[k], n[k]) for k, node in enumerate(asked)}
        if len(g.done_trees) > number and not g.p.averaged:
            _part(tree, data.bins, at, seen)
            _move(miss, g.rate, tree, g.done_trees[-1], at, data.bins, rows)


def _part(tree: Tree, bins: np.ndarray, at: dict, seen: dict) -> list[tuple]:
    """Deal the rows of nodes that were split since they were seen to their
    children; (the node's histograms, left, right) of each."""
    out = []
    for node in [x for x in seen if tree.feature[x] >= 0]:
        rows, a, b = at.pop(node), tree.left[node], tree.right[node]
        low = bins[tree.feature[node]][rows] <= tree.cut[node]
        at[a], at[b] = rows[low], rows[~low]
        out.append((seen.pop(node), a, b))
    return out


def _children(g: _Growth, data: _Rows, miss: np.ndarray, at: dict, seen: dict) -> tuple:
    """Histograms of the nodes asked for: the smaller of two children is summed,
    the other is its parent without it."""
    asked = set(g.asked)
    pairs = [(whole, a, b) if len(at[a]) <= len(at[b]) else (whole, b, a)
             for whole, a, b in _part(g.tree, data.bins, at, seen) if a in asked or b in asked]
    part, count = data.sums([at[a] for _, a, _ in pairs], g.columns, g.size, miss)
    found = {}
    for k, (whole, a, b) in enumerate(pairs):
        found[a] = part[k], count[k]
        if b in asked:
            rest = whole[1] - count[k]
            found[b] = np.where(rest > 0, whole[0] - part[k], 0.0), rest
    return np.stack([found[x][0] for x in g.asked]), np.stack([found[x][1] for x in g.asked])


def _move(miss: np.ndarray, rate: float, grown: Tree, tree: Tree, at: dict, bins: np.ndarray, rows: np.ndarray) -> None:
    """Add a finished tree to the predictions: rows it learned from lie at the
    nodes of the ``grown`` tree, the others go down."""
    rest = np.ones(len(miss), bool)
    rest[rows] = False
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop()
        if tree.feature[new] >= 0:
            todo += [(grown.left[old], tree.left[new]), (grown.right[old], tree.right[new])]
            continue
        below = [old]
        while below:
            node = below.pop()
            if node in at:
                miss[at[node]] += rate * tree.value[new]
            else:
                below += [grown.left[node], grown.right[node]]
    other = np.flatnonzero(rest)
    value = rate * np.array(tree.value)
    for a in range(0, len(other), BAG_ROWS):
        some = other[a:a + BAG_ROWS]
        miss[some] += value[tree.nodes(bins[:, some])]


def _grown(growing: list[_Growth], n: int, dims: tuple[int, int], small: bool, own: bool) -> Callable:
    """(number, trees, scores) of models of one view, from its blocks."""
    def run(blocks: Iterator) -> Iterator[tuple]:
        labels = [g.job.label for g in growing]
        data = _Rows(blocks, n, dims[0], sorted(set(labels)), dims[1], growing[0].job.fold, own, small)
        for i, g in enumerate(growing):
            last = g.job.label not in labels[i + 1:]
            _grow(g, data, data.y.pop(g.job.label) if last else data.y[g.job.label].copy())
            yield g.number, g.done_trees, g.scores
    return run


def _grow_in_tasks(blocks: DataFrame, growing: list[_Growth], dims: tuple[int, int], rows_of: dict, own: bool) -> None:
    """Grow every model in one task. One that follows grows as many rounds as it
    can be told to have, and is cut when the others are known."""
    d, spark = dims[0], blocks.sparkSession
    lead = [g for g in growing if not g.job.follows]
    sent = [copy.copy(g) for g in growing]
    for g in sent:
        if g.job.follows:
            g.job, g.p = replace(g.job, follows=False), replace(g.p, rounds=rounds_of([x.p.rounds for x in lead]))
    turns = _dealt(sent, spark.sparkContext.defaultParallelism)
    parts = []
    for turn in turns:
        first = turn[0]
        bins = F.expr(f"substring(bins, {first.view} * n * {2 * d} + 1, n * {2 * d})").alias("bins")
        # every task reads all blocks, one after the other: no row is shuffled
        own_blocks = blocks.select("h", "fold", "stop", "y", bins).coalesce(1).rdd
        parts.append(own_blocks.mapPartitions(_grown(turn, rows_of[first.job.fold], dims, first.size <= 256, own)))
    for number, trees, scores in spark.sparkContext.union(parts).collect() if parts else []:
        growing[number].done_trees, growing[number].scores = trees, scores
    rounds = rounds_of([g.best() for g in lead])
    for g in growing:
        if g.job.follows:
            g.p, g.done_trees = replace(g.p, rounds=rounds), g.done_trees[:rounds]


def _dealt(growing: list[_Growth], cores: int) -> list[list[_Growth]]:
    """Models by task, the longest first: a boosted one has a task of its own,
    trees of forests share the rows of their view."""
    single = [[g] for g in growing if g.p.rounds > 1]
    views: dict[int, list] = {}
    for g in growing:
        if g.p.rounds <= 1:
            views.setdefault(g.view, []).append(g)
    each = max(1, -(-sum(map(len, views.values())) // (2 * cores)))
    shared = [v[a:a + each] for v in views.values() for a in range(0, len(v), each)]
    return sorted(single + shared, key=lambda t: -sum(g.p.rounds * g.p.leaves for g in t))


def _written(blocks: DataFrame) -> DataFrame:
    """Blocks written to the shared folder: a lost executor reads them again.
    A block is megabytes, so row groups end by their size after every row: the
    writer and the reader hold one of them, not the blocks of a partition."""
    path = f"{ensure_checkpoint_dir(blocks.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    blocks.write.options(**GROUPS).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _add_sums(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _added(partial: RDD, parts: int) -> dict:
    """Partial sums of the partitions by model."""
    if parts > DIRECT_PARTS:
        return dict(partial.reduceByKey(_add_sums).collect())
    out: dict = {}
    for m, (*sums, n) in partial.mapValues(_short).collect():       # in the order of the partitions
        sums = (*sums, n.astype(np.int64))
        out[m] = _add_sums(out[m], sums) if m in out else sums
    return out


def _short(sums: tuple) -> tuple:
    """Counts of one partition fit four bytes."""
    return (*sums[:-1], sums[-1].astype(np.int32))


def _views(flat: DataFrame, names: list[str], keys: list[tuple[int, int]], own: bool) -> list[tuple[list, list]]:
    """(fills, edges) by (fold, max_bin): medians and bin edges of the model's
    training rows."""
    found = {}
    for size in sorted({b for _, b in keys}):
        probs = [0.5] + [k / size for k in range(1, size)]
        found[size] = quantiles_of(flat, names, probs, "_fold", not own)
    out = []
    for fold, size in keys:
        per = found[size].get(fold, {})
        fills = [per[x][0] if per.get(x) else 0.0 for x in names]
        out.append((fills, [np.array(sorted(set(per[x][1:]))) if per.get(x) else np.zeros(0) for x in names]))
    return out


def add_predictions(df: DataFrame, model: dict, out: str) -> DataFrame:
    """``df`` with the predictions of a saved model in column ``out``."""
    ship_package(df.sparkSession)
    fitted = Boosted.from_dict(model)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(fitted.predict(rows.to_numpy(float)))

    cells = [named(x).cast("double").alias(f"_x{i}") for i, x in enumerate(fitted.features)]
    return df.withColumn(out, score(F.struct(*cells)))


def forest(job: Job, trees: int) -> list[Job]:
    """A forest as one-tree jobs that only differ by seed: they share passes."""
    return [replace(job, params=replace(job.params, rounds=1, averaged=True, patience=None,
                                        seed=job.params.seed + 7919 * t)) for t in range(trees)]


def averaged(members: list[Boosted]) -> Boosted:
    """One-tree models of the same rows as one averaged model."""
    first = members[0]
    trees = [t for m in members for t in m.trees]
    return replace(first, trees=trees, rate=1.0 / max(1, len(trees)), grown=len(trees))


def predictions(df: DataFrame, features, models: dict, key: str, fold: str | None, out: str = "pred",
                keep=()) -> DataFrame:
    """``df`` rows (key, fold, kept columns) with the prediction of the model of
    their fold (``fold`` None: of model -1)."""
    spark = df.sparkSession
    ship_package(spark)
    cols = [F.col(key).alias("_key"), (F.col(fold) if fold else F.lit(ALL)).cast("int").alias("_fold"),
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
            *[named(x).cast("double").alias(f"_x{i}") for i, x in enumerate(features)]]
    flat = df.select(*cols)
    k = 2 + len(keep)

    def run(batches):
        for batch in batches:
            code = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[k:]])
            pred = np.full(len(code), np.nan)
            for m in np.unique(code):
                if int(m) in models:
                    pred[code == m] = models[int(m)].predict(x[code == m])
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(pred)],
                                             [*batch.schema.names[:k], "_pred"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:k])
    got = flat.mapInArrow(run, f"{kinds}, _pred double")
    pred = F.when(F.isnan("_pred"), F.lit(None)).otherwise(F.col("_pred")).alias(out)
    return got.select(F.col("_key").alias(key), *([F.col("_fold").alias(fold)] if fold else []),
                      *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], pred)


def rounds_of(iters) -> int:
    """M5: rounds of the final fit: max(50, 1.15 x mean best round)."""
    return max(FINAL_MIN_TREES, int(float(np.mean(iters)) * FINAL_TREE_FACTOR)) if len(iters) else FINAL_MIN_TREES
