"""Shared-pass boosting against a plain NumPy booster."""

import numpy as np
import pytest

from foldwise.operators import boost as B

N, D, FOLDS = 2000, 4, 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=N), rng.integers(0, 9, N), rng.random(N), rng.normal(size=N).round(1)])
    x[::11, 2] = np.nan
    y = 3 * x[:, 0] + (x[:, 1] - 4) ** 2 + np.where(np.nan_to_num(x[:, 2]) > 0.6, 5, 0) + rng.normal(size=N) * 0.3
    return x, y, rng.integers(0, FOLDS, N)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold = data
    rows = [(f"k{i}", int(fold[i]), float(y[i]), float(-y[i] / 2),
             *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(N)]
    return spark.createDataFrame(rows, "key string, fold int, y double, z double, " +
                                 ", ".join(f"`x.{j}` double" for j in range(D))).repartition(3).cache()


FEATURES = [f"x.{j}" for j in range(D)]


def _hashes(spark, table):
    import pyspark.sql.functions as F
    got = table.select("key", F.xxhash64("key").alias("h")).collect()
    return {int(r["key"][1:]): r["h"] for r in got}


def _stop_rows(fold, f):
    import hashlib
    train = [i for i in range(N) if fold[i] != f]
    order = sorted(train, key=lambda i: hashlib.md5(f"{B.ES_SPLIT_SEED + f}|k{i}".encode()).hexdigest()[:13])
    return set(order[:max(1, round(len(train) * 0.1))])


def _plain(x, y, fold, f, p, h, rounds):
    """Strict best-first trees, one split at a time, on plain arrays."""
    train = fold != f
    med = [np.nanmedian(x[train, j]) for j in range(D)]
    xf = np.where(np.isnan(x), med, x)
    bins = np.column_stack([np.searchsorted(np.unique(np.quantile(
        x[train & ~np.isnan(x[:, j]), j], [k / p.max_bin for k in range(1, p.max_bin)])), xf[:, j]) for j in range(D)])
    stop = np.zeros(N, bool)
    if p.patience is not None:
        stop[list(_stop_rows(fold, f))] = True
    pred = np.full(N, y[train].mean())
    child = p.min_child or max(3, int(train.sum()) // 30)
    scores, trees = [np.mean((pred - y)[stop] ** 2)] if stop.any() else [], []
    for t in range(rounds):
        cols = B.columns_of(p, t, D)
        rows = np.flatnonzero(train & ~stop & B.in_bag(h, p, t))
        g = pred - y

        def best(idx):
            top = (1e-12, None, None)
            G = g[idx].sum()
            sc = lambda a, n: max(abs(a) - p.l1, 0) ** 2 / (n + p.l2)       # noqa: E731
            for j in cols:
                b = bins[idx, j]
                for c in range(b.max()):
                    left = b <= c
                    n = int(left.sum())
                    if n < child or len(idx) - n < child:
                        continue
                    a = g[idx[left]].sum()
                    gain = sc(a, n) + sc(G - a, len(idx) - n) - sc(G, len(idx))
                    if gain > top[0] + 1e-9:
                        top = (gain, j, c)
            return top

        leaves = [(rows, np.arange(N), best(rows))]
        while len(leaves) < p.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][2][0] if leaves[i][2][1] is not None else -1)
            idx, every, (gain, j, c) = leaves[k]
            if j is None:
                break
            leaves.pop(k)
            for side in (lambda v: v <= c, lambda v: v > c):
                a, e = idx[side(bins[idx, j])], every[side(bins[every, j])]
                leaves.append((a, e, best(a)))
        step = np.zeros(N)
        for idx, every, _ in leaves:
            G = g[idx].sum()
            step[every] = -np.sign(G) * max(abs(G) - p.l1, 0) / (len(idx) + p.l2)
        pred = pred + p.rate * step
        trees.append(len(leaves))
        if stop.any():
            scores.append(np.mean((pred - y)[stop] ** 2))
            if len(scores) - 1 - int(np.argmin(scores)) >= p.patience:
                break
    return pred, trees, scores


def test_equal_to_a_plain_booster(spark, table, data):
    x, y, fold = data
    by = _hashes(spark, table)
    h = np.array([by[i] for i in range(N)], np.int64).view(np.uint64)
    a = B.Params(rounds=12, leaves=9, rate=0.3, max_bin=31, patience=50)
    b = B.Params(rounds=30, leaves=5, rate=0.9, max_bin=15, patience=3, subsample=1.0, colsample=0.5, min_child=20)
    jobs = [B.Job(0, a), B.Job(1, b), B.Job(2, a, 1), B.Job(B.ALL, B.Params(rounds=4, leaves=7, rate=0.5, max_bin=31,
                                                                            patience=None))]
    passes = []
    got = B.fit_models(table, FEATURES, ["y", "z"], "key", "fold", jobs, passes=passes)
    for job, m in zip(jobs, got):
        target = y if job.label == 0 else -y / 2
        pred, trees, scores = _plain(x, target, fold, job.fold, job.params, h, job.params.rounds)
        np.testing.assert_allclose(m.scores, scores, rtol=1e-7)
        assert m.grown == len(trees)
        assert [len(t.feature) // 2 + 1 for t in m.trees] == trees[:len(m.trees)]
        if not scores:
            np.testing.assert_allclose(m.predict(x), pred, rtol=1e-7, atol=1e-9)
        else:
            held = np.array(sorted(_stop_rows(fold, job.fold)))
            e = (m.predict(x) - target)[held]
            assert np.mean(e * e) == pytest.approx(min(scores[1:]), rel=1e-7)
    again = B.Boosted.from_dict(__import__("json").loads(__import__("json").dumps(got[0].to_dict())))
    np.testing.assert_array_equal(again.predict(x), got[0].predict(x))
    assert len(passes) < 150


def test_passes_do_not_grow_with_models(table):
    p = B.Params(rounds=3, leaves=6, rate=0.3, max_bin=15, patience=None, subsample=1.0, colsample=1.0)
    one, many = [], []
    B.fit_models(table, FEATURES, ["y"], "key", "fold", [B.Job(0, p)], passes=one)
    B.fit_models(table, FEATURES, ["y"], "key", "fold", [B.Job(f, p) for f in (0, 1, 2, B.ALL)], passes=many)
    assert len(many) <= len(one) + 4 and max(many) == 4


def test_forest_and_drawn_thresholds(table, data):
    x, y, fold = data
    p = B.Params(leaves=12, l1=0, l2=0, min_child=5, max_bin=31, colsample=0.75, extra_trees=True)
    jobs = B.forest(B.Job(0, p), 6)
    got = B.averaged(B.fit_models(table, FEATURES, ["y"], "key", "fold", jobs))
    same = B.averaged(B.fit_models(table, FEATURES, ["y"], "key", "fold", jobs))
    assert got.to_dict()["trees"] == same.to_dict()["trees"] and len(got.trees) == 6
    held = fold == 0
    r2 = 1 - np.sum((got.predict(x) - y)[held] ** 2) / np.sum((y[held] - y[held].mean()) ** 2)
    assert r2 > 0.5 and got.split_counts()["x.1"] > 0
    n = np.zeros((1, 10), np.int64)
    n[0, 3:8] = 10
    g = np.linspace(-1, 1, 10)[None] * n
    _, _, cut = B.best_split(g, n, [2], p, 5, "42|0|0")
    assert cut == 3 + B.number_of("42|0|0", 2) % 4


def test_nothing_to_split_on(spark):
    rows = [(str(i), i % 2, float(i % 3), 1.0, None) for i in range(12)]
    t = spark.createDataFrame(rows, "key string, fold int, y double, a double, b double")
    got = B.fit_models(t, ["a", "b"], ["y"], "key", "fold", [B.Job(0, B.Params(rounds=3))])[0]
    want = np.mean([r[2] for r in rows if r[1] != 0])
    np.testing.assert_allclose(got.predict(np.array([[1.0, np.nan], [5.0, 2.0]])), want)


def test_rows_of_asked_nodes_are_those_that_end_there():
    import numpy as np

    from foldwise.operators.boost import Tree
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 255, (4, 500)).astype(np.uint16)
    tree = Tree()
    for node, feature, cut in ((0, 1, 120), (2, 0, 60), (1, 3, 200), (4, 2, 90)):
        tree.split(node, feature, cut)
    rows = np.flatnonzero(rng.random(500) < 0.7)
    at = tree.nodes(bins)
    assert (tree.nodes(bins, rows) == at[rows]).all()
    leaves = [k for k, f in enumerate(tree.feature) if f < 0]
    for asked in ([0],) if tree.feature[0] < 0 else (leaves, leaves[:1], leaves[-2:][::-1]):
        for node, found in zip(asked, tree.rows_at(bins, rows, asked), strict=True):
            assert (found == rows[at[rows] == node]).all()


def test_state_is_made_only_for_rows_of_asked_nodes(monkeypatch):
    import numpy as np

    from foldwise.operators import boost
    rng = np.random.default_rng(4)
    n, d = 300, 3
    block = boost._Block(dict(
        n=n, h=rng.integers(-2**63, 2**63 - 1, n).tobytes(), fold=np.zeros(n, np.int32).tobytes(),
        stop=np.zeros(n, np.int64).tobytes(), y=rng.normal(size=n).tobytes(),
        bins=rng.integers(0, 16, (1, d, n)).astype(np.uint16).tobytes(), pred=rng.normal(size=(1, n)).tobytes()), d, 1, 1)
    tree, last = boost.Tree(), boost.Tree()
    a, b = tree.split(0, 1, 3)
    last.split(0, 0, 7)
    last.value = [0.0, 0.25, -0.5]
    q = dict(number=0, slot=0, size=16, view=0, fold=1, label=0, params=boost.Params(subsample=1.0), tree_number=1,
             start=0.5, rate=0.1, recent=[last], tree=tree, asked=[a], columns=[0, 2])
    seen, state = [], boost._Block.state
    monkeypatch.setattr(boost._Block, "state", lambda self, q, rows=None: seen.append(
        self.n if rows is None else len(rows)) or state(self, q, rows))
    held = {}
    boost._add(held, block, q, False)
    inside = block.bins[0][1] <= 3
    assert seen == [inside.sum()]
    residual = 0.5 + block.pred[0] + 0.1 * last.values(block.bins[0]) - block.y[0]
    for k, j in enumerate((0, 2)):
        want = np.bincount(block.bins[0][j][inside], residual[inside], 16)
        assert np.allclose(held[0][2][0, k], want) and held[0][3][0, k].sum() == inside.sum()
