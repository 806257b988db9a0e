"""Models that fit a task are grown there, as the passes would grow them."""

from dataclasses import replace

import numpy as np
import pytest

from foldwise.operators import boost as B

N, D = 900, 3
FEATURES = [f"x{j}" for j in range(D)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=N), rng.integers(0, 6, N), rng.random(N)])
    y = 2 * x[:, 0] + (x[:, 1] - 3) ** 2 + rng.normal(size=N) * 0.2
    rows = [(f"k{i % 850}", int(i % 3), float(y[i]), None if i % 7 == 0 else float(-y[i]),
             None if i % 13 == 0 else float(x[i, 0]), *map(float, x[i, 1:])) for i in range(N)]
    return spark.createDataFrame(rows, "key string, fold int, y double, z double, x0 double, x1 double, x2 double").cache()


def _jobs():
    p = B.Params(rounds=9, leaves=12, rate=0.3, max_bin=31, patience=4, min_child=8)
    return [B.Job(0, p), B.Job(1, replace(p, max_bin=300, patience=2, rate=0.9)), B.Job(2, p, 1),
            B.Job(B.ALL, replace(p, patience=None), 0, follows=True),
            *B.forest(B.Job(0, replace(p, l1=0.0, l2=0.0, extra_trees=True)), 5)]


@pytest.mark.parametrize("own", [False, True])
def test_equal_to_passes(monkeypatch, table, own):
    jobs = [j for j in _jobs() if not (own and j.fold == B.ALL)]
    monkeypatch.setattr(B, "BLOCK_ROWS", 200)
    alone = B.fit_models(table, FEATURES, ["y", "z"], "key", "fold", jobs, own=own)
    monkeypatch.setattr(B, "TASK_BYTES", 0)
    passes = []
    shared = B.fit_models(table, FEATURES, ["y", "z"], "key", "fold", jobs, passes=passes, own=own)
    assert len(passes) > 9
    for a, b in zip(alone, shared, strict=True):
        assert len(a.trees) == len(b.trees)
        for t, u in zip(a.trees, b.trees):
            assert (t.feature, t.cut, t.left) == (u.feature, u.cut, u.left)
            np.testing.assert_allclose(t.value, u.value, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(a.scores, b.scores, rtol=1e-9)


def test_jobs_do_not_follow_rounds(spark, table):
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        B.fit_models(table, FEATURES, ["y"], "key", "fold", [B.Job(0, B.Params(rounds=rounds, patience=None))])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))
    assert jobs(2) == jobs(12)


def test_rows_are_spread_over_tasks():
    p = B.Params(rounds=1, averaged=True)
    growing = [B._Growth(i, B.Job(i % 2, p), -1, i % 2, 8, 100, 0.0, 2) for i in range(40)]
    growing.append(B._Growth(40, B.Job(0, B.Params(rounds=7)), -1, 0, 8, 100, 0.0, 2))
    turns = B._dealt(growing, 4)
    assert [g.number for g in turns[0]] == [40]
    assert sorted(g.number for t in turns for g in t) == list(range(41))
    assert all(len({g.view for g in t}) == 1 for t in turns) and 8 <= len(turns) - 1 <= 10


def test_written_blocks_are_read_a_few_at_a_time(spark):
    import glob

    import pyarrow.parquet as pq
    made = spark.createDataFrame([(i, np.random.default_rng(i).bytes(1_000_000)) for i in range(40)],
                                 "id int, v binary").coalesce(1)
    back = B._written(made)
    files = glob.glob(back.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] + "/*.parquet")
    groups = [m.row_group(i) for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and max(g.num_rows for g in groups) <= 10
    assert back.selectExpr("sum(length(v)) as n").first()["n"] == 40 * 1_000_000
