"""Exact quantiles from additive counts against NumPy."""

import numpy as np
import pytest

from foldwise.operators import stats as A
from foldwise.operators.quantiles import ALL, quantiles_of, to_keys, to_values

PROBS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2400)
    x[:900] = 0.0                                    # one value holds a third of the rows
    x[900:905] = [1e300, -1e-300, -0.0, 5e-324, -1e300]
    return x, rng.integers(0, 3, 2400).astype(float), rng.integers(0, 4, 2400)


@pytest.fixture(scope="module")
def table(spark, values):
    x, z, f = values
    rows = [(int(c), float(a) if i % 7 else None, float(b), None) for i, (a, b, c) in enumerate(zip(x, z, f))]
    return spark.createDataFrame(rows, "fold int, x double, `a.b` double, w double").repartition(5)


def test_keys_keep_the_order():
    v = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 2.0, np.inf, np.nan])
    k = to_keys(v)
    assert (np.diff(k) > 0).all() and to_keys(np.array([-0.0]))[0] == to_keys(np.array([0.0]))[0]
    np.testing.assert_array_equal(to_values(k), v)


@pytest.mark.parametrize("limits", [{}, {"last_rows": 0, "buckets": 48}])
def test_rest_of_a_fold(table, values, limits):
    x, z, f = values
    x = np.where(np.arange(len(x)) % 7, x, np.nan)
    got = quantiles_of(table, ["x", "a.b", "w"], PROBS, "fold", True, fills={0: {"x": (0.37, 50)}}, **limits)
    assert set(got) == {0, 1, 2, 3, ALL}
    for m, per in got.items():
        v = x[(f != m) & ~np.isnan(x)]
        np.testing.assert_allclose(per["x"], np.quantile(np.r_[v, [0.37] * 50] if m == 0 else v, PROBS), rtol=1e-12)
        np.testing.assert_allclose(per["a.b"], np.quantile(z[f != m], PROBS))
        assert per["w"] is None


def test_groups_and_no_rows(table, values):
    x, z, f = values
    got = quantiles_of(table, ["a.b"], PROBS, "fold")
    assert {m: per["a.b"] for m, per in got.items()} == {m: list(np.quantile(z[f == m], PROBS)) for m in range(4)}
    assert quantiles_of(table.limit(0), ["x"], [0.5]) == {ALL: {"x": None}}
    assert quantiles_of(table.limit(0), ["x"], [0.5], "fold", True) == {ALL: {"x": None}}


def test_filled_quantiles(table, values):
    x, _, f = values
    x = np.where(np.arange(len(x)) % 7, x, np.nan)
    for group, rest in ((None, False), ("fold", True), ("fold", False)):
        fills, got = A.filled_quantiles(table, ["x", "a.b", "w"], [0.25, 0.5, 0.75], group, rest)
        for m in got:
            v = x if m == ALL else x[f != m] if rest else x[f == m]
            med = np.nanmedian(v)
            assert fills[m]["x"] == pytest.approx(med) and fills[m]["w"] == 0.0
            np.testing.assert_allclose(got[m]["x"], np.quantile(np.where(np.isnan(v), med, v), [0.25, 0.5, 0.75]),
                                       rtol=1e-12)
            assert got[m]["w"] == [0.0] * 3


def test_no_percentile_in_the_library():
    import pathlib

    import foldwise
    for path in pathlib.Path(foldwise.__file__).parent.rglob("*.py"):
        assert "F.percentile(" not in path.read_text() and "percentile(x" not in path.read_text(), path
