"""Registered queries ask the operators for the library's own rounds, trees and
epochs."""

import datetime

import pytest

import __spark_entry__ as E
from foldwise.operators import mlp as M
from foldwise.operators import trees as R


class Asked(Exception):
    """What an operator was asked for."""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(2024, 1, 1)
    line = [(i // 3, i % 40, i % 7, i % 3 + 1, float(i % 50 + 1), 900.0 + 7.5 * (i * 37 % 400), i % 11 / 100.0,
             i % 9 / 100.0, "ANR"[i % 3], "FO"[i % 2], day + datetime.timedelta(days=i % 300)) for i in range(90)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def _epochs(monkeypatch, spark, tables, name):
    def stop(rows, models, counts, trains, names, alphas, max_epochs):
        raise Asked(max_epochs)
    monkeypatch.setattr(M, "_train", stop)
    with pytest.raises(Asked) as got:
        E.queries()[name](spark, tables)
    return got.value.args[0]


def test_mlp_oof(monkeypatch, spark, tables):
    assert _epochs(monkeypatch, spark, tables, "mlp_oof") == 600


def test_mlp_search(monkeypatch, spark, tables):
    assert _epochs(monkeypatch, spark, tables, "mlp_search") == 1500


def _asked(monkeypatch, spark, tables, name, operator, which):
    """What ``name`` asks of a tree operator: its arguments by ``which``."""
    def stop(*args, **kw):
        raise Asked(which(args, kw))
    monkeypatch.setattr(R, operator, stop)
    with pytest.raises(Asked) as got:
        E.queries()[name](spark, tables)
    return got.value.args[0]


def test_forest_oof(monkeypatch, spark, tables):
    jobs = _asked(monkeypatch, spark, tables, "forest_oof", "fit_jobs", lambda args, kw: args[5])
    assert [(kind, p["n_estimators"]) for _, p, kind, _ in jobs] == [("rf", 300)] * 5 + [("xt", 300)] * 5


def test_engineered_features(monkeypatch, spark, tables):
    p = _asked(monkeypatch, spark, tables, "engineered_features", "fit_all", lambda args, kw: args[3])
    assert p == R.FE_PARAMS and p["n_estimators"] == 200


def test_screen_features(monkeypatch, spark, tables):
    p = _asked(monkeypatch, spark, tables, "screen_features", "fit_all", lambda args, kw: args[3])
    assert p == R.SCREEN_PARAMS and p["n_estimators"] == 200


def test_halving(monkeypatch, spark, tables):
    cands = _asked(monkeypatch, spark, tables, "halving", "halving", lambda args, kw: args[6])
    assert cands == R.search_candidates() and {c["n_estimators"] for c in cands} == {3000}


@pytest.mark.parametrize("name", ["train_quick", "train_predict", "train_thorough"])
def test_train(monkeypatch, spark, tables, name):
    from foldwise.catalog import training

    def stop(df, **kw):
        raise Asked(kw)
    monkeypatch.setattr(training, "train", stop)
    monkeypatch.setattr(training, "load", lambda spark, sf, t: spark.createDataFrame(
        [(1, 2, 3.0)], "s_nationkey int, s_suppkey int, s_acctbal double") if t == "supplier" else
        spark.read.parquet(f"{tables}/lineitem.parquet"))
    with pytest.raises(Asked) as got:
        E.queries()[name](spark, tables)
    assert "tree_rounds" not in got.value.args[0] and "mlp_epochs" not in got.value.args[0]
