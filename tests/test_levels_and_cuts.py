"""Distinct counts of many columns in one shuffle, early-stopping rows by a cut."""

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import cv
from foldwise.operators import encode as E
from foldwise.operators import select as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_of_texts(spark):
    long = "x" * 200
    rows = [("a", long + "1", None), ("b", long + "2", None), ("a", long + "1", None), ("", "x" * 64, None),
            (None, "x" * 65, None)] + [("a", long + "1", None)] * 30
    df = spark.createDataFrame(rows, "one string, `two.x` string, none string")
    got = S.distinct_counts(df, {"one": F.col("one"), "two.x": F.col("`two.x`"), "none": F.col("none")})
    assert {r["column"]: r["n"] for r in got.collect()} == {"one": 3, "two.x": 4}
    assert "Expand" not in _plan(got)
    assert S.distinct_counts(df.limit(0), {"one": F.col("one")}).count() == 0


def test_distinct_counts_of_numbers(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-0.0, 2.0), (float("nan"), None), (float("nan"), 1.0)],
                               "a double, b double")
    got = S.distinct_counts(df, {x: F.col(x) for x in df.columns})
    assert {r["column"]: r["n"] for r in got.collect()} == {"a": 2, "b": 2}


def test_triage_counts_levels_where_the_rates_leave_it_open(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-{i % 9 + 1:02d}", "ab"[i % 2], i % 3 == 0, float(i))
                                for i in range(40)], "n string, d string, c string, b boolean, y double")
    whole = {r["column"]: r.asDict() for r in S.triage_columns(df, "y").collect()}
    lazy = {r["column"]: r.asDict() for r in S.triage_columns(df, "y", every_level=False).collect()}
    assert {x: r["n_levels"] for x, r in whole.items()} == {"n": 40, "d": 9, "c": 2, "b": 2}
    assert {x: r["n_levels"] for x, r in lazy.items()} == {"n": None, "d": None, "c": 2, "b": 2}
    assert {x: r["decision"] for x, r in whole.items()} == {x: r["decision"] for x, r in lazy.items()} == \
        {"n": "numeric", "d": "datetime", "c": "onehot", "b": "onehot"}


def test_composite_key_rules_columns_out_first(spark):
    df = spark.createDataFrame([(i % 4, i % 3, i / 7, 5, None, float("nan")) for i in range(120)],
                               "a int, b int, c double, same int, none int, nan double")
    assert E.detect_composite_key(df, df.columns)[1:] == (["a", "b"], 12)
    assert E.detect_composite_key(df, ["c", "same", "none", "nan"]) is None


def test_stop_rows_by_a_cut(spark):
    rows = [(f"k{i}", i % 5) for i in range(237)]
    df = spark.createDataFrame(rows, "key string, fold int").repartition(7)
    got = cv.es_holdout(df, "key", "fold", 5)
    text = _plan(got)
    assert "Join" not in text and "Window" not in text and text.count("Exchange") <= 1
    held = got.toPandas()
    for f in range(5):
        part = held[held["train_fold"] == f]
        assert len(part) == sum(x != f for _, x in rows) and not (part["fold"] == f).any()
        order = sorted(part["key"], key=lambda k: __import__("hashlib").md5(
            f"{cv.ES_SPLIT_SEED + f}|{k}".encode()).hexdigest())
        n = max(1, round(len(part) * 0.1))
        assert set(part.loc[part["es_val"], "key"]) == set(order[:n])


def test_stop_rows_of_repeated_keys_and_small_tables(spark):
    df = spark.createDataFrame([("same", i % 2) for i in range(60)] + [(f"k{i}", i % 2) for i in range(60)],
                               "key string, fold int")
    held = cv.es_holdout(df, "key", "fold", 2).toPandas()
    same = held[held["key"] == "same"].groupby("train_fold")["es_val"].nunique()
    assert (same == 1).all()                             # rows of one key stay together
    few = spark.createDataFrame([(f"k{i}", i % 2) for i in range(20)], "key string, fold int")
    assert not cv.es_holdout(few, "key", "fold", 2).toPandas()["es_val"].any()
    assert np.array_equal(sorted(cv.es_holdout(few, "key", "fold", 2).columns), ["es_val", "fold", "key", "train_fold"])
