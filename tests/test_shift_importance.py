"""Permutation importance by turning values round within blocks."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import post as P


def _brute(rows, feats, predict, blocks, repeats):
    number = {r["key"]: int(hashlib.md5(f"42|{r['key']}".encode()).hexdigest()[:13], 16) for r in rows}
    parts = {}
    for r in sorted(rows, key=lambda r: (number[r["key"]], r["key"])):
        parts.setdefault(number[r["key"]] % blocks, []).append(r)
    y = np.array([r["y"] for part in parts.values() for r in part])

    def r2(feature=None, w=0):
        pred = []
        for part in parts.values():
            for p, r in enumerate(part):
                values = {x: r[x] for x in feats}
                if feature:
                    values[feature] = part[(p + 1 + w % max(1, len(part) - 1)) % len(part)][feature]
                pred.append(predict(values))
        return 1 - ((y - np.array(pred)) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    base = r2()
    return {x: max(0.0, base - np.mean([r2(x, P.shift_of(x, k)) for k in range(repeats)])) for x in feats}


def test_equals_brute_force_and_shuffles_one_copy(spark):
    rng = np.random.default_rng(1)
    rows = [{"key": f"k{i}", "a.b": float(rng.normal()), "c": float(rng.normal()), "d": float(rng.normal())}
            for i in range(500)]
    for r in rows:
        r["y"] = 3 * r["a.b"] + r["c"] + 0.1 * float(rng.normal())
    df = spark.createDataFrame(rows)
    feats = ["a.b", "c", "d"]
    got = P.shift_importance(df, feats, "y", "key", lambda d: d.withColumn("pred", 3 * F.col("`a.b`") + F.col("c")),
                             block_rows=64)
    want = _brute(rows, feats, lambda v: 3 * v["a.b"] + v["c"], 8, P.PERM_REPEATS)
    found = {r["feature"]: r["importance"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-9 for x in want)
    assert found["a.b"] > found["c"] > found["d"] == 0.0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_every_value_is_given_once(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("key"), F.col("id").cast("double").alias("x"),
                                 F.lit(1.0).alias("y"))
    seen = {}

    def predict(d):
        seen["rows"] = d
        return d.withColumn("pred", F.lit(0.0))

    P.shift_importance(df, ["x"], "y", "key", predict, block_rows=50)
    pdf = seen["rows"].toPandas()
    for _, part in pdf.groupby(["_j", "_r"]):
        assert sorted(part["x"]) == [float(i) for i in range(300)]
    assert len(pdf) == 300 * (P.PERM_REPEATS + 1)


def test_one_row_no_rows_no_features(spark):
    one = spark.createDataFrame([("k", 1.0, 2.0)], "key string, x double, y double")
    add = lambda d: d.withColumn("pred", F.lit(0.0))
    assert [r["feature"] for r in P.shift_importance(one, ["x"], "y", "key", add).collect()] == ["x"]
    assert P.shift_importance(one.limit(0), ["x"], "y", "key", add).count() == 0
    assert P.shift_importance(one, [], "y", "key", add).count() == 0


def test_train_reports_importance_of_a_network(spark):
    from foldwise.plans.train import train
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a * 2 + 0.01 * b)) for a, b in rng.normal(size=(120, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = train(df, target="y", models=("mlp",), mlp_epochs=60)
    shares = got.plan.reports["importance"]
    assert shares[0][0] == "a" and shares[0][1] > 90 and len(shares) == 2
    assert got.candidates.first()["train_r2"] > 0.5
