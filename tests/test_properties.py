"""Property tests for operators without an SQL oracle: distributed ranks vs
plain windows, Gram ridge vs NumPy refits, NNLS optimality, lambda search vs
golden section, plan round trip."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL


def test_hash_rank_equals_row_number(spark):
    from foldwise.functions.keys import hash_rank, md5_order
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"),
                                  (F.col("id") % 7).alias("g"))
    a = hash_rank(df, "k", 42, partition_cols=["g"], out="rn").select("k", "rn", "rn_n")
    w = Window.partitionBy("g").orderBy(md5_order("k", 42), "k")
    b = df.select("k", (F.row_number().over(w) - 1).alias("rn2"),
                  F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n2"))
    bad = a.join(b, "k").filter((F.col("rn") != F.col("rn2")) | (F.col("rn_n") != F.col("n2")))
    assert bad.count() == 0


def test_kfold_ntile_semantics(spark):
    from foldwise.functions.keys import md5_order
    from foldwise.operators.cv import kfold
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"))
    a = kfold(df, "k", 5)
    b = df.select("k", (F.ntile(5).over(Window.orderBy(md5_order("k", 42), "k")) - 1).alias("f2"))
    assert a.join(b, "k").filter(F.col("fold") != F.col("f2")).count() == 0


def test_value_rank_with_hot_value(spark):
    from foldwise.operators.profile import value_rank
    # a third of the rows share one value
    df = spark.range(30000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.rand(7) * 10).alias("v"))
    r = value_rank(df, "v", "k", 30000)
    h = F.md5(F.concat(F.lit("42|"), F.col("k")))
    b = df.select("k", (F.row_number().over(Window.orderBy("v", h, "k")) - 1).alias("r2"))
    assert r.join(b, "k").filter(F.col("_rank") != F.col("r2")).count() == 0


def test_ridge_oof_matches_numpy_refit_with_nulls(spark):
    from foldwise.catalog.fixtures import injected_nulls
    from foldwise.operators.cv import assign_folds
    from foldwise.operators.linear import ridge_cv
    df = injected_nulls(spark, SF_SMALL)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    folded, plan = assign_folds(df, "y", "key", 5)
    folded = folded.cache()
    res = ridge_cv(folded, feats, "y", "key", "fold", k=plan.n_folds)
    pdf = folded.toPandas()
    oof = res.oof.toPandas().set_index("key")
    X = pdf[feats].values.astype(float)
    yv = pdf["y"].values
    for f in range(plan.n_folds):
        tr = pdf["fold"].values != f
        va = ~tr
        med = np.nanmedian(X[tr], 0)
        Xt = np.where(np.isnan(X[tr]), med, X[tr])
        Xv = np.where(np.isnan(X[va]), med, X[va])
        c = np.median(Xt, 0)
        s = np.maximum(np.percentile(Xt, 75, 0) - np.percentile(Xt, 25, 0), 1e-8)
        Z, Zv = (Xt - c) / s, (Xv - c) / s
        mu, my = Z.mean(0), yv[tr].mean()
        a = res.fold_fits[f].alpha
        b = np.linalg.solve((Z - mu).T @ (Z - mu) + a * np.eye(len(feats)),
                            (Z - mu).T @ (yv[tr] - my))
        pred = Zv @ b + (my - mu @ b)
        got = oof.loc[pdf["key"].values[va], "pred"].values
        assert np.allclose(pred, got, rtol=1e-7, atol=1e-6)
    assert res.train_r2 > 0.9


def test_nnls_kkt():
    from foldwise.operators.blend import nnls_gram
    rng = np.random.default_rng(0)
    A = rng.normal(size=(200, 5))
    b = A @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + rng.normal(size=200)
    x = nnls_gram(A.T @ A, A.T @ b)
    g = A.T @ (b - A @ x)
    assert (x >= 0).all()
    assert np.all(g[x <= 1e-12] <= 1e-6)
    assert np.allclose(g[x > 1e-12], 0, atol=1e-6)


def test_yeo_johnson_lambda_vs_golden_section(spark):
    from foldwise.functions.expr import yeo_johnson
    from foldwise.operators.stats import yeo_johnson_lambda
    from foldwise.session import load
    ev = load(spark, SF_SMALL, "events")
    lam = yeo_johnson_lambda(ev, "value")
    x = np.array([r[0] for r in ev.select("value").collect()])

    def yj(x, l):
        pos = np.log1p(x) if abs(l) < 1e-6 else ((x + 1) ** l - 1) / l
        return np.where(x >= 0, pos, 0)

    def nll(l):
        v = yj(x, l).var()
        return 1e10 if v < 1e-12 else 0.5 * len(x) * np.log(v) - (l - 1) * np.sum(
            np.sign(x) * np.log1p(np.abs(x)))
    a, b = -5.0, 5.0
    g = (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(200):
        if nll(c) < nll(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
        if abs(b - a) < 1e-9:
            break
    assert abs(lam - (a + b) / 2) < 1e-3
    _ = yeo_johnson


def test_target_encode_oof_never_sees_own_fold(spark):
    import __spark_entry__ as E
    from foldwise.operators.cv import assign_folds
    from foldwise.session import load
    out = E.queries()["target_encode_oof"](spark, SF_CHECK).toPandas()
    p = load(spark, SF_CHECK, "part").select(F.col("p_partkey").alias("key"), "p_name",
                                             F.col("p_retailprice").alias("y"))
    f, _ = assign_folds(p, "y", "key", 5)
    pdf = f.toPandas()
    got = out.set_index("p_partkey")["p_name_te"]
    for k in range(5):
        tr = pdf[pdf.fold != k]
        g = tr.y.mean()
        st = tr.groupby("p_name").y.agg(["count", "mean"])
        enc = (st["count"] * st["mean"] + 20 * g) / (st["count"] + 20)
        va = pdf[pdf.fold == k]
        exp = va.p_name.map(enc).fillna(g).values
        assert np.allclose(got.loc[va.key.values].values, exp, atol=2e-6)


def test_plan_round_trip(spark):
    import __spark_entry__ as E
    r = E.queries()["plan_save_load"](spark, SF_SMALL).first()
    assert r["n_rows"] > 0 and r["max_abs_diff"] == 0.0


@pytest.mark.parametrize("q", ["composite_key_detect", "duplicate_columns_walk"])
def test_decisions(spark, q):
    import __spark_entry__ as E
    rows = {tuple(r) for r in E.queries()[q](spark, SF_CHECK).collect()}
    if q == "composite_key_detect":
        assert ("customer", "__numkey__c_nationkey", 25) in rows
        assert ("lineitem", None, None) in rows
    else:
        kept = {r[0]: r[1] for r in rows}
        assert kept["l_quantity"] and not kept["q2"] and not kept["big_b"]


def test_mlp_matches_numpy_full_batch(spark):
    from foldwise.catalog.fixtures import net_charge
    from foldwise.operators import mlp as M
    from foldwise.operators.cv import assign_folds
    df = net_charge(spark, SF_SMALL)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    f, plan = assign_folds(df, "y", "key", 5)
    f = f.cache()
    models = M.mlp_fit_folds(f, feats, "y", "fold", 5, max_epochs=5)
    pdf = f.toPandas()
    X, yv = pdf[feats].values.astype(float), pdf["y"].values
    m = models[-1]                      # final model: all rows
    Z = (X - np.array(m.x_mean)) / np.array(m.x_std)
    v = (yv - m.y_mean) / m.y_std
    # one hidden layer, written out: p = max(0, Z A + a) B + b
    d, h, _ = m.sizes
    A, B = (w.copy() for w in M.Network(m.sizes, M.Network.start(m.sizes)).layers)
    parts = [A[:d], A[d], B[:h, 0], B[h]]
    ms, vs = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for ep in range(1, 6):
        hidden = Z @ parts[0] + parts[1]
        on = hidden > 0
        miss = 2.0 / len(v) * ((hidden * on) @ parts[2] + parts[3] - v)
        through = np.outer(miss, parts[2]) * on
        grads = [Z.T @ through + 1e-4 / len(v) * parts[0], through.sum(0),
                 (hidden * on).T @ miss + 1e-4 / len(v) * parts[2], np.array([miss.sum()])]
        for i, g in enumerate(grads):
            ms[i] = 0.9 * ms[i] + 0.1 * g
            vs[i] = 0.999 * vs[i] + 0.001 * g * g
            parts[i] = parts[i] - 0.01 * (ms[i] / (1 - 0.9 ** ep)) / (
                np.sqrt(vs[i] / (1 - 0.999 ** ep)) + 1e-8)
    th = np.concatenate([parts[0].ravel(), parts[1], parts[2], parts[3]])
    assert np.allclose(th, np.asarray(m.params), rtol=1e-6, atol=1e-9)
    assert np.allclose(m.x_mean, X.mean(0)) and np.allclose(m.x_std, X.std(0))
    one = f.filter("fold <> 2").toPandas()[feats].values.astype(float)
    assert np.allclose(models[2].x_mean, one.mean(0)) and np.allclose(models[2].x_std, one.std(0))


def test_select_position_refines_and_handles_hot_value(spark):
    from foldwise.operators.profile import select_position
    df = spark.range(30000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.rand(11) * 10).alias("v")).cache()
    h = F.md5(F.concat(F.lit("42|"), F.col("k")))
    ranked = df.select("k", (F.row_number().over(Window.orderBy("v", h, "k")) - 1).alias("r"))
    truth = {r["r"]: r["k"] for r in ranked.filter(F.col("r").isin(3, 14999, 15000, 29990))
             .collect()}
    for pos, k in truth.items():
        got = select_position(df, "v", "k", pos, 30000, max_bucket_rows=500, buckets=20).collect()
        assert [r["k"] for r in got] == [k]


def _timed(spark, copies=1):
    """A linear function of a time (with fractions of a second) and a number."""
    return spark.range(120).select(
        F.expr("timestamp_millis(1600000000123 + id * 7200457)").alias("at"),
        (F.col("id") % 11).cast("double").alias("x"),
        F.lit(5.0).alias("same")).withColumn(
        "y", F.hour("at") * 3.0 + F.col("x")).withColumn(
        "_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")


def test_time_column_is_scored_as_trained_and_dropped_column_not_asked_for(spark):
    from foldwise.plans.train import predict, train
    df = _timed(spark)
    plan = train(df, "y", models=("ridge",)).plan
    assert plan.timestamps == ["at"] and "same" not in plan.required_columns()
    r = predict(plan, df.withColumnRenamed("y", "truth").withColumn("y", F.lit(0.0))).agg(
        F.corr("truth", "y").alias("r")).first()["r"]
    assert r > 0.99
    assert plan.encode(df.drop("same"))[1] == []


def test_repeated_rows_train_once_each(spark):
    from foldwise.plans.train import train
    r = train(_timed(spark, copies=3), "y", models=("ridge",))
    assert r.plan.reports["n_rows"] == 360
    keys = r.oof.select("_key")
    assert keys.count() == keys.distinct().count()


def test_saved_tree_plan_carries_its_model_folders(spark, tmp_path):
    import shutil
    from foldwise.plans.fitted import FittedPlan
    from foldwise.plans.train import train
    df = _timed(spark)
    plan = train(df, "y", models=("gbt",), work_dir=str(tmp_path / "work")).plan
    plan.save(spark, str(tmp_path / "plan"))
    want = sorted(r["y"] for r in plan.score(df).select("y").collect())
    shutil.move(str(tmp_path / "work"), str(tmp_path / "gone"))
    got = FittedPlan.load(spark, str(tmp_path / "plan")).score(df)
    assert sorted(r["y"] for r in got.select("y").collect()) == want


def test_lineage_is_recorded_not_parsed():
    from foldwise.operators.post import lineage_rows
    made = {"ab": ["a", "b"], "sq": ["ab", "ab"], "abb": ["ab", "b"], "odd": ["nowhere"]}
    got = lineage_rows(["a", "sq", "abb", "odd", "a^2"], ["a", "b"], made)
    assert got == [("a", "a", 1.0), ("sq", "a", 0.5), ("sq", "b", 0.5),
                   ("abb", "a", 1 / 3), ("abb", "b", 2 / 3)]


def test_train_quick_end_to_end(spark):
    from foldwise.plans.train import predict, train
    from foldwise.session import load
    c = load(spark, SF_SMALL, "customer")
    r = train(c, target="c_acctbal", mode="quick", models=("ridge",))
    names = {row["name"] for row in r.candidates.collect()}
    assert "ridge" in names
    scored = predict(r.plan, c)
    assert scored.columns == c.columns
    assert scored.count() == c.count()


def test_arrow_gram_equals_sql_gram(spark):
    from foldwise.catalog.fixtures import injected_nulls
    from foldwise.operators import stats as A
    from foldwise.operators.cv import assign_folds
    df = injected_nulls(spark, SF_SMALL)
    f, _ = assign_folds(df, "y", "key", 5)
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "y"]
    g1 = A.gram_blocks(f, names, by=["fold", "ifold"])
    g2 = A.arrow_gram_blocks(f, names, by=["fold", "ifold"])
    assert set(g1) == set(g2)
    for k in g1:
        assert np.allclose(g1[k], g2[k], rtol=1e-10)


def test_csv_ingest_fx16(spark):
    import tempfile
    from foldwise.operators.select import DataError
    from foldwise.sources.csv import read_table
    d = tempfile.mkdtemp(prefix="fx16-", dir="/tmp")
    open(f"{d}/bom.csv", "wb").write("﻿a,b\n1,NA\n2,x\n".encode("utf-8"))
    open(f"{d}/sj.csv", "wb").write(" 面積 ,家賃\n10,5.5\n".encode("cp932"))
    open(f"{d}/dup.csv", "wb").write(" a,a\n1,2\n".encode("utf-8"))
    open(f"{d}/empty.csv", "wb").write(b"")
    a = read_table(spark, f"{d}/bom.csv")
    assert a.columns == ["a", "b"] and [r["b"] for r in a.orderBy("a").collect()] == [None, "x"]
    b = read_table(spark, f"{d}/sj.csv")
    assert b.columns == ["面積", "家賃"] and b.first()["家賃"] == "5.5"
    for name, key in (("dup", "duplicate_headers"), ("empty", "empty_file")):
        with pytest.raises(DataError) as e:
            read_table(spark, f"{d}/{name}.csv")
        assert e.value.key == key


def test_datetime_valid_equals_full_parser(spark):
    from foldwise.catalog.fixtures import date_text
    from foldwise.functions.expr import datetime_parts, datetime_valid
    extra = ["2024-01-0510:30", "2024/02/29 23:59:99", "2024-02-30", "2024-00-10", "2024-11-31",
             "2024-12-31T24:00", "2024-12-31 23:60", "0000-01-01", "2024-1-05", " 2024-06-30 ",
             "2024-06-30 7:05", "20240630", "", None, "2024-06-30T", "9999-12-31 23:59"]
    df = date_text(spark, SF_SMALL).select("txt").unionByName(
        spark.createDataFrame([(v,) for v in extra], "txt string"))
    bad = df.filter(datetime_valid("txt") != datetime_parts("txt").isNotNull())
    assert bad.count() == 0


def test_csv_quotes_and_line_ends_in_cells(spark, tmp_path):
    from foldwise.sources.csv import read_table
    path = tmp_path / "quoted.csv"
    path.write_text('a,b\n"x ""q"" y",1\n"two\nlines",2\nplain,3\n')
    got = {r["b"]: r["a"] for r in read_table(spark, str(path)).collect()}
    assert got == {"1": 'x "q" y', "2": "two\nlines", "3": "plain"}
    path = tmp_path / "plain.csv"
    path.write_text('a,b\n"x ""q"", y",1\n')
    assert read_table(spark, str(path)).collect()[0]["a"] == 'x "q", y'


def test_train_takes_ordinary_names(spark):
    from foldwise.plans.train import predict, train
    city = F.element_at(F.array(*[F.lit(v) for v in ("St. Louis", "Rome", "O'Fallon")]), F.expr("cast(id % 3 + 1 as int)"))
    df = spark.range(90).select(city.alias("o'city"), F.rand(3).alias("a.b"),
                                F.col("id").cast("string").alias("id no.")).withColumn(
        "y v", F.col("`a.b`") * 2 + F.length("o'city"))
    r = train(df, "y v", models=("ridge", "gbt"))
    assert predict(r.plan, df).select("y v").where("`y v` is not null").count() == 90
    assert r.plan.required_columns() == ["o'city", "a.b", "id no."]


def test_seed_positions_with_hot_values(spark):
    from foldwise.operators.profile import edges_below, select_position
    base = spark.range(9000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.rand(7) * 10).alias("v")).cache()
    h = F.md5(F.concat(F.lit("42|"), F.col("k")))
    rank = {r.r: r.k for r in base.select("k", (F.row_number().over(Window.orderBy("v", h, "k")) - 1).alias("r")).collect()}
    for pos in (0, 899, 4500, 8998, 8999):
        # quantiles drawn in tightly, so that positions beside them are met too
        for buckets in (50, 10**9):
            got = select_position(base, "v", "k", pos, 9000, max_bucket_rows=50, buckets=buckets)
            assert [r.k for r in got.collect()] == [rank[pos]]
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "lambdafunction" not in plan          # a row is not held against every edge
    edges = [0.5, 2.0, 2.5, 7.0, 9.0]
    off = base.where(edges_below(edges, "v") != sum((F.col("v") > e).cast("int") for e in edges))
    assert off.count() == 0
