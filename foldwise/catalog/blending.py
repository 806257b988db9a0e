"""Queries: blending, model choice and run reports (B1-B6, J8, D8-D11) on
FX13: three out-of-fold style prediction columns derived from the lineitem
net charge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r2_words, r6
from ..operators import blend as B
from ..operators import stats as A
from ..operators.cv import assign_folds
from ..operators.select import hash_sample
from . import register
from .fixtures import NET_CHARGE_SQL, NET_FEATURES, folds_sql, net_charge, sig_sql


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


MODELS = ["m1", "m2", "m3"]
FX13_SQL = (f"SELECT *, y * 0.9 + 100 AS m1, y * 1.1 - 50 AS m2, avg(y) OVER () AS m3 "
            f"FROM ({NET_CHARGE_SQL})")


def fx13(spark: SparkSession, sf: str) -> DataFrame:
    df = net_charge(spark, sf)
    ybar = df.agg(F.avg("y")).first()[0]        # a literal, not a lazy aggregate
    return df.withColumns({"m1": F.col("y") * 0.9 + 100, "m2": F.col("y") * 1.1 - 50,
                           "m3": F.lit(ybar)})


def _stats(spark, sf):
    w = fx13(spark, sf)
    return w, B.blend_stats(w, "y", MODELS)


@register("blend_gram", f"""
WITH t AS ({FX13_SQL})
SELECT CAST(count(*) AS BIGINT) AS n, {sig_sql("sum(y)")} AS sy, {sig_sql("sum(y * y)")} AS syy,
  {", ".join(f"{sig_sql(f'sum({a} * y)')} AS py_{a}" for a in MODELS)},
  {", ".join(f"{sig_sql(f'sum({a} * {b})')} AS pp_{a}_{b}"
             for i, a in enumerate(MODELS) for b in MODELS[i:])}
FROM t""")
def blend_gram(spark: SparkSession, sf: str) -> DataFrame:
    """B2 inputs: P'P, P'y, sum y, sum y^2 from one aggregate."""
    from ..functions.expr import round_sig
    _, st = _stats(spark, sf)
    row = {"n": int(st["n"]), "sy": st["sy"], "syy": st["syy"]}
    for i, a in enumerate(MODELS):
        row[f"py_{a}"] = float(st["py"][i])
        for j in range(i, len(MODELS)):
            row[f"pp_{a}_{MODELS[j]}"] = float(st["pp"][i, j])
    cols = list(row)
    df = spark.createDataFrame([tuple(row[c] for c in cols)],
                               ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in cols))
    return df.select("n", *[round_sig(c, 10).alias(c) for c in cols if c != "n"])


@register("blend_inputs", f"""
WITH t AS ({FX13_SQL}),
r AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS model, 1 - sum((y - {m}) ^ 2) / (var_pop(y) * count(*)) AS r2, "
    f"count(CASE WHEN isfinite({m}) THEN 1 END) = count(*) AS all_finite FROM t" for m in MODELS)})
SELECT model, {R("r2")} AS r2, all_finite, all_finite AND r2 >= 0.3 AS eligible FROM r""")
def blend_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """B1: members need finite OOF predictions for all rows and R^2 >= 0.3."""
    _, st = _stats(spark, sf)
    el = set(B.eligible_members(st, MODELS))
    rows = [(m, float(st["r2"][i]), bool(st["finite"][i]), m in el) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "model string, r2 double, all_finite boolean, "
                                       "eligible boolean").select(
        "model", r6("r2").alias("r2"), "all_finite", "eligible")


# FX13's eligible members are affine in y, so the non-negative least-squares
# weights equal the unconstrained 2 x 2 solution (both positive) and the
# blend is exact; the oracle solves the normal equations by Cramer's rule
BLEND_WEIGHTS_SQL = f"""
WITH t AS ({FX13_SQL}),
g AS (SELECT sum(m1 * m1) AS a11, sum(m1 * m2) AS a12, sum(m2 * m2) AS a22,
             sum(m1 * y) AS c1, sum(m2 * y) AS c2, sum(y * y) AS yy,
             var_pop(y) * count(*) AS sst FROM t),
w AS (SELECT (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS w1,
             (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS w2, * FROM g),
r AS (SELECT w1, w2, 1 - (yy - 2 * (w1 * c1 + w2 * c2) + w1 * w1 * a11
                          + 2 * w1 * w2 * a12 + w2 * w2 * a22) / sst AS r2 FROM w)
SELECT 'm1' AS model, {R("w1")} AS weight, 'nnls' AS method, {R("r2")} AS r2 FROM r
UNION ALL SELECT 'm2', {R("w2")}, 'nnls', {R("r2")} FROM r"""


@register("blend_weights", BLEND_WEIGHTS_SQL)
def blend_weights(spark: SparkSession, sf: str) -> DataFrame:
    """NNLS weights from the OOF Gram (active set), the R^2-share
    fallback and the signed-ridge stack when it wins by > 0.01; tests also
    verify the NNLS optimality conditions."""
    _, st = _stats(spark, sf)
    bl = B.fit_blend(st, MODELS, B.eligible_members(st, MODELS))
    df = spark.createDataFrame([(m, float(w), bl.method, float(bl.r2))
                                for m, w in zip(bl.members, bl.weights)],
                               "model string, weight double, method string, r2 double")
    return df.select("model", r6("weight").alias("weight"), "method", r6("r2").alias("r2"))


def _share_sql() -> str:
    """R^2-share weights over eligible members, as SQL."""
    return f"""r AS ({" UNION ALL ".join(
        f"SELECT '{m}' AS model, 1 - sum((y - {m}) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM t"
        for m in MODELS)}),
e AS (SELECT model, greatest(r2, 1e-6) AS w0 FROM r WHERE r2 >= 0.3),
w AS (SELECT model, w0 / sum(w0) OVER () AS w FROM e)"""


@register("blend_predict", f"""
WITH t AS ({FX13_SQL}), {_share_sql()}
SELECT key, {R(" + ".join(f"coalesce((SELECT w FROM w WHERE model = '{m}'), 0) * {m}"
                          for m in MODELS))} AS blend_pred FROM t""")
def blend_predict(spark: SparkSession, sf: str) -> DataFrame:
    """B4 at the R^2-share weights (the B2 fallback rule): sum w * p."""
    w, st = _stats(spark, sf)
    members = B.eligible_members(st, MODELS)
    weights = B.r2_share_weights([st["r2"][MODELS.index(m)] for m in members])
    bl = B.Blend(members, weights, 0.0, "r2_share")
    return w.select("key", r6(bl.expr()).alias("blend_pred"))


def _model_shares_sql() -> str:
    parts = []
    for m in ["m1", "m2"]:
        inner = " UNION ALL ".join(
            f"SELECT '{f}' AS feature, abs(corr({f}, {m})) AS v FROM t" for f in NET_FEATURES)
        parts.append(f"SELECT '{m}' AS model, feature, round_even(v / sum(v) OVER () * 100, 1) "
                     f"AS pct FROM ({inner})")
    return " UNION ALL ".join(parts)


@register("blend_importance", f"""
WITH t AS ({FX13_SQL}), {_share_sql()},
s AS ({_model_shares_sql()}),
g AS (SELECT feature, sum(w.w * s.pct) AS v FROM s JOIN w USING (model) WHERE w.w > 0
      GROUP BY feature)
SELECT feature, round_even(v / sum(v) OVER () * 100, 1) AS pct FROM g""")
def blend_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Member feature shares (|r| of each feature with the member's
    prediction, percent) weighted by positive blend weights, to 100 %."""
    w, st = _stats(spark, sf)
    members = B.eligible_members(st, MODELS)
    weights = B.r2_share_weights([st["r2"][MODELS.index(m)] for m in members])
    bl = B.Blend(members, weights, 0.0, "r2_share")
    r = w.agg(*[F.abs(F.corr(f, m)).alias(f"{m}|{f}") for m in members for f in NET_FEATURES]) \
         .first()
    rows = []
    for m in members:
        tot = sum(r[f"{m}|{f}"] for f in NET_FEATURES)
        rows += [(m, f, float(r[f"{m}|{f}"] / tot * 100)) for f in NET_FEATURES]
    shares = spark.createDataFrame(rows, "model string, feature string, pct double") \
        .withColumn("pct", F.bround("pct", 1))
    return B.blend_importance(bl, shares)


@register("pick_model", f"""
WITH t AS ({FX13_SQL}), {_share_sql()},
b AS (SELECT 1 - sum((y - ({" + ".join(
    f"coalesce((SELECT w FROM w WHERE model = '{m}'), 0) * {m}" for m in MODELS)})) ^ 2)
      / (var_pop(y) * count(*)) AS r2 FROM t),
best AS (SELECT model, r2 FROM r ORDER BY r2 DESC,
         CASE model {" ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS))} END LIMIT 1)
SELECT CASE WHEN b.r2 >= best.r2 + 0.005 THEN 'blend' ELSE best.model END AS chosen,
       best.model AS best_single, {R("best.r2")} AS best_r2, {R("b.r2")} AS blend_r2
FROM best, b""")
def pick_model(spark: SparkSession, sf: str) -> DataFrame:
    """Best single model by R^2 (ties first), blend kept only if it
    beats it by >= 0.005 (blend at the R^2-share weights)."""
    w, st = _stats(spark, sf)
    members = B.eligible_members(st, MODELS)
    weights = B.r2_share_weights([st["r2"][MODELS.index(m)] for m in members])
    idx = [MODELS.index(m) for m in members]
    import numpy as np
    br2 = B.r2_of_weights(st, idx, np.array(weights))
    scores = list(zip(MODELS, st["r2"]))
    chosen = B.pick_model(scores, br2)
    best = B.pick_model(scores, None)
    return spark.createDataFrame(
        [(chosen, best, float(st["r2"][MODELS.index(best)]), float(br2))],
        "chosen string, best_single string, best_r2 double, blend_r2 double").select(
        "chosen", "best_single", r6("best_r2").alias("best_r2"), r6("blend_r2").alias("blend_r2"))


@register("fold_bag", f"""
SELECT key, {R("(" + " + ".join(f"(exp(ln(1 + y) + {0.01 * k}) - 1)" for k in range(5)) + ") / 5.0")}
  AS bag_pred FROM ({NET_CHARGE_SQL})""")
def fold_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Five fold models predicting log1p(y) (offset per fold); the bag
    averages AFTER expm1, as in scoring."""
    df = net_charge(spark, sf).withColumns(
        {f"f{k}": F.log1p("y") + 0.01 * k for k in range(5)})
    return df.select("key", r6(B.fold_bag([f"f{k}" for k in range(5)], F.expm1))
                     .alias("bag_pred"))


# ---- D8-D11 -----------------------------------------------------------------

@register("scatter_sample", f"""
SELECT round_even(y, 4) AS "true", round_even(m1, 4) AS pred FROM ({FX13_SQL})
WHERE isfinite(y) AND isfinite(m1)
ORDER BY md5(concat('42|', key)), key LIMIT 250""")
def scatter_sample(spark: SparkSession, sf: str) -> DataFrame:
    """<= 250 finite (true, pred) pairs by md5 sample, 4 decimals."""
    w = fx13(spark, sf).filter(~F.isnan("y") & ~F.isnan("m1"))
    s = hash_sample(w.select("key", "y", "m1"), 250, 42, "key")
    return s.select(F.bround("y", 4).alias("true"), F.bround("m1", 4).alias("pred"))


@register("candidate_table", f"""
WITH f AS {folds_sql(FX13_SQL)},
r AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS name, {i} AS ord, 1 - sum((y - {m}) ^ 2) / (var_pop(y) * count(*)) AS r2 "
    f"FROM f" for i, m in enumerate(MODELS))}),
pf AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS name, fold, count(*) AS n, CASE WHEN var_pop(y) > 0 THEN "
    f"1 - sum((y - {m}) ^ 2) / (var_pop(y) * count(*)) ELSE 0 END AS r2 FROM f GROUP BY fold"
    for m in MODELS)}),
sd AS (SELECT name, CASE WHEN count(*) >= 2 THEN stddev_pop(r2) ELSE 0.0 END AS r2_std
       FROM pf WHERE n >= 2 GROUP BY name),
b AS (SELECT name FROM r ORDER BY r2 DESC, ord LIMIT 1)
SELECT r.name, {R("r.r2")} AS r2, 'synthetic' AS type, r.name = b.name AS is_best,
  {R("sd.r2_std")} AS r2_std,
  CASE WHEN {R("r.r2")} >= 0.95 THEN 'very_high' WHEN {R("r.r2")} >= 0.85 THEN 'high'
  WHEN {R("r.r2")} >= 0.7 THEN 'practical' WHEN {R("r.r2")} >= 0.5 THEN 'moderate'
  WHEN {R("r.r2")} >= 0 THEN 'insufficient' ELSE 'nonfunctional' END AS words
FROM r JOIN sd USING (name), b""")
def candidate_table(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate models with OOF R^2, fold spread (A12), best flag."""
    df = fx13(spark, sf)
    folded, plan = assign_folds(df, "y", "key", 5)
    folded = folded.cache()
    long = folded.select("y", "fold", F.explode(F.array(*[
        F.struct(F.lit(m).alias("name"), F.lit(i).alias("ord"), F.col(m).alias("pred"))
        for i, m in enumerate(MODELS)])).alias("c")).select("y", "fold", "c.*")
    allm = A.metrics_with_fold_spread(long, "y", "pred", "fold", by=["name"]).cache()
    scores = [(r["name"], r["r2"]) for r in allm.collect()]
    scores.sort(key=lambda t: MODELS.index(t[0]))
    best = B.pick_model(scores, None)
    return allm.select(
        "name", r6("r2").alias("r2"), F.lit("synthetic").alias("type"),
        (F.col("name") == best).alias("is_best"), r6("r2_std").alias("r2_std"),
        r2_words(r6("r2")).alias("words"))


@register("run_summary", f"""
WITH t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS y, n_chars * 1.1 - 50 AS p FROM documents),
k AS (SELECT min(y) AS lo, max(y) AS hi FROM t),
c AS (SELECT lo - CASE WHEN hi - lo > 0 THEN (hi - lo) * 0.05 ELSE greatest(abs(hi), 1) * 0.05 END
        AS ylo, hi + CASE WHEN hi - lo > 0 THEN (hi - lo) * 0.05 ELSE greatest(abs(hi), 1) * 0.05
        END AS yhi, lo, hi FROM k),
q AS (SELECT y, p, round(CASE WHEN p < ylo THEN ylo WHEN p > yhi THEN yhi ELSE p END) AS pp
      FROM t, c)
SELECT {R("1 - sum((y - pp) ^ 2) / (var_pop(y) * count(*))")} AS r2,
  {R("1 - sum((y - p) ^ 2) / (var_pop(y) * count(*))")} AS r2_raw,
  {R("sqrt(avg((y - pp) ^ 2))")} AS rmse, {R("avg(abs(y - pp))")} AS mae,
  {R("any_value(c.lo)")} AS y_min, {R("any_value(c.hi)")} AS y_max,
  'oof' AS eval_on, CAST(count(*) AS BIGINT) AS eval_rows FROM q, c""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """R^2 after and before post-processing (B7 without smear: no log
    transform), RMSE, MAE, y range, evaluation kind and rows."""
    from ..operators.post import PostProcess
    from ..session import load
    d = load(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("y"),
                                            (F.col("n_chars") * 1.1 - 50).alias("p"))
    lo, hi = A.y_clip_range(d, "y")
    pp = PostProcess(1.0, lo, hi, True)
    t = d.withColumn("pp", pp.apply("p"))
    after = A.regression_metrics(t, "y", "pp")
    before = A.regression_metrics(t, "y", "p").select(F.col("r2").alias("r2_raw"))
    rng = d.agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return after.crossJoin(before).crossJoin(rng).select(
        r6("r2").alias("r2"), r6("r2_raw").alias("r2_raw"), r6("rmse").alias("rmse"),
        r6("mae").alias("mae"), r6("y_min").alias("y_min"), r6("y_max").alias("y_max"),
        F.lit("oof").alias("eval_on"), F.col("n_rows").cast("long").alias("eval_rows"))
