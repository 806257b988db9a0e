"""Queries: fitted plan, batch scoring, summaries and previews (B8, S7-S10,
P8, D10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import stats as A
from ..operators.cv import assign_folds
from ..operators.linear import ridge_cv, ridge_fit
from ..plans.fitted import FittedPlan, preview, score_summary
from ..session import load, shared_path
from . import register
from ..functions.expr import round_sig
from .fixtures import NET_CHARGE_SQL, net_charge, sig_sql


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


def fit_net_charge_plan(spark: SparkSession, sf: str, features=("l_extendedprice",),
                        alphas=(0.0,)) -> FittedPlan:
    """A one-pass ridge plan on FX1 (alpha 0 = OLS for the oracle pair)."""
    df = net_charge(spark, sf)
    if len(alphas) == 1:            # one alpha: a direct fit, no folds needed
        final = ridge_fit(df, list(features), "y", alphas[0])
    else:
        n = df.count()
        folded, plan = assign_folds(df, "y", "key", 5, n_rows=n)
        final = ridge_cv(folded, list(features), "y", "key", "fold", k=plan.n_folds,
                         alphas=alphas, n_rows=n).final
    lo, hi = A.y_clip_range(df, "y")
    return FittedPlan(
        target="y", features=list(features), raw_columns=df.columns, medians=final.fills,
        model={"type": "linear", "intercept": final.intercept, "weights": final.weights},
        postprocess={"smear": 1.0, "y_lo": lo, "y_hi": hi, "round_output": False})


SCORE_SQL = f"""
WITH t AS ({NET_CHARGE_SQL}),
f AS (SELECT regr_slope(y, l_extendedprice) AS s, regr_intercept(y, l_extendedprice) AS i,
        min(y) - (max(y) - min(y)) * 0.05 AS lo, max(y) + (max(y) - min(y)) * 0.05 AS hi FROM t),
p AS (SELECT key, CASE WHEN i + s * l_extendedprice < lo THEN lo
                       WHEN i + s * l_extendedprice > hi THEN hi
                       ELSE i + s * l_extendedprice END AS y FROM t, f)"""


@register("score_batch", SCORE_SQL + f"\nSELECT key, {sig_sql('y', 6)} AS y FROM p")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Encode -> fill -> model -> inverse -> post-process as one lazy
    chain over the whole table; the prediction overwrites the target."""
    plan = fit_net_charge_plan(spark, sf)
    scored = plan.score(net_charge(spark, sf))
    return scored.select("key", round_sig("y", 6).alias("y"))


@register("score_summary", SCORE_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(y), 2) AS mean,
       CASE WHEN count(y) > 1 THEN round(stddev_samp(y), 2) ELSE 0.0 END AS std FROM p""")
def score_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    """Row count, mean and sample std of the predictions (2 decimals)."""
    plan = fit_net_charge_plan(spark, sf)
    scored = plan.score(net_charge(spark, sf))
    return score_summary(scored, "y", [], plan.features).select(
        F.col("n_rows").cast("long"), "mean", "std")


@register("preview", SCORE_SQL + f"""
SELECT key, {R('y')} AS y FROM p ORDER BY key LIMIT 500""")
def preview_query(spark: SparkSession, sf: str) -> DataFrame:
    """First 500 scored rows in key order."""
    plan = fit_net_charge_plan(spark, sf)
    scored = plan.score(net_charge(spark, sf)).select("key", r6("y").alias("y"))
    return preview(scored, "key", 500)


MISSING_COLUMNS_SQL = f"""
WITH t AS ({NET_CHARGE_SQL}),
q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS qe,
             quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS qq,
             min(y) - (max(y) - min(y)) * 0.05 AS lo, max(y) + (max(y) - min(y)) * 0.05 AS hi
      FROM t),
z AS (SELECT (l_extendedprice - qe[2]) / greatest(qe[3] - qe[1], 1e-8) AS z1,
             (l_quantity - qq[2]) / greatest(qq[3] - qq[1], 1e-8) AS z2, y FROM t, q),
m AS (SELECT avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my,
             covar_pop(z1, z1) * count(*) + 1.0 AS a11, covar_pop(z1, z2) * count(*) AS a12,
             covar_pop(z2, z2) * count(*) + 1.0 AS a22, covar_pop(z1, y) * count(*) AS c1,
             covar_pop(z2, y) * count(*) AS c2 FROM z),
b AS (SELECT (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS b1,
             (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS b2, m1, m2, my FROM m),
p AS (SELECT b.my - b.b1 * b.m1 - b.b2 * b.m2 + b.b1 * z.z1 AS raw, q.lo, q.hi FROM z, b, q),
c AS (SELECT CASE WHEN raw < lo THEN lo WHEN raw > hi THEN hi ELSE raw END AS y FROM p)
SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(y), 2) AS mean,
       CASE WHEN count(y) > 1 THEN round(stddev_samp(y), 2) ELSE 0.0 END AS std,
       'l_extendedprice, l_quantity' AS columns, 'l_quantity' AS missing FROM c"""


@register("missing_columns", MISSING_COLUMNS_SQL)
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring a table without a model column reports it and fills it
    with the training median (rows check)."""
    plan = fit_net_charge_plan(spark, sf, features=("l_extendedprice", "l_quantity"),
                               alphas=(1.0,))
    df = net_charge(spark, sf).drop("l_quantity")
    enc, missing = plan.encode(df)
    scored = plan.score(df)
    return score_summary(scored, "y", missing, plan.features)


@register("plan_save_load", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, 0.0 AS max_abs_diff FROM lineitem""")
def plan_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Save the fitted plan into the checkpoint folder, load it back and
    score with both; returns the largest absolute difference (rows check)."""
    plan = fit_net_charge_plan(spark, sf)
    path = shared_path(spark, "plan")
    plan.save(spark, path)
    back = FittedPlan.load(spark, path)
    a = plan.score(net_charge(spark, sf)).select("key", F.col("y").alias("a"))
    b = back.score(net_charge(spark, sf)).select("key", F.col("y").alias("b"))
    return a.join(b, "key").agg(F.count(F.lit(1)).alias("n_rows"),
                                F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))


@register("data_warnings", f"""
WITH e AS (SELECT CASE WHEN event_id % 500 = 0 THEN value * 100 ELSE value END AS y,
                  event_type, user_id FROM events),
q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM e),
o AS (SELECT count(*) AS n_out FROM e, q WHERE y < q1 - 4.5 * (q3 - q1) OR y > q3 + 4.5 * (q3 - q1)),
d AS (SELECT coalesce(sum(c - 1), 0) AS n_dup FROM (SELECT count(*) AS c FROM e
      GROUP BY y, event_type, user_id))
SELECT 'outliers_corrected' AS code, CAST(n_out AS BIGINT) AS n, 4.5 AS param FROM o WHERE n_out > 0
UNION ALL SELECT 'duplicate_rows', CAST(n_dup AS BIGINT), NULL FROM d WHERE n_dup > 0
UNION ALL SELECT CASE WHEN n < 10 THEN 'small_full_data' ELSE 'holdout_eval' END,
  CAST(CASE WHEN n < 10 THEN n ELSE n - (n * 4) // 5 END AS BIGINT), NULL FROM q
UNION ALL SELECT 'target_na_excluded', CAST(count(*) - count(y) AS BIGINT), NULL FROM e
  HAVING count(*) - count(y) > 0""")
def data_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """D10 on FX10 (events value with outliers, quick mode): winsorized rows
    (IQR x 4.5), duplicate rows, the evaluation kind, missing targets."""
    from ..operators.cv import SMALL_N_OOF, fold_count
    from ..operators.select import count_duplicate_rows
    ev = load(spark, sf, "events")
    e = ev.select(F.when(F.col("event_id") % 500 == 0, F.col("value") * 100)
                  .otherwise(F.col("value")).alias("y"), "event_type", "user_id")
    lo, hi = A.iqr_bounds(e, "y", 4.5)
    r = e.agg(F.count(F.lit(1)).alias("n"),
              F.sum(((F.col("y") < lo) | (F.col("y") > hi)).cast("long")).alias("n_out"),
              (F.count(F.lit(1)) - F.count("y")).alias("n_na")).first()
    n_dup = count_duplicate_rows(e).first()["duplicate_rows"]
    rows = []
    if r["n_out"]:
        rows.append(("outliers_corrected", int(r["n_out"]), 4.5))
    if n_dup:
        rows.append(("duplicate_rows", int(n_dup), None))
    n = int(r["n"])
    if n < 10:
        rows.append(("small_full_data", n, None))
    elif n < SMALL_N_OOF:
        rows.append(("oof_eval_small_n", n, None))
    else:
        k = fold_count(n, oof=False)
        # holdout: fold 0 of a near-equal k-way split validates
        rows.append(("holdout_eval", n - (n * (k - 1)) // k, None))
    if r["n_na"]:
        rows.append(("target_na_excluded", int(r["n_na"]), None))
    return spark.createDataFrame(rows, "code string, n long, param double")
