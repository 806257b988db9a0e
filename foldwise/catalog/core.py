"""Flagship: how well do the lineitem numeric columns predict the net charge,
by 5-fold out-of-fold ridge R^2 (M1, V1, V2, V7, V8, A10-A12, M10, M13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators.cv import assign_folds
from ..operators.linear import ridge_cv, oof_metrics
from . import register
from .fixtures import NET_CHARGE_SQL, NET_FEATURES, net_charge


def ridge_report(spark: SparkSession, sf: str, features=NET_FEATURES, alphas=None,
                 k: int = 5) -> DataFrame:
    df = net_charge(spark, sf)
    folded, plan = assign_folds(df, "y", "key", k)      # counts rows in its first pass
    n = plan.n_rows
    folded = folded.cache()
    kw = {} if alphas is None else {"alphas": alphas}
    res = ridge_cv(folded, features, "y", "key", "fold", k=plan.n_folds, n_rows=n, **kw)
    m = oof_metrics(res.oof)
    out = m.select(
        F.lit("ridge").alias("model"), F.col("n_rows").cast("long").alias("n_rows"),
        F.lit(plan.n_folds).cast("long").alias("folds"),
        r6("r2").alias("r2"), r6("rmse").alias("rmse"), r6("mae").alias("mae"),
        r6("r2_std").alias("r2_std"),
        r6(F.lit(res.train_r2)).alias("train_r2"),
        F.lit(res.final.alpha).alias("alpha"),
        F.lit(", ".join(f"{x}:{p}" for x, p in res.importance)).alias("importance"))
    return out


@register("ridge_oof_metrics")
def ridge_oof_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship (entry): full ridge with per-fold median fill, robust scale
    and inner-CV alpha grid; rows-checked (tests compare with NumPy refits)."""
    return ridge_report(spark, sf)


def _ols_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    df = ridge_report(spark, sf, features=["l_extendedprice"], alphas=(0.0,))
    return df.select("n_rows", "folds", "r2", "rmse", "mae", "r2_std")


OLS_SQL = f"""
WITH base AS ({NET_CHARGE_SQL}),
e AS (SELECT list_sort(list_distinct(quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed
      FROM base),
b AS (SELECT key, l_extendedprice AS x, y,
             len(list_filter(ed, lambda v, i: i > 1 AND i < len(ed) AND v < y)) AS bin
      FROM base, e),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY bin
          ORDER BY md5(concat('42|', key)), key) - 1) % 5 AS INTEGER) AS fold FROM b),
ks AS (SELECT DISTINCT fold AS k FROM f),
fit AS (SELECT ks.k, regr_slope(f.y, f.x) AS s, regr_intercept(f.y, f.x) AS i
        FROM ks JOIN f ON f.fold <> ks.k GROUP BY ks.k),
p AS (SELECT f.fold, f.y, fit.i + fit.s * f.x AS pred FROM f JOIN fit ON f.fold = fit.k),
pf AS (SELECT fold, count(*) AS n,
              CASE WHEN var_pop(y) * count(*) > 0
                   THEN 1 - sum((y - pred) ^ 2) / (var_pop(y) * count(*)) END AS r2
       FROM p GROUP BY fold),
s AS (SELECT CASE WHEN count(*) >= 2 THEN stddev_pop(r2) ELSE 0.0 END AS r2_std
      FROM pf WHERE n >= 2)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS folds,
       round(1 - sum((y - pred) ^ 2) / (var_pop(y) * count(*)) + 3e-9, 6) AS r2,
       round(sqrt(avg((y - pred) ^ 2)) + 3e-9, 6) AS rmse,
       round(avg(abs(y - pred)) + 3e-9, 6) AS mae,
       round(any_value(s.r2_std) + 3e-9, 6) AS r2_std
FROM p, s
"""

register("ols_oof_one_feature", OLS_SQL)(_ols_one_feature)
