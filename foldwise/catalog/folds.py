"""Queries: cross-validation as data (V1-V6) and per-fold Gram blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6, round_sig
from ..operators import cv as V
from ..operators import stats as A
from ..operators.quantiles import quantiles_of
from ..session import load
from . import register
from .fixtures import NET_CHARGE_SQL, NET_FEATURES, OUTLIERS_SQL, folds_sql, net_charge, \
    outliers, sig_sql


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


ORDERS_Y_SQL = "SELECT o_orderkey AS key, o_totalprice AS y FROM orders"


def _orders(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"),
                                            F.col("o_totalprice").alias("y"))


@register("stratified_folds", f"""
SELECT key AS o_orderkey, bin, fold FROM {folds_sql(ORDERS_Y_SQL)}""")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """V1 + V2 on orders (y = o_totalprice): 5 quantile bins, 5 folds dealt
    round-robin in md5('42|key') order inside each bin."""
    f, plan = V.assign_folds(_orders(spark, sf), "y", "key", 5)
    return f.select(F.col("key").alias("o_orderkey"), "bin", "fold")


@register("kfold", """
SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY md5(concat('42|', cast(o_orderkey AS varchar))),
       o_orderkey) - 1 AS INTEGER) AS fold FROM orders""")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    """V3: plain shuffled K-fold (ntile over the md5 order), distributed rank."""
    f = V.kfold(_orders(spark, sf), "key", 5)
    return f.select(F.col("key").alias("o_orderkey"), "fold")


SMALL = [("region", "r_regionkey", "r_regionkey"), ("nation", "n_nationkey", "n_regionkey"),
         ("supplier", "s_suppkey", "s_acctbal")]


def _small_sql() -> str:
    parts = []
    # (bins, folds) the V1/V4 rules give: region 5 rows -> 2/2, nation 25 -> 2/5,
    # supplier 100 -> 5/5 (asserted by the Spark side, which derives them)
    plans = {"region": (2, 2), "nation": (2, 5), "supplier": (5, 5)}
    for t, key, y in SMALL:
        b, k = plans[t]
        base = f"SELECT {key} AS key, CAST({y} AS DOUBLE) AS y FROM {t}"
        parts.append(f"SELECT '{t}' AS fixture, CAST(key AS BIGINT) AS key, bin, fold "
                     f"FROM {folds_sql(base, b, k)}")
    return " UNION ALL ".join(parts)


@register("small_table_folds", _small_sql())
def small_table_folds(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V4 on FX9 small tables: bin and fold counts follow from the row
    count (region 5 rows, nation 25, supplier 100)."""
    out = None
    for t, key, y in SMALL:
        df = load(spark, sf, t).select(F.col(key).cast("long").alias("key"),
                                       F.col(y).cast("double").alias("y"))
        f, plan = V.assign_folds(df, "y", "key", 5)
        q = f.select(F.lit(t).alias("fixture"), "key", "bin", "fold")
        out = q if out is None else out.unionByName(q)
    return out


def _fold_plan_sql() -> str:
    parts = []
    for t, key, y in SMALL + [("orders", "o_orderkey", "o_totalprice")]:
        parts.append(f"""
SELECT * FROM (
WITH b AS (SELECT CAST({y} AS DOUBLE) AS y FROM {t}),
n AS (SELECT count(*) AS n FROM b),
r AS (SELECT n.n,
        CASE WHEN n.n < 10 THEN 0 WHEN n.n < 50 THEN (CASE WHEN n.n < 100 THEN 10 ELSE 5 END)
             ELSE 5 END AS k FROM n),
p AS (SELECT n, k, greatest(2, least(k, n // 2)) AS a,
             least(greatest(2, least(k, n // 2)), greatest(2, n // 10)) AS e FROM r),
s AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS rn FROM b),
q AS (SELECT i, (p.n - 1) * i / p.e AS h FROM p, range(0, 1000) t(i) WHERE i <= p.e),
ed AS (SELECT q.i, lo.y + (q.h - floor(q.h)) * (coalesce(hi.y, lo.y) - lo.y) AS v
       FROM q JOIN s lo ON lo.rn = floor(q.h) LEFT JOIN s hi ON hi.rn = floor(q.h) + 1),
de AS (SELECT DISTINCT v FROM ed),
inner_e AS (SELECT v FROM de WHERE v > (SELECT min(v) FROM de) AND v < (SELECT max(v) FROM de)),
bins AS (SELECT (SELECT count(*) FROM inner_e WHERE inner_e.v < b.y) AS bin FROM b),
sz AS (SELECT min(c) AS smallest FROM (SELECT count(*) AS c FROM bins GROUP BY bin))
SELECT '{t}' AS fixture, CAST(p.n AS BIGINT) AS n_rows,
  CASE WHEN p.k = 0 THEN 'none' WHEN least(p.a, sz.smallest) >= 2 THEN 'stratified'
       ELSE 'kfold' END AS kind,
  CAST(CASE WHEN p.k = 0 THEN 0 WHEN least(p.a, sz.smallest) >= 2 THEN least(p.a, sz.smallest)
       ELSE greatest(2, least(p.a, p.n)) END AS BIGINT) AS n_folds,
  CAST(CASE WHEN p.k = 0 THEN 0 ELSE p.e END AS BIGINT) AS n_bins
FROM p, sz)""")
    return " UNION ALL ".join(parts)


@register("fold_plan", _fold_plan_sql())
def fold_plan(spark: SparkSession, sf: str) -> DataFrame:
    """V4: fold count and kind per table size (rows check)."""
    rows = []
    for t, key, y in SMALL + [("orders", "o_orderkey", "o_totalprice")]:
        df = load(spark, sf, t).select(F.col(key).cast("long").alias("key"),
                                       F.col(y).cast("double").alias("y"))
        n = df.count()
        k = V.fold_count(n, oof=n < V.SMALL_N_OOF)
        if k == 0:
            rows.append((t, n, "none", 0, 0))
            continue
        a, e = V.n_bins_for(n, k)
        _, plan = V.assign_folds(df, "y", "key", k, n_rows=n)
        rows.append((t, n, plan.kind, plan.n_folds, e))
    return spark.createDataFrame(rows, "fixture string, n_rows long, kind string, "
                                       "n_folds long, n_bins long")


@register("es_holdout", f"""
WITH f AS {folds_sql(ORDERS_Y_SQL)},
ks AS (SELECT DISTINCT fold AS k FROM f),
tr AS (SELECT ks.k AS train_fold, f.key FROM ks JOIN f ON f.fold <> ks.k),
r AS (SELECT train_fold, key,
        row_number() OVER (PARTITION BY train_fold ORDER BY
          md5(concat(CAST(20260716 + train_fold AS varchar), '|', cast(key AS varchar))), key) - 1
          AS pos,
        count(*) OVER (PARTITION BY train_fold) AS n FROM tr)
SELECT key AS o_orderkey, CAST(train_fold AS INTEGER) AS train_fold,
  (n >= 20 AND n - greatest(1, round_even(n * 0.1, 0)) >= 10
   AND pos < greatest(1, round_even(n * 0.1, 0))) AS es_val
FROM r""")
def es_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """V6: per fold model, 10 % of its training rows (seed 20260716 + fold)
    held out for early stopping."""
    f, plan = V.assign_folds(_orders(spark, sf), "y", "key", 5)
    es = V.es_holdout(f, "key", "fold", plan.n_folds)
    return es.select(F.col("key").alias("o_orderkey"), F.col("train_fold").cast("int"), "es_val")


@register("clip_bounds_per_fold", f"""
WITH f AS {folds_sql(OUTLIERS_SQL)},
ks AS (SELECT DISTINCT fold AS k FROM f),
tr AS (SELECT ks.k, f.y FROM ks JOIN f ON f.fold <> ks.k)
SELECT CAST(k AS INTEGER) AS train_fold, {R("quantile_cont(y, 0.01)")} AS clip_lo,
  {R("quantile_cont(y, 0.99)")} AS clip_hi,
  {R("quantile_cont(y, 0.25) - 4.5 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))")}
    AS win_lo,
  {R("quantile_cont(y, 0.75) + 4.5 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))")}
    AS win_hi,
  {R("median(y)")} AS median
FROM tr GROUP BY k""")
def clip_bounds_per_fold(spark: SparkSession, sf: str) -> DataFrame:
    """V5: parameters refitted per fold without its validation rows: bucket
    counts by fold, every training set by subtraction."""
    f, plan = V.assign_folds(outliers(spark, sf), "y", "key", 5)
    found = quantiles_of(f, ["y"], [0.01, 0.99, 0.25, 0.75, 0.5], "fold", True)
    rows = [(m, *per["y"]) for m, per in found.items() if m >= 0]
    q = spark.createDataFrame(rows, "train_fold int, p1 double, p99 double, q1 double, q3 double, med double")
    iqr = F.col("q3") - F.col("q1")
    return q.select("train_fold", r6("p1").alias("clip_lo"), r6("p99").alias("clip_hi"),
                    r6(F.col("q1") - 4.5 * iqr).alias("win_lo"), r6(F.col("q3") + 4.5 * iqr).alias("win_hi"),
                    r6("med").alias("median"))


QUANTILE_PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def _quantile_sql(y: str, source: str) -> str:
    qs = ", ".join(f"{R(f'quantile_cont({y}, {p})')} AS q{int(100 * p)}" for p in QUANTILE_PROBS)
    return f"SELECT CAST(k AS INTEGER) AS train_fold, '{source}' AS filled, {qs} FROM tr GROUP BY k"


@register("quantiles_by_fold", f"""
WITH f AS {folds_sql(OUTLIERS_SQL)},
g AS (SELECT fold, CASE WHEN bin = 1 THEN NULL ELSE y END AS v FROM f),
ks AS (SELECT DISTINCT fold AS k FROM f UNION ALL SELECT -1),
raw AS (SELECT ks.k, g.v FROM ks JOIN g ON g.fold <> ks.k),
tr AS (SELECT raw.k, raw.v, coalesce(raw.v, m.med) AS w
       FROM raw JOIN (SELECT k, median(v) AS med FROM raw GROUP BY k) m ON m.k = raw.k)
{_quantile_sql("v", "no")} UNION ALL {_quantile_sql("w", "yes")}""")
def quantiles_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A3, A4, A8 with V5: exact quantiles of every training set (-1: all
    rows) of a column a fifth of which is missing, as it is and filled with the
    set's own median, from additive counts in buckets of about 50 rows."""
    f, plan = V.assign_folds(outliers(spark, sf), "y", "key", 5)
    f = f.select("fold", F.when(F.col("bin") != 1, F.col("y")).alias("v"))
    some = {"buckets": max(16, plan.n_rows // 50), "last_rows": 0}
    raw = quantiles_of(f, ["v"], QUANTILE_PROBS, "fold", True, **some)
    _, full = A.filled_quantiles(f, ["v"], QUANTILE_PROBS, "fold", True)
    rows = [(m, name, *per["v"]) for name, found in (("no", raw), ("yes", full)) for m, per in found.items()]
    names = [f"q{int(100 * p)}" for p in QUANTILE_PROBS]
    out = spark.createDataFrame(rows, "train_fold int, filled string, " + ", ".join(f"{x} double" for x in names))
    return out.select("train_fold", "filled", *[r6(x).alias(x) for x in names])


GRAM_COLS = NET_FEATURES + ["y"]


def _gram_sql() -> str:
    sums = []
    for i, a in enumerate(GRAM_COLS):
        for b in GRAM_COLS[i:]:
            sums.append(f"{sig_sql(f'sum({a} * {b})', 10)} AS \"{a}*{b}\"")
    firsts = [f"{sig_sql(f'sum({a})', 10)} AS \"{a}\"" for a in GRAM_COLS]
    return (f"SELECT fold, CAST(count(*) AS BIGINT) AS n, {', '.join(firsts)}, "
            f"{', '.join(sums)} FROM {folds_sql(NET_CHARGE_SQL)} GROUP BY fold")


@register("gram_by_fold", _gram_sql())
def gram_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """N, sums and cross-product sums per fold in one grouped aggregate
    (partial aggregation: one row per fold per map task is shuffled)."""
    f, plan = V.assign_folds(net_charge(spark, sf), "y", "key", 5)
    aggs = [F.count(F.lit(1)).cast("long").alias("n")]
    aggs += [round_sig(F.sum(a), 10).alias(a) for a in GRAM_COLS]
    for i, a in enumerate(GRAM_COLS):
        for b in GRAM_COLS[i:]:
            aggs.append(round_sig(F.sum(F.col(a) * F.col(b)), 10).alias(f"{a}*{b}"))
    return f.groupBy("fold").agg(*aggs)
