"""Queries: encoders (J1-J5, A13) and derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import composite_key, level, r6
from ..operators import encode as E
from ..operators import select as S
from ..operators.cv import assign_folds
from ..session import load
from . import register
from ..functions.expr import round_sig
from .fixtures import NET_CHARGE_SQL, NET_FEATURES, folds_sql, net_charge, sig_sql


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


# ---- J1 -------------------------------------------------------------------

@register("onehot", """
WITH lv AS (SELECT DISTINCT coalesce(CAST(c_mktsegment AS varchar), '__NaN__') AS lv
            FROM customer)
SELECT c.c_custkey, concat('c_mktsegment==', lv.lv) AS feature,
       CASE WHEN coalesce(CAST(c.c_mktsegment AS varchar), '__NaN__') = lv.lv
            THEN 1.0 ELSE 0.0 END AS value
FROM customer c, lv""")
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    """J1 on FX5 (c_mktsegment, 5 levels), long form (row, feature, value)."""
    c = load(spark, sf, "customer")
    levels = S.onehot_levels(c, ["c_mktsegment"])["c_mktsegment"]
    exprs = E.onehot_exprs("c_mktsegment", levels)
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), e.alias("value")) for n, e in exprs])
    return c.select("c_custkey", F.explode(arr).alias("kv")).select(
        "c_custkey", "kv.feature", "kv.value")


# ---- A13 / J2 -------------------------------------------------------------

TE_SQL = f"""
WITH g AS (SELECT avg(p_retailprice) AS gm FROM part),
m AS (SELECT coalesce(CAST(p_brand AS varchar), '__NaN__') AS level, count(p_retailprice) AS n,
             avg(p_retailprice) AS mu FROM part GROUP BY 1),
enc AS (SELECT level, (n * mu + 20.0 * gm) / (n + 20.0) AS value, gm AS "default" FROM m, g)
SELECT p.p_partkey, {R('coalesce(enc.value, enc."default")')} AS p_brand_te
FROM part p LEFT JOIN enc ON coalesce(CAST(p.p_brand AS varchar), '__NaN__') = enc.level"""


@register("target_encode", TE_SQL)
def target_encode(spark: SparkSession, sf: str) -> DataFrame:
    """A13 + J2: smoothed mean of p_retailprice per p_brand, applied to part."""
    p = load(spark, sf, "part")
    enc = E.target_encoder_map(p, "p_brand", "p_retailprice")
    out = E.apply_target_encoder(p, "p_brand", enc, out="p_brand_te", n_levels=None)
    return out.select("p_partkey", r6("p_brand_te").alias("p_brand_te"))


PART_Y_SQL = "SELECT p_partkey AS key, p_brand, p_name, p_retailprice AS y FROM part"


@register("target_encode_oof", f"""
WITH f AS {folds_sql(PART_Y_SQL)},
ks AS (SELECT DISTINCT fold AS k FROM f),
tr AS (SELECT ks.k, f.* FROM ks JOIN f ON f.fold <> ks.k),
g AS (SELECT k, avg(y) AS gm FROM tr GROUP BY k),
m AS (SELECT k, coalesce(p_name, '__NaN__') AS level, count(y) AS n, avg(y) AS mu
      FROM tr GROUP BY k, level),
enc AS (SELECT m.k, level, (n * mu + 20.0 * gm) / (n + 20.0) AS value FROM m JOIN g ON m.k = g.k)
SELECT f.key AS p_partkey, f.fold, {R("coalesce(enc.value, g.gm)")} AS p_name_te
FROM f JOIN g ON g.k = f.fold
LEFT JOIN enc ON enc.k = f.fold AND enc.level = coalesce(f.p_name, '__NaN__')""")
def target_encode_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold target encoding of p_name (64 levels) by subtraction:
    each row gets the map fitted on the other folds."""
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name",
                                       F.col("p_retailprice").alias("y"))
    folded, plan = assign_folds(p, "y", "key", 5)
    enc = E.target_encoder_oof(folded, "p_name", "y", "fold")
    out = E.apply_target_encoder(folded, "p_name", enc, out="p_name_te", by=["fold"])
    return out.select(F.col("key").alias("p_partkey"), "fold",
                      r6("p_name_te").alias("p_name_te"))


# ---- X7, X8, J4, J5 ---------------------------------------------------------

# single-candidate fixtures (customer, part) and a three-candidate one
# (lineitem, no key); the SQL covers the 0, 1 and > 2 candidate cases
COMPOSITE_DETECT_SQL = """WITH s AS (SELECT 'customer' AS fx, 0 AS pos, 'c_nationkey' AS col, count(*) AS n, count(CAST(c_nationkey AS DOUBLE)) AS nn, count(DISTINCT CAST(c_nationkey AS DOUBLE)) AS d, bool_and(CAST(c_nationkey AS DOUBLE) = round(CAST(c_nationkey AS DOUBLE))) AS w, max(abs(CAST(c_nationkey AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(c_nationkey AS DOUBLE) IS NULL OR isinf(CAST(c_nationkey AS DOUBLE)) OR isnan(CAST(c_nationkey AS DOUBLE)) OR abs(CAST(c_nationkey AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(c_nationkey AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM customer UNION ALL SELECT 'customer' AS fx, 1 AS pos, 'c_acctbal' AS col, count(*) AS n, count(CAST(c_acctbal AS DOUBLE)) AS nn, count(DISTINCT CAST(c_acctbal AS DOUBLE)) AS d, bool_and(CAST(c_acctbal AS DOUBLE) = round(CAST(c_acctbal AS DOUBLE))) AS w, max(abs(CAST(c_acctbal AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(c_acctbal AS DOUBLE) IS NULL OR isinf(CAST(c_acctbal AS DOUBLE)) OR isnan(CAST(c_acctbal AS DOUBLE)) OR abs(CAST(c_acctbal AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(c_acctbal AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM customer UNION ALL SELECT 'part' AS fx, 0 AS pos, 'p_size' AS col, count(*) AS n, count(CAST(p_size AS DOUBLE)) AS nn, count(DISTINCT CAST(p_size AS DOUBLE)) AS d, bool_and(CAST(p_size AS DOUBLE) = round(CAST(p_size AS DOUBLE))) AS w, max(abs(CAST(p_size AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(p_size AS DOUBLE) IS NULL OR isinf(CAST(p_size AS DOUBLE)) OR isnan(CAST(p_size AS DOUBLE)) OR abs(CAST(p_size AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(p_size AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM part UNION ALL SELECT 'part' AS fx, 1 AS pos, 'p_retailprice' AS col, count(*) AS n, count(CAST(p_retailprice AS DOUBLE)) AS nn, count(DISTINCT CAST(p_retailprice AS DOUBLE)) AS d, bool_and(CAST(p_retailprice AS DOUBLE) = round(CAST(p_retailprice AS DOUBLE))) AS w, max(abs(CAST(p_retailprice AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(p_retailprice AS DOUBLE) IS NULL OR isinf(CAST(p_retailprice AS DOUBLE)) OR isnan(CAST(p_retailprice AS DOUBLE)) OR abs(CAST(p_retailprice AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(p_retailprice AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM part UNION ALL SELECT 'lineitem' AS fx, 0 AS pos, 'l_linenumber' AS col, count(*) AS n, count(CAST(l_linenumber AS DOUBLE)) AS nn, count(DISTINCT CAST(l_linenumber AS DOUBLE)) AS d, bool_and(CAST(l_linenumber AS DOUBLE) = round(CAST(l_linenumber AS DOUBLE))) AS w, max(abs(CAST(l_linenumber AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(l_linenumber AS DOUBLE) IS NULL OR isinf(CAST(l_linenumber AS DOUBLE)) OR isnan(CAST(l_linenumber AS DOUBLE)) OR abs(CAST(l_linenumber AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(l_linenumber AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM lineitem UNION ALL SELECT 'lineitem' AS fx, 1 AS pos, 'l_quantity' AS col, count(*) AS n, count(CAST(l_quantity AS DOUBLE)) AS nn, count(DISTINCT CAST(l_quantity AS DOUBLE)) AS d, bool_and(CAST(l_quantity AS DOUBLE) = round(CAST(l_quantity AS DOUBLE))) AS w, max(abs(CAST(l_quantity AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(l_quantity AS DOUBLE) IS NULL OR isinf(CAST(l_quantity AS DOUBLE)) OR isnan(CAST(l_quantity AS DOUBLE)) OR abs(CAST(l_quantity AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(l_quantity AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM lineitem UNION ALL SELECT 'lineitem' AS fx, 2 AS pos, 'l_suppkey' AS col, count(*) AS n, count(CAST(l_suppkey AS DOUBLE)) AS nn, count(DISTINCT CAST(l_suppkey AS DOUBLE)) AS d, bool_and(CAST(l_suppkey AS DOUBLE) = round(CAST(l_suppkey AS DOUBLE))) AS w, max(abs(CAST(l_suppkey AS DOUBLE))) AS a, count(DISTINCT CASE WHEN CAST(l_suppkey AS DOUBLE) IS NULL OR isinf(CAST(l_suppkey AS DOUBLE)) OR isnan(CAST(l_suppkey AS DOUBLE)) OR abs(CAST(l_suppkey AS DOUBLE)) >= 1e15 THEN '__NaN__' ELSE CAST(CAST(round(CAST(l_suppkey AS DOUBLE)) AS BIGINT) AS varchar) END) AS g FROM lineitem),
c AS (SELECT * FROM s WHERE n >= 30 AND nn > 0 AND d >= 2 AND d / n <= 0.05 AND w AND a < 1e15),
k AS (SELECT fx, count(*) AS nc, any_value(col) AS col, any_value(g) AS g, any_value(n) AS n
      FROM c GROUP BY fx),
f AS (SELECT DISTINCT fx FROM s)
SELECT f.fx AS fixture,
  CASE WHEN k.nc = 1 AND k.g >= 2 AND k.g <= k.n * 0.5 THEN concat('__numkey__', k.col) END
    AS key_name,
  CAST(CASE WHEN k.nc = 1 AND k.g >= 2 AND k.g <= k.n * 0.5 THEN k.g END AS BIGINT) AS n_groups
FROM f LEFT JOIN k ON f.fx = k.fx"""


@register("composite_key", f"""
WITH k AS (SELECT c_custkey, c_acctbal,
  CASE WHEN c_nationkey IS NULL OR isinf(CAST(c_nationkey AS DOUBLE))
         OR isnan(CAST(c_nationkey AS DOUBLE)) OR abs(c_nationkey) >= 1e15 THEN '__NaN__'
       ELSE CAST(CAST(round(CAST(c_nationkey AS DOUBLE)) AS BIGINT) AS varchar) END AS key_text
  FROM customer),
g AS (SELECT avg(c_acctbal) AS gm FROM k),
m AS (SELECT key_text, count(c_acctbal) AS n, avg(c_acctbal) AS mu FROM k GROUP BY key_text)
SELECT k.c_custkey, k.key_text AS "__numkey__c_nationkey",
       {R("(m.n * m.mu + 20.0 * g.gm) / (m.n + 20.0)")} AS key_te
FROM k JOIN m ON k.key_text = m.key_text, g""")
def composite_key_query(spark: SparkSession, sf: str) -> DataFrame:
    """J4 detection on customer (c_nationkey is the one candidate), X7/X8
    canonical key text, J5 target-encoded key (y = c_acctbal)."""
    c = load(spark, sf, "customer")
    feats = ["c_custkey", "c_nationkey"]
    found = E.detect_composite_key(c, feats)
    if found is None:
        raise RuntimeError("expected a composite key on customer")
    name, cols, _ = found
    keyed = c.withColumn(name, composite_key(cols))
    enc = E.target_encoder_map(keyed, (name, F.col(name)), "c_acctbal")
    out = E.apply_target_encoder(keyed, name, enc, out="key_te", level_expr=F.col(name))
    return out.select("c_custkey", name, r6("key_te").alias("key_te"))


@register("composite_key_detect", COMPOSITE_DETECT_SQL)
def composite_key_detect(spark: SparkSession, sf: str) -> DataFrame:
    """J4 decisions on FX6: customer (one candidate), part p_size (one),
    lineitem (three candidates: none)."""
    rows = []
    c = load(spark, sf, "customer")
    p = load(spark, sf, "part")
    li = load(spark, sf, "lineitem")
    for name, df, cols in [("customer", c, ["c_nationkey", "c_acctbal"]),
                           ("part", p, ["p_size", "p_retailprice"]),
                           ("lineitem", li, ["l_linenumber", "l_quantity", "l_suppkey"])]:
        f = E.detect_composite_key(df, cols)
        rows.append((name, f[0] if f else None, int(f[2]) if f else None))
    return spark.createDataFrame(rows, "fixture string, key_name string, n_groups long")


# ---- E1 / E3 / A9 / X15 ---------------------------------------------------

def _recipe():
    return E.candidate_recipe(NET_FEATURES, {})


def _cand_sql() -> str:
    parts = []
    for i, (name, op, cs) in enumerate(_recipe()):
        if op == "mul":
            v = f"({cs[0]} * {cs[1]})"
        elif op == "sq":
            v = f"({cs[0]} * {cs[0]})"
        else:
            v = f"sign({cs[0]})"
        parts.append(f"SELECT '{name}' AS feature, CAST(count({v}) AS BIGINT) AS n_finite, "
                     f"{sig_sql(f'stddev_pop({v})')} AS std, {R(f'min({v})')} AS min_v, "
                     f"{R(f'max({v})')} AS max_v, stddev_pop({v}) >= 1e-12 AS kept FROM t")
    return f"WITH t AS ({NET_CHARGE_SQL}) " + " UNION ALL ".join(parts)


@register("candidate_stats", _cand_sql())
def candidate_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Products and squares of the raw features (no sign: no column has
    both signs), with the statistics used to drop non-finite / constant ones."""
    df = net_charge(spark, sf)
    st = E.candidate_stats(df, _recipe())
    return st.select("feature", F.col("n_finite").cast("long"), round_sig("std", 10).alias("std"),
                     r6("min_v").alias("min_v"), r6("max_v").alias("max_v"),
                     (F.col("std") >= 1e-12).alias("kept"))


@register("derive_features", f"""
SELECT key, {R("l_quantity * l_discount")} AS "l_quantity*l_discount",
       {R("l_tax * l_tax")} AS "l_tax^2",
       {R("sign(l_discount - 0.05)")} AS "sign(d_centered)",
       {R("l_quantity * (CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END)")}
         AS "l_quantity*ratio"
FROM ({NET_CHARGE_SQL})""")
def derive_features(spark: SparkSession, sf: str) -> DataFrame:
    """Apply a recipe (mul, sq, sign); a missing source gives missing."""
    df = net_charge(spark, sf).withColumns({
        "d_centered": F.col("l_discount") - 0.05,
        "ratio": F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount"))})
    recipe = [("l_quantity*l_discount", "mul", ["l_quantity", "l_discount"]),
              ("l_tax^2", "sq", ["l_tax"]), ("sign(d_centered)", "sign", ["d_centered"]),
              ("l_quantity*ratio", "mul", ["l_quantity", "ratio"])]
    out = E.apply_recipe(df, recipe)
    return out.select("key", *[r6(F.col(f"`{n}`")).alias(n) for n, _, _ in recipe])


_ = level
