"""Queries: duplicates, samples, column screening and type triage (F6-F8,
P1-P4, P6, J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..functions.keys import md5_order
from ..operators import select as S
from ..operators import stats as A
from ..session import load
from . import register
from .fixtures import INJECTED_NULLS_SQL, dirty_numbers, dirty_numbers_sql, dt_valid_sql, \
    injected_nulls


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


# ---- F6 -------------------------------------------------------------------

@register("duplicate_row_count", """
SELECT 'nation_doubled' AS fixture, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM (SELECT * FROM nation UNION ALL
      SELECT * FROM nation WHERE n_nationkey < 5) GROUP BY n_nationkey, n_name, n_regionkey)
UNION ALL
SELECT 'lineitem_order_line', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL
SELECT 'orders_full_row', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey, o_custkey, o_orderstatus,
      o_totalprice, o_orderdate, o_orderpriority)""")
def duplicate_row_count(spark: SparkSession, sf: str) -> DataFrame:
    """F6 on FX8 (nation plus 5 copies), lineitem (order, line) pairs and
    whole orders rows (none)."""
    nat = load(spark, sf, "nation")
    fx8 = nat.unionByName(nat.filter(F.col("n_nationkey") < 5))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    od = load(spark, sf, "orders")
    parts = [("nation_doubled", fx8), ("lineitem_order_line", li), ("orders_full_row", od)]
    out = None
    for name, df in parts:
        q = S.count_duplicate_rows(df).select(F.lit(name).alias("fixture"), "duplicate_rows")
        out = q if out is None else out.unionByName(q)
    return out


# ---- F7 / F8 / D8 ---------------------------------------------------------

@register("hash_sample", """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5(concat('20260730|', cast(o_orderkey AS varchar))), o_orderkey LIMIT 500""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """the 500-row instant-mode sample (seed 20260730) of orders."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.hash_sample(o, S.INSTANT_MAX_ROWS, S.INSTANT_SAMPLE_SEED, "o_orderkey")


# ---- P1-P3 ----------------------------------------------------------------

FX7_SQL = f"""SELECT *, 1.0 AS k, 2 * l_quantity + 1 AS q2, -y AS y_neg,
  CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS big_a,
  CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END AS big_b
FROM ({INJECTED_NULLS_SQL})"""
FX7_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "k", "q2", "y_neg",
            "big_a", "big_b"]


def fx7(spark: SparkSession, sf: str) -> DataFrame:
    """FX7 on FX2: a constant, an exact copy (affine), a negated copy and a
    two-level indicator pair."""
    df = injected_nulls(spark, sf)
    big = F.col("l_quantity") > 25
    return df.withColumns({"k": F.lit(1.0), "q2": 2 * F.col("l_quantity") + 1,
                           "y_neg": -F.col("y"),
                           "big_a": F.when(big, 1.0).otherwise(0.0),
                           "big_b": F.when(big, 0.0).otherwise(1.0)})


@register("numeric_features", f"""
WITH t AS ({FX7_SQL})
SELECT column_name AS column, {R("null_rate")} AS null_rate, null_rate < 0.7 AS selected,
  lo = hi OR lo IS NULL OR coalesce(sd, 0) < 1e-12 AS is_constant
FROM (
  {" UNION ALL ".join(
      f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, "
      f"min({c}) AS lo, max({c}) AS hi, stddev_samp({c}) AS sd FROM t" for c in FX7_COLS)})""")
def numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    """P1 (numeric, null rate < 0.7) and P2 (constant) on FX7, from one
    aggregate of per-column statistics."""
    df = fx7(spark, sf)
    st = S.column_stats(df, FX7_COLS).first()
    sel = set(S.numeric_features(df.select(*FX7_COLS, "y"), "y",
                                 rates={c: st[f"{c}__null_rate"] for c in FX7_COLS}))
    const = set(S.constant_columns(df, FX7_COLS, st))
    rows = [(c, float(st[f"{c}__null_rate"]), c in sel, c in const) for c in FX7_COLS]
    base = spark.createDataFrame(rows, "column string, null_rate double, selected boolean, "
                                       "is_constant boolean")
    return base.select("column", r6("null_rate").alias("null_rate"), "selected", "is_constant")


DUP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "q2", "y_neg", "big_a", "big_b", "y"]


@register("duplicate_columns", f"""
WITH t AS ({FX7_SQL}),
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in DUP_COLS)} FROM t),
f AS (SELECT {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in DUP_COLS)} FROM t, m)
{" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS r, "
    f"abs(corr({a}, {b})) > 0.999 AS is_dup FROM f"
    for i, a in enumerate(DUP_COLS) for b in DUP_COLS[i + 1:])}""")
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P3 pair table: Pearson r of every pair after median fill (one Gram
    aggregate) and the |r| > 0.999 flag the greedy walk uses."""
    df = fx7(spark, sf)
    fills = A.medians(df, DUP_COLS)
    r, _ = S.corr_matrix_filled(df, DUP_COLS, fills)
    rows = [(a, b, float(r[i, j]), bool(abs(r[i, j]) > S.DUP_CORR_THRESH))
            for i, a in enumerate(DUP_COLS) for j, b in enumerate(DUP_COLS) if j > i]
    out = spark.createDataFrame(rows, "col_a string, col_b string, r double, is_dup boolean")
    return out.select("col_a", "col_b", r6("r").alias("r"), "is_dup")


def _walk_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS pa, {j} AS pb, abs(corr({a}, {b})) > 0.999 AS dup FROM f"
        for i, a in enumerate(DUP_COLS) for j, b in enumerate(DUP_COLS) if j > i)
    cols = ", ".join(f"({i}, '{c}')" for i, c in enumerate(DUP_COLS))
    return f"""
WITH t AS ({FX7_SQL}),
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in DUP_COLS)} FROM t),
f AS (SELECT {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in DUP_COLS)} FROM t, m),
p AS ({pairs}),
d1 AS (SELECT DISTINCT pb AS pos FROM p WHERE dup),
partner AS (SELECT pb AS pos, min(pa) AS pa FROM p
            WHERE dup AND pa NOT IN (SELECT pos FROM d1) GROUP BY pb),
cols AS (SELECT * FROM (VALUES {cols}) v(pos, name))
SELECT cols.name AS "column", partner.pa IS NULL AS kept, pn.name AS partner
FROM cols LEFT JOIN partner ON cols.pos = partner.pos LEFT JOIN cols pn ON pn.pos = partner.pa"""


@register("duplicate_columns_walk", _walk_sql())
def duplicate_columns_walk(spark: SparkSession, sf: str) -> DataFrame:
    """P3 decision: greedy walk in column order over the pair table."""
    df = fx7(spark, sf)
    fills = A.medians(df, DUP_COLS)
    rows = S.duplicate_columns(df, DUP_COLS, fills)
    return spark.createDataFrame(rows, "column string, kept boolean, partner string")


# ---- P4 / J7 --------------------------------------------------------------

FX15_SQL = ("SELECT p_partkey, p_retailprice, p_retailprice * 2 + p_size AS price2, "
            "p_size, CAST(p_partkey AS DOUBLE) AS partkey_num, p_retailprice * 0 AS zero FROM part")
FX15_COLS = ["price2", "p_size", "partkey_num", "zero"]


@register("top_k_by_corr", f"""
WITH t AS ({FX15_SQL}),
c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS pos, count({c}) AS n, stddev_pop({c}) AS sx, "
    f"stddev_pop(p_retailprice) AS sy, corr({c}, p_retailprice) AS r FROM t"
    for i, c in enumerate(FX15_COLS))}),
k AS (SELECT "column", pos, abs(r) AS ar FROM c
      WHERE n >= 2 AND sx >= 1e-12 AND sy >= 1e-12 AND NOT isnan(r)),
rk AS (SELECT "column", ar, row_number() OVER (ORDER BY ar DESC, pos) AS rnk FROM k)
SELECT c."column", {R("rk.ar")} AS abs_r, CAST(rk.rnk AS BIGINT) AS rank,
       coalesce(rk.rnk <= 2, false) AS selected
FROM c LEFT JOIN rk ON c."column" = rk."column"
""")
def top_k_by_corr(spark: SparkSession, sf: str) -> DataFrame:
    """P4 + J7 on FX15 (k = 2): |r| with the target over finite pairs; a
    constant column does not rank."""
    p = load(spark, sf, "part").select(
        "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("price2"),
        "p_size", F.col("p_partkey").cast("double").alias("partkey_num"),
        (F.col("p_retailprice") * 0).alias("zero"))
    st = S.target_corr(p, FX15_COLS, "p_retailprice").collect()
    top = set(S.top_k_by_corr(p, FX15_COLS, "p_retailprice", 2))
    ranked = []
    for r in sorted(st, key=lambda r: r["pos"]):
        ok = (r["n_pairs"] >= 2 and r["sx"] is not None and r["sx"] >= 1e-12
              and r["sy"] >= 1e-12 and r["r"] is not None and r["r"] == r["r"])
        ranked.append((r["column"], r["pos"], abs(r["r"]) if ok else None))
    order = sorted([t for t in ranked if t[2] is not None], key=lambda t: (-t[2], t[1]))
    rank = {c: i + 1 for i, (c, _, _) in enumerate(order)}
    rows = [(c, a, rank.get(c), c in top and c in rank) for c, _, a in ranked]
    out = spark.createDataFrame(rows, "column string, abs_r double, rank long, selected boolean")
    return out.select("column", r6("abs_r").alias("abs_r"), "rank", "selected")


# ---- P6 -------------------------------------------------------------------

def triage_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """FX3 + FX4 + FX5 on orders: numeric-like text (96 %), numeric-like text
    failing the 0.9 rule (80 %), date text, 5 and 3 levels, a boolean, a
    unique text."""
    o = dirty_numbers(spark, sf)
    o5 = dirty_numbers(spark, sf, 5).select("o_orderkey", F.col("cust_txt").alias("cust_txt5"))
    od = load(spark, sf, "orders")
    base = od.join(o.select("o_orderkey", "cust_txt"), "o_orderkey").join(o5, "o_orderkey")
    return base.select(
        "o_totalprice", "cust_txt", "cust_txt5",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("order_txt"),
        "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 100000).alias("big"),
        F.concat(F.lit("ord"), F.col("o_orderkey").cast("string")).alias("order_name"))


TRIAGE_COLS = ["cust_txt", "cust_txt5", "order_txt", "o_orderpriority", "o_orderstatus",
               "big", "order_name"]


def _triage_sql() -> str:
    num_re = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    sel = []
    for i, c in enumerate(TRIAGE_COLS):
        is_bool = c == "big"
        nr = "0.0" if is_bool else (
            f"avg(CASE WHEN regexp_matches(trim(CAST({c} AS varchar)), '{num_re}') "
            f"AND try_cast(trim(CAST({c} AS varchar)) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END)")
        dr = "0.0" if is_bool else (
            f"avg(CASE WHEN {dt_valid_sql(f'CAST({c} AS varchar)')} THEN 1.0 ELSE 0.0 END)")
        sel.append(f"SELECT '{c}' AS column, {i} AS pos, {str(is_bool).lower()} AS is_bool, "
                   f"{nr} AS numeric_rate, {dr} AS datetime_rate, "
                   f"count(DISTINCT coalesce(CAST({c} AS varchar), '__NaN__')) AS n_levels, "
                   f"count(*) AS n FROM t")
    fx = (f"""SELECT o.o_totalprice,
      CASE WHEN o.o_orderkey % 50 = 0 THEN concat(cast(o.o_custkey AS varchar), 'abc')
           WHEN o.o_orderkey % 50 = 1 THEN NULL ELSE cast(o.o_custkey AS varchar) END AS cust_txt,
      CASE WHEN o.o_orderkey % 5 = 0 THEN concat(cast(o.o_custkey AS varchar), 'abc')
           WHEN o.o_orderkey % 5 = 1 THEN NULL ELSE cast(o.o_custkey AS varchar) END AS cust_txt5,
      strftime(o.o_orderdate, '%Y-%m-%d %H:%M') AS order_txt, o.o_orderpriority,
      o.o_orderstatus, o.o_totalprice > 100000 AS big,
      concat('ord', cast(o.o_orderkey AS varchar)) AS order_name FROM orders o""")
    return f"""WITH t AS ({fx}), s AS ({" UNION ALL ".join(sel)})
SELECT "column", CASE
  WHEN is_bool THEN (CASE WHEN n_levels > greatest(1, floor(n * 0.5)) THEN 'drop'
                          WHEN n_levels <= 10 THEN 'onehot' ELSE 'target' END)
  WHEN numeric_rate >= 0.9 THEN 'numeric'
  WHEN datetime_rate >= 0.9 THEN 'datetime'
  WHEN n_levels > greatest(1, floor(n * 0.5)) THEN 'drop'
  WHEN n_levels <= 10 THEN 'onehot' ELSE 'target' END AS decision,
  {R("numeric_rate")} AS numeric_rate, {R("datetime_rate")} AS datetime_rate,
  CAST(n_levels AS BIGINT) AS n_levels
FROM s"""


@register("triage_columns", _triage_sql())
def triage_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P6 with X1, X2, X10: decision per non-numeric column from one aggregate."""
    df = triage_fixture(spark, sf)
    t = S.triage_columns(df, "o_totalprice", TRIAGE_COLS)
    return t.select("column", "decision", r6("numeric_rate").alias("numeric_rate"),
                    r6("datetime_rate").alias("datetime_rate"), "n_levels")


_ = (dirty_numbers_sql, md5_order)
