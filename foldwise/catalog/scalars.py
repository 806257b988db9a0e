"""Queries: scalar functions, guards and per-column statistics (S5, F2-F5, F9,
X1-X17, A1-A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import r6
from ..operators import select as S
from ..operators import stats as A
from ..operators.quantiles import quantiles_of
from ..session import load
from . import register
from .fixtures import (DATE_LITERALS, INJECTED_NULLS_SQL, NET_CHARGE_SQL, NONFINITE_SQL,
                       OUTLIERS_SQL, date_text, date_text_sql, dirty_numbers,
                       dirty_numbers_sql, injected_nulls, net_charge, nonfinite, outliers)


def R(x: str) -> str:
    """Oracle-side report rounding, same as ``r6``."""
    return f"round(({x}) + 3e-9, 6)"


# ---- S5 / X17 -------------------------------------------------------------

@register("normalize_missing", f"""
SELECT event_id, {R("CASE WHEN isnan(y) OR isinf(y) THEN NULL ELSE y END")} AS y
FROM ({NONFINITE_SQL})""")
def normalize_missing(spark: SparkSession, sf: str) -> DataFrame:
    df = S.normalize_missing(nonfinite(spark, sf))
    return df.select("event_id", r6("y").alias("y"))


# ---- F2-F5 ----------------------------------------------------------------

@register("nonfinite_target", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_non_numeric,
       CAST(sum(CASE WHEN isnan(y) OR isinf(y) THEN 1 ELSE 0 END) AS BIGINT) AS n_nonfinite,
       CAST(sum(CASE WHEN y IS NULL OR isnan(y) OR isinf(y) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_missing,
       min(CASE WHEN NOT (isnan(y) OR isinf(y)) THEN y END)
         < max(CASE WHEN NOT (isnan(y) OR isinf(y)) THEN y END) AS varying
FROM ({NONFINITE_SQL})""")
def nonfinite_target(spark: SparkSession, sf: str) -> DataFrame:
    return S.target_checks(nonfinite(spark, sf), "y").drop("non_numeric_example")


NUM_RE_SQL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


@register("target_numeric_check", f"""
WITH t AS ({dirty_numbers_sql(50)}),
c AS (SELECT cust_txt, CASE WHEN regexp_matches(trim(cust_txt), '{NUM_RE_SQL}')
                            THEN try_cast(trim(cust_txt) AS DOUBLE) END AS v FROM t)
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN cust_txt IS NOT NULL AND v IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS n_non_numeric,
       min(CASE WHEN cust_txt IS NOT NULL AND v IS NULL THEN cust_txt END)
         AS non_numeric_example,
       CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM c""")
def target_numeric_check(spark: SparkSession, sf: str) -> DataFrame:
    """the target text column of FX3 is not numeric; report the count and
    the smallest offending example (deterministic 'first')."""
    r = S.target_checks(dirty_numbers(spark, sf), "cust_txt")
    return r.select("n_rows", "n_non_numeric", "non_numeric_example", "n_missing")


@register("drop_missing_target", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       CAST(count(l_tax) AS BIGINT) AS n_kept,
       {R("sum(l_tax)")} AS sum_kept
FROM ({INJECTED_NULLS_SQL})""")
def drop_missing_target(spark: SparkSession, sf: str) -> DataFrame:
    df = injected_nulls(spark, sf)
    kept = S.drop_missing_target(df, "l_tax")
    a = df.agg(F.count(F.lit(1)).alias("n_rows"))
    b = kept.agg(F.count(F.lit(1)).alias("n_kept"), r6(F.sum("l_tax")).alias("sum_kept"))
    return a.crossJoin(b).select("n_rows", (F.col("n_rows") - F.col("n_kept")).alias("n_dropped"),
                                 "n_kept", "sum_kept")


@register("integer_target", """
SELECT 'n_chars' AS target, min(CASE WHEN n_chars % 1 = 0 THEN 1 ELSE 0 END) = 1 AS is_integer
FROM documents
UNION ALL SELECT 'p_size', min(CASE WHEN p_size % 1 = 0 THEN 1 ELSE 0 END) = 1 FROM part
UNION ALL SELECT 'p_retailprice', min(CASE WHEN p_retailprice % 1 = 0 THEN 1 ELSE 0 END) = 1
FROM part""")
def integer_target(spark: SparkSession, sf: str) -> DataFrame:
    """F9 on FX11 (n_chars, p_size) and a non-integer control."""
    d = load(spark, sf, "documents").agg(S.is_integer_valued("n_chars").alias("is_integer")) \
        .select(F.lit("n_chars").alias("target"), "is_integer")
    p = load(spark, sf, "part")
    a = p.agg(S.is_integer_valued("p_size").alias("is_integer")) \
        .select(F.lit("p_size").alias("target"), "is_integer")
    b = p.agg(S.is_integer_valued("p_retailprice").alias("is_integer")) \
        .select(F.lit("p_retailprice").alias("target"), "is_integer")
    return d.unionByName(a).unionByName(b)


# ---- X1 -------------------------------------------------------------------

NUMBER_EDGE = ["1d", "1f", "1_000", "0x10", "TRUE", " 12 ", "1e5", ".5", "-3.", "+7",
               "inf", "nan", "12abc", "1.5e-3", ""]


def _edge_sql(vals, col="cust_txt") -> str:
    rows = ", ".join(f"(-{i + 1}, {v!r})" for i, v in enumerate(vals))
    return f"SELECT * FROM (VALUES {rows}) t(o_orderkey, {col})"


@register("to_number", f"""
WITH t AS (SELECT o_orderkey, cust_txt FROM ({dirty_numbers_sql(50)})
           UNION ALL {_edge_sql(NUMBER_EDGE)})
SELECT o_orderkey, cust_txt,
       CASE WHEN regexp_matches(trim(cust_txt), '{NUM_RE_SQL}')
                 AND NOT isinf(try_cast(trim(cust_txt) AS DOUBLE))
            THEN try_cast(trim(cust_txt) AS DOUBLE) END AS num
FROM t""")
def to_number(spark: SparkSession, sf: str) -> DataFrame:
    """X1 over FX3 plus fixed edge texts."""
    d = dirty_numbers(spark, sf).select("o_orderkey", "cust_txt")
    e = spark.createDataFrame([(-(i + 1), v) for i, v in enumerate(NUMBER_EDGE)],
                              "o_orderkey long, cust_txt string")
    return d.unionByName(e).select("o_orderkey", "cust_txt",
                                   X.to_number("cust_txt").alias("num"))


# ---- X2-X6 / J6 -----------------------------------------------------------

DT_RE_SQL = (r"^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|/([0-9]{2})/([0-9]{2}))"
             r"(?:[ T]?([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?$")

DATE_PARTS_SQL = f"""
WITH t AS ({date_text_sql()}),
g AS (SELECT key, trim(txt) AS s, regexp_matches(trim(txt), '{DT_RE_SQL}') AS ok FROM t),
p AS (SELECT key, ok,
        try_cast(regexp_extract(s, '{DT_RE_SQL}', 1) AS INTEGER) AS y,
        try_cast(coalesce(nullif(regexp_extract(s, '{DT_RE_SQL}', 2), ''),
                          regexp_extract(s, '{DT_RE_SQL}', 4)) AS INTEGER) AS m,
        try_cast(coalesce(nullif(regexp_extract(s, '{DT_RE_SQL}', 3), ''),
                          regexp_extract(s, '{DT_RE_SQL}', 5)) AS INTEGER) AS d,
        coalesce(try_cast(nullif(regexp_extract(s, '{DT_RE_SQL}', 6), '') AS INTEGER), 0) AS hh,
        coalesce(try_cast(nullif(regexp_extract(s, '{DT_RE_SQL}', 7), '') AS INTEGER), 0) AS mi
      FROM g),
v AS (SELECT *, coalesce(ok AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND hh <= 23
                 AND mi <= 59 AND d <= [31,29,31,30,31,30,31,31,30,31,30,31][m], false) AS valid
      FROM p),
e AS (SELECT key, valid, hh, m,
        CASE WHEN valid THEN date_diff('day', DATE '1970-01-01', make_date(y, m, 1)) + d - 1
        END AS days FROM v)
SELECT key,
  CASE WHEN valid THEN CAST(hh AS DOUBLE) END AS hour,
  CASE WHEN valid THEN CAST(((days + 3) % 7 + 7) % 7 AS DOUBLE) END AS dow,
  CASE WHEN valid THEN CAST(m AS DOUBLE) END AS month,
  CASE WHEN valid THEN CAST(days AS DOUBLE) END AS epoch_days
FROM e"""


@register("date_parts", DATE_PARTS_SQL)
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """FX4 (event times as text + edge literals) to four parts."""
    df = date_text(spark, sf)
    p = X.datetime_parts("txt")
    return df.select("key", *[p.getField(n).alias(n) for n in X.DATE_PART_NAMES])


# ---- X9 / X16 -------------------------------------------------------------

def _sig_sql(x: str, sig: int) -> str:
    e = f"pow(10.0, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round({x} / {e}, {sig - 1}) * {e} END"


@register("round_half_away", f"""
SELECT key, round(y) AS y_round, round(-y) AS neg_round,
       {R(_sig_sql('y', 12))} AS y_sig12,
       {R(_sig_sql('y', 3))} AS y_sig3,
       CASE WHEN y <= 0 THEN 1.0 ELSE
         round_even(y / pow(10.0, floor(log10(y))), 0) * pow(10.0, floor(log10(y))) END
         AS y_step
FROM ({NET_CHARGE_SQL})""")
def round_half_away(spark: SparkSession, sf: str) -> DataFrame:
    """X9 (half away from zero) and X16 (significant digits, slider step)."""
    df = net_charge(spark, sf)
    return df.select("key", X.round_half_away("y").alias("y_round"),
                     X.round_half_away(-F.col("y")).alias("neg_round"),
                     r6(X.round_sig("y", 12)).alias("y_sig12"),
                     r6(X.round_sig("y", 3)).alias("y_sig3"),
                     X.round_sig1("y").alias("y_step"))


# ---- X11-X13 --------------------------------------------------------------

def _yj_sql(x: str, lam: float) -> str:
    pos = f"ln(1 + {x})" if abs(lam) < 1e-6 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    neg = (f"-ln(1 - {x})" if abs(lam - 2) < 1e-6
           else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}")
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def _yj_inv_sql(y: str, lam: float) -> str:
    pos = (f"exp({y}) - 1" if abs(lam) < 1e-6
           else f"pow(greatest({y} * {lam} + 1, 1e-12), {1 / lam}) - 1")
    neg = (f"1 - exp(-{y})" if abs(lam - 2) < 1e-6
           else f"1 - pow(greatest(-{2 - lam} * {y} + 1, 1e-12), {1 / (2 - lam)})")
    return f"CASE WHEN {y} >= 0 THEN {pos} ELSE {neg} END"


YJ_LAMBDAS = (0.0, 0.5, 2.0, -1.5)


@register("yeo_johnson", f"""
SELECT c_custkey, {R("ln(1 + greatest(c_acctbal, 0))")} AS log1p_pos,
  {", ".join(f"{R(_yj_sql('x', l))} AS yj_{i}, {R(_yj_inv_sql(_yj_sql('x', l), l))} AS inv_{i}"
             for i, l in enumerate(YJ_LAMBDAS))}
FROM (SELECT c_custkey, c_acctbal, c_acctbal / 1000.0 AS x FROM customer)""")
def yeo_johnson(spark: SparkSession, sf: str) -> DataFrame:
    """X11-X13 on customer balances (both signs), several lambdas, round trip."""
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal",
                                           (F.col("c_acctbal") / 1000.0).alias("x"))
    cols = [r6(X.log1p_safe(F.greatest("c_acctbal", F.lit(0.0)))).alias("log1p_pos")]
    for i, lam in enumerate(YJ_LAMBDAS):
        f = X.yeo_johnson("x", lam)
        cols += [r6(f).alias(f"yj_{i}"), r6(X.yeo_johnson_inverse(f, lam)).alias(f"inv_{i}")]
    return c.select("c_custkey", *cols)


@register("log1p_roundtrip", f"""
SELECT key, {R("ln(1 + y)")} AS ly, {R("exp(ln(1 + y)) - 1")} AS back
FROM ({NET_CHARGE_SQL})""")
def log1p_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = net_charge(spark, sf)
    ly = X.log1p_safe("y")
    return df.select("key", r6(ly).alias("ly"), r6(X.expm1(ly)).alias("back"))


# ---- A3-A5 / X14 ----------------------------------------------------------

@register("clip_percentile", f"""
WITH t AS ({OUTLIERS_SQL}),
q AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi,
             quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM t),
m AS (SELECT * FROM (VALUES (3.0), (4.5)) v(mult))
SELECT m.mult, {R("q.lo")} AS clip_lo, {R("q.hi")} AS clip_hi,
       {R("q.q1 - m.mult * (q.q3 - q.q1)")} AS win_lo,
       {R("q.q3 + m.mult * (q.q3 - q.q1)")} AS win_hi,
       CAST(sum(CASE WHEN t.y < q.q1 - m.mult * (q.q3 - q.q1)
                       OR t.y > q.q3 + m.mult * (q.q3 - q.q1) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_changed,
       {R('''sum(CASE WHEN t.y < q.q1 - m.mult * (q.q3 - q.q1) THEN q.q1 - m.mult * (q.q3 - q.q1)
                 WHEN t.y > q.q3 + m.mult * (q.q3 - q.q1) THEN q.q3 + m.mult * (q.q3 - q.q1)
                 ELSE t.y END)''')} AS sum_winsorized,
       {R("sum(CASE WHEN t.y < q.lo THEN q.lo WHEN t.y > q.hi THEN q.hi ELSE t.y END)")}
         AS sum_clipped
FROM t, q, m GROUP BY m.mult, q.lo, q.hi, q.q1, q.q3""")
def clip_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """A3 (1 %/99 % clip bounds), A4/A5 (IQR winsor at 3.0 and 4.5), X14."""
    df = outliers(spark, sf).cache()
    lo, hi = A.clip_bounds(df, ["y"])["y"]
    rows = []
    for mult in (3.0, 4.5):
        wl, wh = A.iqr_bounds(df, "y", mult)
        w, changed = A.winsorize(df, "y", wl, wh, out="yw")
        agg = w.agg(changed.cast("long").alias("n_changed"),
                    r6(F.sum("yw")).alias("sum_winsorized"),
                    r6(F.sum(X.clip("y", lo, hi))).alias("sum_clipped"))
        rows.append(agg.select(F.lit(mult).alias("mult"), r6(F.lit(lo)).alias("clip_lo"),
                               r6(F.lit(hi)).alias("clip_hi"), r6(F.lit(wl)).alias("win_lo"),
                               r6(F.lit(wh)).alias("win_hi"), "n_changed", "sum_winsorized",
                               "sum_clipped"))
    return rows[0].unionByName(rows[1])


# ---- A1/A2, A6-A8 ---------------------------------------------------------

@register("impute_median", f"""
WITH t AS ({INJECTED_NULLS_SQL}),
m AS (SELECT median(l_discount) AS md, median(l_tax) AS mt FROM t)
SELECT {R("any_value(m.md)")} AS med_discount, {R("any_value(m.mt)")} AS med_tax,
       {R("sum(coalesce(l_discount, m.md))")} AS sum_discount_filled,
       {R("sum(coalesce(l_tax, m.mt))")} AS sum_tax_filled,
       CAST(count(*) - count(l_tax) AS BIGINT) AS n_tax_filled
FROM t, m""")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """A1/A2 on FX2 (nulls injected, 75 % missing tax)."""
    df = injected_nulls(spark, sf)
    med = A.medians(df, ["l_discount", "l_tax"])
    filled = A.impute(df.select("l_discount", "l_tax"), med)
    return filled.agg(r6(F.lit(med["l_discount"])).alias("med_discount"),
                      r6(F.lit(med["l_tax"])).alias("med_tax"),
                      r6(F.sum("l_discount")).alias("sum_discount_filled"),
                      r6(F.sum("l_tax")).alias("sum_tax_filled")).crossJoin(
        df.agg((F.count(F.lit(1)) - F.count("l_tax")).cast("long").alias("n_tax_filled")))


@register("scalers_skewness", """
SELECT event_type,
  round(avg(value) + 3e-9, 6) AS mean,
  round(greatest(stddev_pop(value), 1e-8) + 3e-9, 6) AS std_pop,
  round(median(value) + 3e-9, 6) AS median,
  round(greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-8) + 3e-9, 6)
    AS iqr,
  round(CASE WHEN stddev_pop(value) < 1e-12 THEN 0.0 ELSE
    (avg(value * value * value) - 3 * avg(value) * avg(value * value)
     + 2 * avg(value) * avg(value) * avg(value)) / pow(stddev_pop(value), 3) END + 3e-9, 6)
    AS skewness
FROM events GROUP BY event_type""")
def scalers_skewness(spark: SparkSession, sf: str) -> DataFrame:
    """A6 (population skewness), A7 (standard scale, population std floored
    at 1e-8), A8 (robust scale: median, IQR floored at 1e-8) per event type."""
    ev = load(spark, sf, "events")
    types = [r[0] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]     # five levels
    number = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type"))
    found = quantiles_of(ev.withColumn("_t", number), ["value"], [0.25, 0.5, 0.75], "_t")
    q = F.array(*[F.array(*[F.lit(v) for v in found[k + 1]["value"]]) for k in range(len(types))])
    g = ev.groupBy("event_type").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        A.skewness_pop("value").alias("skewness")).withColumn("q", F.element_at(q, number.cast("int")))
    return g.select("event_type", r6("mean").alias("mean"),
                    r6(F.greatest("sd", F.lit(1e-8))).alias("std_pop"),
                    r6(F.col("q")[1]).alias("median"),
                    r6(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-8))).alias("iqr"),
                    r6("skewness").alias("skewness"))


_ = DATE_LITERALS
