"""Queries: profiles for what-if views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import profile as D
from ..session import load
from . import register
from .fixtures import sig_sql


def R(x: str) -> str:
    return f"round(({x}) + 3e-9, 6)"


PROFILE_COLS = [("events", "value"), ("events", "user_id"), ("part", "p_size"),
                ("part", "p_retailprice")]


def _hi(lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + greatest(abs({lo}) * 1e-6, 1e-6) END"


def _step_sql(x: str) -> str:
    e = f"pow(10.0, floor(log10({x})))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE round_even({x} / {e}, 0) * {e} END"


def _profile_sql() -> str:
    parts = []
    for t, c in PROFILE_COLS:
        v = f"CAST({c} AS DOUBLE)"
        hi = _hi(f"min({v})", f"max({v})")
        parts.append(
            f"SELECT '{t}.{c}' AS column, {sig_sql(f'quantile_cont({v}, 0.01)', 12)} AS p1, "
            f"{sig_sql(f'quantile_cont({v}, 0.5)', 12)} AS median, "
            f"{sig_sql(f'quantile_cont({v}, 0.99)', 12)} AS p99, {sig_sql(f'min({v})', 12)} AS min, "
            f"{sig_sql(hi, 12)} AS max, "
            f"min(CASE WHEN {v} % 1 = 0 THEN 1 ELSE 0 END) = 1 AS is_integer, "
            f"CASE WHEN min(CASE WHEN {v} % 1 = 0 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE "
            f"{_step_sql(f'(({hi}) - min({v})) / 300.0')} END AS step FROM {t}")
    return " UNION ALL ".join(parts)


@register("profile_numeric", _profile_sql())
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """D1 summaries: percentiles, range, integer flag, slider step."""
    out = None
    for t, c in PROFILE_COLS:
        df = load(spark, sf, t).select(F.col(c).alias(f"{t}.{c}"))
        q = D.numeric_profile(df, [f"`{t}.{c}`"]).withColumn("column", F.lit(f"{t}.{c}"))
        out = q if out is None else out.unionByName(q)
    return out.drop("x_clip_lo", "x_clip_hi")


def _hist_sql() -> str:
    parts = []
    for t, c in PROFILE_COLS:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{t}.{c}' AS \"column\", CAST(least(floor((v - lo) / (hi - lo) * 28), 27) AS INTEGER)"
            f" AS bin, count(*) AS n FROM (SELECT {v} AS v FROM {t}) x, "
            f"(SELECT min({v}) AS lo, {_hi(f'min({v})', f'max({v})')} AS hi FROM {t}) r "
            f"GROUP BY ALL")
    return ("SELECT \"column\", bin, CAST(n AS BIGINT) AS count FROM (" + " UNION ALL ".join(parts)
            + ")")


@register("profile_histograms", _hist_sql())
def profile_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """D1 histograms: 28 equal bins per column, one grouped count over the
    unpivoted columns of each table."""
    out = None
    for t in ("events", "part"):
        cols = [c for tt, c in PROFILE_COLS if tt == t]
        df = load(spark, sf, t)
        h = D.numeric_histograms(df, cols).select(
            F.concat(F.lit(f"{t}."), F.col("column")).alias("column"), "bin", "count")
        out = h if out is None else out.unionByName(h)
    return out


@register("profile_levels", """
WITH g AS (SELECT 'p_brand' AS "column", coalesce(p_brand, '__NaN__') AS value, count(*) AS n
           FROM part GROUP BY 2
           UNION ALL SELECT 'p_name', coalesce(p_name, '__NaN__'), count(*) FROM part GROUP BY 2
           UNION ALL SELECT 'event_type', coalesce(event_type, '__NaN__'), count(*)
           FROM events GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
             count(*) OVER (PARTITION BY "column") AS nl FROM g)
SELECT "column", value, CAST(n AS BIGINT) AS count, CAST(rank AS INTEGER) AS rank,
       rank = 1 AS is_mode, nl > 30 AS truncated FROM r WHERE rank <= 30""")
def profile_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level counts, mode, top 30 with the truncated flag (p_name has 64
    levels, p_brand 25, event_type 5)."""
    p = load(spark, sf, "part")
    e = load(spark, sf, "events")
    out = D.level_profile(p, "p_brand").unionByName(D.level_profile(p, "p_name")) \
        .unionByName(D.level_profile(e, "event_type"))
    return out.select("column", "value", F.col("count").cast("long"), F.col("rank").cast("int"),
                      "is_mode", "truncated")


@register("target_histogram", f"""
WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents),
s AS (SELECT count(*) AS n, min(v) AS lo, {_hi('min(v)', 'max(v)')} AS hi,
        quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
        quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90
      FROM t),
b AS (SELECT *, CAST(CASE WHEN 2.0 * (q3 - q1) / pow(n, 1.0 / 3.0) > 0 THEN
        least(40, greatest(10, ceil((hi - lo) / (2.0 * (q3 - q1) / pow(n, 1.0 / 3.0)))))
        ELSE 20 END AS INTEGER) AS n_bins FROM s)
SELECT CAST(least(floor((t.v - b.lo) / (b.hi - b.lo) * b.n_bins), b.n_bins - 1) AS INTEGER) AS bin,
  CAST(count(*) AS BIGINT) AS count, any_value(b.n_bins) AS n_bins,
  {R("any_value(b.p10)")} AS p10, {R("any_value(b.p50)")} AS p50, {R("any_value(b.p90)")} AS p90
FROM t, b GROUP BY 1""")
def target_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """D3 on documents.n_chars: Freedman-Diaconis bins, counts, p10/p50/p90."""
    d = load(spark, sf, "documents")
    summary, counts = D.target_histogram(d, "n_chars")
    return counts.crossJoin(summary).select(
        "bin", F.col("count").cast("long"), "n_bins", r6("p10").alias("p10"),
        r6("p50").alias("p50"), r6("p90").alias("p90"))


@register("seed_rows", """
WITH t AS (SELECT o_orderkey, o_totalprice AS y FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY y, md5(concat('42|', cast(o_orderkey AS varchar))),
                                   o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM t)
SELECT CASE WHEN rk = round_even((n - 1) * 0.1, 0) THEN 'low'
            WHEN rk = round_even((n - 1) * 0.5, 0) THEN 'median' ELSE 'high' END AS label,
       o_orderkey, y FROM r
WHERE rk IN (round_even((n - 1) * 0.1, 0), round_even((n - 1) * 0.5, 0),
             round_even((n - 1) * 0.9, 0))
UNION ALL
SELECT * FROM (SELECT 'random', o_orderkey, y FROM t
  ORDER BY md5(concat('42|', cast(o_orderkey AS varchar))), o_orderkey LIMIT 1)""")
def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """D4 on orders (y = o_totalprice): low / median / high real rows."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    s = D.seed_rows(o, "y", "o_orderkey")
    return s.select("label", "o_orderkey", "y")


EMB_D = 64


def _emb(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                for i in range(EMB_D)])


def _neighbor_sql(count_mode: bool, whole: bool = False) -> str:
    cols = [f"e{i}" for i in range(EMB_D)]
    sel = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_D))
    stats = ", ".join(f"avg(e{i}) AS m{i}, CASE WHEN stddev_pop(e{i}) >= 1e-12 THEN "
                      f"stddev_pop(e{i}) ELSE 1.0 END AS s{i}" for i in range(EMB_D))
    z = ", ".join(f"(e{i} - m{i}) / s{i} AS e{i}" for i in range(EMB_D))
    dist = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(EMB_D))
    ref = "ref AS (SELECT * FROM rk)" if whole else """\
ref AS (SELECT rk.* EXCLUDE (pos), CAST(pos // CAST(ceil(n / 300.0) AS BIGINT) AS BIGINT) AS pos
        FROM rk, st WHERE n <= 300 OR pos % CAST(ceil(n / 300.0) AS BIGINT) = 0)"""
    head = f"""
WITH t AS (SELECT vec_id, {sel} FROM embeddings),
c AS (SELECT * FROM t WHERE {" AND ".join(f"{c} IS NOT NULL" for c in cols)}),
st AS (SELECT count(*) AS n, {stats} FROM c),
z AS (SELECT vec_id, {z} FROM c, st),
rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', cast(vec_id AS varchar))), vec_id) - 1
       AS pos FROM z),
{ref},
nr AS (SELECT count(*) AS n_ref FROM ref),
pairs AS (SELECT a.pos AS probe, b.pos AS other, sqrt(greatest({dist}, 0)) AS d
          FROM ref a, ref b WHERE a.pos < 120),
kth AS (SELECT probe, d, row_number() OVER (PARTITION BY probe ORDER BY d) - 1 AS r FROM pairs),
rad AS (SELECT CASE WHEN median(d) > 0 THEN median(d) ELSE 1.0 END AS radius, count(*) AS n_probes
        FROM kth, nr WHERE r = least(10, n_ref - 1))"""
    if not count_mode:
        return head + f"\nSELECT {R('radius')} AS radius, CAST(n_probes AS BIGINT) AS n_probes FROM rad"
    return head + """
SELECT probe AS point, CAST(sum(CASE WHEN d <= radius THEN 1 ELSE 0 END) AS BIGINT) AS n_within
FROM pairs, rad GROUP BY probe"""


def _radius(spark, sf, max_rows) -> DataFrame:
    cols = [f"e{i}" for i in range(EMB_D)]
    ref, w, n_ref = D.neighbor_reference(_emb(spark, sf), cols, "vec_id", max_rows=max_rows)
    r = D.neighbor_radius(ref.cache(), cols, w, n_ref)
    return r.select(r6("radius").alias("radius"), F.col("n_probes").cast("long"))


def _within(spark, sf, max_rows) -> DataFrame:
    cols = [f"e{i}" for i in range(EMB_D)]
    ref, w, n_ref = D.neighbor_reference(_emb(spark, sf), cols, "vec_id", max_rows=max_rows)
    ref = ref.cache()
    radius = D.neighbor_radius(ref, cols, w, n_ref).first()["radius"]
    points = ref.filter(F.col("_pos") < D.NEIGHBOR_PROBES).select(
        F.col("_pos").alias("point"), *cols)
    return D.neighbor_count(ref, points, cols, w, radius)


@register("neighbor_radius", _neighbor_sql(False))
def neighbor_radius(spark: SparkSession, sf: str) -> DataFrame:
    """D5 on FX14 (embeddings, 64 dims): standardised complete rows strided to
    <= 300 in md5 order, radius = median over 120 probes of the distance to
    the 10th neighbour."""
    return _radius(spark, sf, D.NEIGHBOR_ROWS)


@register("neighbor_count", _neighbor_sql(True))
def neighbor_count(spark: SparkSession, sf: str) -> DataFrame:
    """Reference rows within the D5 radius of each probe point."""
    return _within(spark, sf, D.NEIGHBOR_ROWS)


@register("neighbor_radius_all", _neighbor_sql(False, whole=True))
def neighbor_radius_all(spark: SparkSession, sf: str) -> DataFrame:
    """D5 with every complete row as reference: 120 probes go to the rows."""
    return _radius(spark, sf, None)


@register("neighbor_count_all", _neighbor_sql(True, whole=True))
def neighbor_count_all(spark: SparkSession, sf: str) -> DataFrame:
    """D6 with every complete row as reference."""
    return _within(spark, sf, None)


CORR_COLS = ["p_retailprice", "price2", "partkey_num", "p_size"]
CORR_SQL_BASE = ("SELECT p_retailprice, p_retailprice * 2 + p_size AS price2, "
                 "CAST(p_partkey AS DOUBLE) AS partkey_num, CAST(p_size AS DOUBLE) AS p_size FROM part")


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            cov, va, vb = f"covar_pop({a}, {b})", f"var_pop({a})", f"var_pop({b})"
            sab, sba = f"({cov} / greatest({va}, 1e-12))", f"({cov} / greatest({vb}, 1e-12))"
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, {cov} / sqrt({va} * {vb}) AS rr, "
                f"{sab} AS s_ab, avg({b}) - {sab} * avg({a}) AS i_ab, {sba} AS s_ba, "
                f"avg({a}) - {sba} * avg({b}) AS i_ba, "
                f"sqrt(greatest({va} - 2 * {sba} * {cov} + {sba} * {sba} * {vb}, 0)) AS sd_a, "
                f"sqrt(greatest({vb} - 2 * {sab} * {cov} + {sab} * {sab} * {va}, 0)) AS sd_b "
                f"FROM c HAVING sqrt({va}) >= 1e-12 AND sqrt({vb}) >= 1e-12")
    return (f"WITH c AS ({CORR_SQL_BASE}) SELECT a, b, round(rr, 3) AS r, "
            + ", ".join(f"{R(x)} AS {x}" for x in ("s_ab", "i_ab", "s_ba", "i_ba", "sd_a", "sd_b"))
            + " FROM (" + " UNION ALL ".join(parts) + ") WHERE abs(rr) >= 0.7")


@register("correlated_pairs", _corr_sql())
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """D7 on FX15: strongly correlated pairs with both regression lines and
    residual RMSE, from one Gram aggregate."""
    p = load(spark, sf, "part").select(
        "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("price2"),
        F.col("p_partkey").cast("double").alias("partkey_num"), F.col("p_size").cast("double"))
    rows = D.correlated_pairs(p, CORR_COLS)
    df = spark.createDataFrame(
        [(a, b, float(r), *[float(x) for x in (s1, i1, s2, i2, d1, d2)])
         for a, b, r, _, s1, i1, s2, i2, d1, d2 in rows],
        "a string, b string, r double, s_ab double, i_ab double, s_ba double, i_ba double, "
        "sd_a double, sd_b double")
    return df.select("a", "b", "r", *[r6(c).alias(c) for c in
                                      ("s_ab", "i_ab", "s_ba", "i_ba", "sd_a", "sd_b")])
