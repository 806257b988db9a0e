"""Derived inputs (FIXTURES.md section 3) built from the driver tables, with
the matching DuckDB SQL text for the oracle side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_expr, key_sql
from ..session import load

NET_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def net_charge(spark: SparkSession, sf: str) -> DataFrame:
    """FX1: lineitem with key and y = net charge."""
    li = load(spark, sf, "lineitem")
    return li.select(key_expr("lineitem").alias("key"), *NET_FEATURES,
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))
                      * (1 + F.col("l_tax"))).alias("y"))


NET_CHARGE_SQL = (
    f"SELECT {key_sql('lineitem')} AS key, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem")


def injected_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """FX2: lineitem with nulls injected into two columns."""
    li = load(spark, sf, "lineitem")
    return li.select(
        key_expr("lineitem").alias("key"), "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_discount"))
         .alias("l_discount"),
        F.when(F.col("l_orderkey") % 4 != 0, F.lit(None)).otherwise(F.col("l_tax"))
         .alias("l_tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"))


INJECTED_NULLS_SQL = (
    f"SELECT {key_sql('lineitem')} AS key, l_quantity, l_extendedprice, "
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount, "
    "CASE WHEN l_orderkey % 4 <> 0 THEN NULL ELSE l_tax END AS l_tax, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem")


def outliers(spark: SparkSession, sf: str) -> DataFrame:
    """FX10: events value with every 500th event scaled by 100."""
    ev = load(spark, sf, "events")
    return ev.select(F.col("event_id").cast("string").alias("key"), "event_id", "event_type",
                     F.when(F.col("event_id") % 500 == 0, F.col("value") * 100)
                      .otherwise(F.col("value")).alias("y"))


OUTLIERS_SQL = ("SELECT cast(event_id AS varchar) AS key, event_id, event_type, "
                "CASE WHEN event_id % 500 = 0 THEN value * 100 ELSE value END AS y FROM events")


def nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    """FX12: events value with NaN and +inf injected."""
    ev = load(spark, sf, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 89 == 0, F.lit(float("inf")))
         .otherwise(F.col("value")).alias("y"))


NONFINITE_SQL = ("SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'NaN'::double "
                 "WHEN event_id % 89 = 0 THEN 'inf'::double ELSE value END AS y FROM events")


def dirty_numbers(spark: SparkSession, sf: str, mod: int = 50) -> DataFrame:
    """FX3: customer key text with 2 % junk and 2 % missing."""
    o = load(spark, sf, "orders")
    s = F.col("o_custkey").cast("string")
    return o.select("o_orderkey", "o_totalprice",
                    F.when(F.col("o_orderkey") % mod == 0, F.concat(s, F.lit("abc")))
                     .when(F.col("o_orderkey") % mod == 1, F.lit(None).cast("string"))
                     .otherwise(s).alias("cust_txt"))


def dirty_numbers_sql(mod: int = 50) -> str:
    return ("SELECT o_orderkey, o_totalprice, "
            f"CASE WHEN o_orderkey % {mod} = 0 THEN concat(cast(o_custkey AS varchar), 'abc') "
            f"WHEN o_orderkey % {mod} = 1 THEN NULL ELSE cast(o_custkey AS varchar) END AS cust_txt "
            "FROM orders")


def date_text(spark: SparkSession, sf: str) -> DataFrame:
    """FX4: event times as text plus the edge-case literals."""
    ev = load(spark, sf, "events")
    txt = ev.select(F.col("event_id").cast("string").alias("key"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm").alias("txt"))
    lits = spark.createDataFrame(
        [(f"lit{i}", v) for i, v in enumerate(DATE_LITERALS)], "key string, txt string")
    return txt.unionByName(lits)


# fixed edge-case texts (valid and invalid by the date rule)
DATE_LITERALS = ["2023-02-29", "2024/01/05T10:30", "2024-01/05", "2024-13-01",
                 "2024-01-05 25:00", "2024-01-05 10:30:99", " 1970-01-01 ",
                 "2024-04-31", "1969-12-31 23:59", "2000-02-29T00:00:00", "abc", None]


def date_text_sql() -> str:
    vals = ", ".join(
        f"('lit{i}', {('NULL' if v is None else repr(v))})" for i, v in enumerate(DATE_LITERALS))
    return ("SELECT cast(event_id AS varchar) AS key, strftime(ts, '%Y-%m-%d %H:%M') AS txt "
            f"FROM events UNION ALL SELECT * FROM (VALUES {vals}) t(key, txt)")


def folds_sql(base_sql: str, n_bins: int = 5, k: int = 5, seed: int = 42,
              y: str = "y", key: str = "key") -> str:
    """DuckDB text of the stratified fold assignment (V1 + V2) over
    ``base_sql``: adds ``bin`` and ``fold``. Bin and fold counts are the
    values the rules give for the fixture (checked by the Spark side)."""
    probs = ", ".join(str(i / n_bins) for i in range(n_bins + 1))
    return f"""(WITH b0 AS ({base_sql}),
e0 AS (SELECT list_sort(list_distinct(quantile_cont({y}, [{probs}]))) AS ed FROM b0),
b1 AS (SELECT b0.*, CAST(len(list_filter(ed, lambda v, i: i > 1 AND i < len(ed) AND v < {y}))
                         AS INTEGER) AS bin FROM b0, e0)
SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY
        md5(concat('{seed}|', cast({key} AS varchar))), {key}) - 1) % {k} AS INTEGER) AS fold
FROM b1)"""


def dt_valid_sql(col: str) -> str:
    """DuckDB expression: TRUE when ``col`` is a valid date-time text by the
    X2 rule (RE2 has no back-reference, so the separators are an
    alternation)."""
    r = (r"^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|/([0-9]{2})/([0-9]{2}))"
         r"(?:[ T]?([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?$")
    s = f"trim({col})"
    m = (f"try_cast(coalesce(nullif(regexp_extract({s}, '{r}', 2), ''), "
         f"regexp_extract({s}, '{r}', 4)) AS INTEGER)")
    d = (f"try_cast(coalesce(nullif(regexp_extract({s}, '{r}', 3), ''), "
         f"regexp_extract({s}, '{r}', 5)) AS INTEGER)")
    hh = f"coalesce(try_cast(nullif(regexp_extract({s}, '{r}', 6), '') AS INTEGER), 0)"
    mi = f"coalesce(try_cast(nullif(regexp_extract({s}, '{r}', 7), '') AS INTEGER), 0)"
    return (f"coalesce(regexp_matches({s}, '{r}') AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 "
            f"AND 31 AND {hh} <= 23 AND {mi} <= 59 AND "
            f"{d} <= [31,29,31,30,31,30,31,31,30,31,30,31][{m}], false)")


def sig_sql(x: str, sig: int = 10) -> str:
    """DuckDB twin of ``round_sig``: rounding to significant digits for large
    statistics whose last bits differ between engines (summation order)."""
    e = f"pow(10.0, floor(log10(abs({x}))))"
    return f"(CASE WHEN {x} = 0 OR {x} IS NULL THEN {x} ELSE round(({x}) / {e}, {sig - 1}) * {e} END)"
