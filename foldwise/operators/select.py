"""Filters, guards, samples and column selection (inventory F1-F10, P1-P8).

Decisions that depend on data (which columns are constant, numeric-like,
date-like, ...) come from ONE aggregate over the table; only a row of
per-column statistics reaches the driver.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import c as named
from ..functions.expr import (NAN_LEVEL, datetime_parts, datetime_valid, finite_or_null, is_nonfinite,
                              level, to_number)
from ..functions.keys import md5_order

# ---- fixed values ----
MAX_MISS_RATE = 0.7
CONST_STD_EPS = 1e-12
DUP_CORR_THRESH = 0.999
NUMERIC_COERCE_MIN = 0.9
DATETIME_COERCE_MIN = 0.9
ONEHOT_MAX_LEVELS = 10
DROP_LEVEL_FRAC = 0.5
INSTANT_MAX_ROWS = 500
INSTANT_SAMPLE_SEED = 20260730
LONG_TEXT = 64       # bytes; a longer level is counted by its digest
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null")  # pandas read_csv default missing tokens
# ----------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


class DataError(ValueError):
    """Raised by guards; ``key`` names the condition."""

    def __init__(self, key: str, detail=None):
        super().__init__(f"{key}: {detail}")
        self.key, self.detail = key, detail


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES) and not isinstance(dt, T.BooleanType)


# ---------------- S5 / F1-F10 ----------------

def normalize_missing(df: DataFrame, cols=None) -> DataFrame:
    """NaN / +-inf in numeric columns and the missing tokens in string
    columns become NULL; one projection, no action."""
    cols = cols or df.columns
    out = []
    for f in df.schema.fields:
        if f.name not in cols:
            out.append(named(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(finite_or_null(named(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.when(~named(f.name).isin(*MISSING_TOKENS), named(f.name))
                        .alias(f.name))
        else:
            out.append(named(f.name))
    return df.select(*out)


def resolve_target(df: DataFrame, name: str | None = None) -> str:
    """given name must exist; default is the last column."""
    if name is None:
        return df.columns[-1]
    if name not in df.columns:
        raise DataError("target_not_found", name)
    return name


def target_checks(df: DataFrame, y: str) -> DataFrame:
    """F2-F5 in one aggregate: rows, non-numeric examples (count and the
    smallest offending text), non-finite count, missing count, distinct
    usable values capped at 2 (min < max)."""
    yt = F.col(y).cast("string")
    num = to_number(yt) if not _is_num(df, y) else F.col(y).cast("double")
    bad = F.col(y).isNotNull() & num.isNull() & ~_nonfinite_text(df, y)
    fin = finite_or_null(num)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(bad.cast("long")).alias("n_non_numeric"),
        F.min(F.when(bad, yt)).alias("non_numeric_example"),
        F.sum((num.isNotNull() & fin.isNull() | _nonfinite_text(df, y)).cast("long"))
         .alias("n_nonfinite"),
        F.sum(fin.isNull().cast("long")).alias("n_missing"),
        (F.min(fin) < F.max(fin)).alias("varying"))


def _is_num(df, y):
    return is_numeric_type(df.schema[y].dataType)


def _nonfinite_text(df, y) -> Column:
    if _is_num(df, y):
        return is_nonfinite(F.col(y).cast("double"))
    t = F.lower(F.trim(F.col(y)))
    return t.isin("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan")


def require_numeric_target(df: DataFrame, y: str):
    r = target_checks(df, y).first()
    if r["n_non_numeric"]:
        raise DataError("target_not_numeric", r["non_numeric_example"])
    return r


def drop_missing_target(df: DataFrame, y: str) -> DataFrame:
    """non-finite -> missing, then rows with a missing y dropped."""
    return df.withColumn(y, finite_or_null(F.col(y).cast("double"))).filter(F.col(y).isNotNull())


def require_varying_target(checks_row):
    """F5 guard on the ``target_checks`` row."""
    if checks_row["n_rows"] - checks_row["n_missing"] <= 0:
        raise DataError("no_rows")
    if not checks_row["varying"]:
        raise DataError("constant_target")


def count_duplicate_rows(df: DataFrame, cols=None) -> Column:
    """F6 helper frame: rows beyond the first of each identical group
    (null-safe; rows are kept). Partial aggregation combines copies map-side,
    so a hot group never travels as rows."""
    cols = cols or df.columns
    g = df.groupBy(*[named(x) for x in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows"))


def hash_sample(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """N rows without replacement, the first n in md5(seed|key)
    order. A top-n per task then a merge: bounded by n, whatever the size."""
    return (df.withColumn("_h", md5_order(key, seed))
              .orderBy("_h", key).limit(n).drop("_h"))


def is_integer_valued(col) -> Column:
    """all non-null values are whole numbers (aggregate)."""
    x = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.min(F.when(x.isNotNull(), (x % 1 == 0).cast("int"))), F.lit(1)) == 1


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """rows with every listed column present."""
    return df.dropna(subset=list(cols))


# ---------------- P1-P4 ----------------

def numeric_features(df: DataFrame, target: str, max_miss: float = MAX_MISS_RATE,
                     rates: dict | None = None) -> list:
    """Numeric type, not the target, null rate < max_miss."""
    cand = [f.name for f in df.schema.fields
            if f.name != target and is_numeric_type(f.dataType)]
    if not cand:
        return []
    if rates is None:
        rates = null_rates(df, cand)
    return [x for x in cand if rates[x] < max_miss]


def null_rates(df: DataFrame, cols) -> dict:
    r = df.agg(*[F.avg(named(x).isNull().cast("double")).alias(x) for x in cols]).first()
    return {x: float(r[x] or 0.0) for x in cols}


def column_stats(df: DataFrame, cols) -> DataFrame:
    """P1/P2 statistics in one aggregate: null rate, min, max, sample std."""
    aggs = []
    for x in cols:
        v = named(x).cast("double")
        aggs += [F.avg(named(x).isNull().cast("double")).alias(f"{x}__null_rate"),
                 F.min(v).alias(f"{x}__min"), F.max(v).alias(f"{x}__max"),
                 F.stddev_samp(v).alias(f"{x}__std")]
    return df.agg(*aggs)


def constant_columns(df: DataFrame, cols, stats_row=None) -> list:
    """Distinct non-null <= 1 (min == max or all null) or sample std <
    1e-12. min/max replace count(distinct): same test, no distinct shuffle."""
    r = stats_row or column_stats(df, cols).first()
    out = []
    for x in cols:
        lo, hi, sd = r[f"{x}__min"], r[f"{x}__max"], r[f"{x}__std"]
        if lo is None or lo == hi or (sd if sd is not None else 0.0) < CONST_STD_EPS:
            out.append(x)
    return out


def corr_matrix_filled(df: DataFrame, cols, fills: dict):
    """Pearson r of all column pairs after filling with ``fills`` (P3/D7):
    one Gram aggregate, algebra on the driver. Returns (r, std_samp)."""
    from .stats import gram_blocks
    d = len(cols)
    names = ["_one"] + [f"_c{i}" for i in range(d)]
    g = df.select(F.lit(1.0).alias("_one"),
                  *[F.coalesce(named(x).cast("double"), F.lit(fills[x])).alias(f"_c{i}")
                    for i, x in enumerate(cols)])
    # centre by the fill value for numerical stability (shift-invariant)
    g = g.select("_one", *[(F.col(f"_c{i}") - fills[x]).alias(f"_c{i}")
                           for i, x in enumerate(cols)])
    G = gram_blocks(g.withColumn("_g", F.lit(0)), names, by=["_g"])[(0,)]
    n = G[0, 0]
    mu = G[0, 1:] / n
    cov = G[1:, 1:] - n * np.outer(mu, mu)
    var = np.clip(np.diag(cov), 0.0, None)
    sd = np.sqrt(var)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.outer(sd, sd)
    std_samp = np.sqrt(var / max(n - 1, 1))
    return r, std_samp


def duplicate_columns(df: DataFrame, cols, fills: dict) -> list:
    """Walk columns in order; drop one whose |r| with an already kept
    column exceeds 0.999 (r = -1 drops too). Returns [(col, kept, partner)]."""
    r, sd = corr_matrix_filled(df, cols, fills)
    kept, out = [], []
    for i, x in enumerate(cols):
        partner = None
        for j in kept:
            if sd[i] > 0 and sd[j] > 0 and np.isfinite(r[i, j]) and abs(r[i, j]) > DUP_CORR_THRESH:
                partner = cols[j]
                break
        if partner is None:
            kept.append(i)
        out.append((x, partner is None, partner))
    return out


def target_corr(df: DataFrame, cols, target: str) -> DataFrame:
    """P4 statistics: per column, pairs where both are finite, population
    stds and Pearson r, in one aggregate (long form via stack)."""
    y = finite_or_null(F.col(target).cast("double"))
    aggs = []
    for i, x in enumerate(cols):
        v = finite_or_null(named(x).cast("double"))
        both = v.isNotNull() & y.isNotNull()
        vx, vy = F.when(both, v), F.when(both, y)
        # ANSI corr raises on a zero variance: covariance / stds, try_divide
        r = F.try_divide(F.covar_pop(vx, vy), F.stddev_pop(vx) * F.stddev_pop(vy))
        aggs += [F.count(vx).alias(f"n{i}"), F.stddev_pop(vx).alias(f"sx{i}"),
                 F.stddev_pop(vy).alias(f"sy{i}"), r.alias(f"r{i}")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{x.replace(chr(39), chr(39) * 2)}', {i}, n{i}, sx{i}, sy{i}, r{i}"
                      for i, x in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {parts}) as (column, pos, n_pairs, sx, sy, r)")


def top_k_by_corr(df: DataFrame, cols, target: str, k: int = 8) -> list:
    """P4 + J7: top k by |r| (ties keep column order); the result keeps the
    original column order; if nothing ranks, the first k."""
    rows = target_corr(df, cols, target).collect()
    ranked = []
    for r in sorted(rows, key=lambda r: r["pos"]):
        if r["n_pairs"] < 2 or r["sx"] is None or r["sx"] < 1e-12 or r["sy"] < 1e-12:
            continue
        if r["r"] is None or not np.isfinite(r["r"]):
            continue
        ranked.append((r["column"], abs(r["r"])))
    if not ranked:
        return list(cols[:k])
    ranked.sort(key=lambda t: -t[1])
    top = {c for c, _ in ranked[:k]}
    return [c for c in cols if c in top]


# ---------------- P6 type triage ----------------

def distinct_counts(df: DataFrame, values: dict) -> DataFrame:
    """Exact numbers of distinct non-null values of many columns, as rows
    (column, n): ``values`` names them ({name: Column}, all of one type). Cells
    become (column, value) pairs that are thinned out map-side and meet once,
    so one shuffle carries each distinct value once a map task, a hot value
    costs no more than a rare one, and no copy of the table's rows is made for
    every column. Long text travels as its digest."""
    kind = df.select(next(iter(values.values()))).schema[0].dataType

    def short(v: Column) -> Column:
        # a digest is marked and longer than any text that stays as it is
        return F.when(F.octet_length(v) > LONG_TEXT, F.concat(F.lit("\u0000"), F.sha2(v, 256))).otherwise(v)

    if isinstance(kind, T.StringType):
        values = {x: short(v) for x, v in values.items()}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values.values())])
    pairs = df.select(F.explode(cells).alias("p")).select("p.i", "p.v").where("v is not null").distinct()
    names = F.create_map(*[F.lit(x) for i, name in enumerate(values) for x in (i, name)])
    return pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).select(names[F.col("i")].alias("column"), "n")


def triage_stats(df: DataFrame, target: str, cols=None, every_level: bool = True) -> DataFrame:
    """P6 statistics for every non-numeric column: numeric-parse rate,
    date-parse rate (both over ALL rows), exact level count (missing is a
    level). Long form, one row per column. Levels are counted after the rates
    are known; without ``every_level`` only where the rates leave the decision
    open (else null)."""
    cols = cols or [f.name for f in df.schema.fields
                    if f.name != target and not is_numeric_type(f.dataType)]
    if not cols:
        return None
    is_bool = [isinstance(df.schema[x].dataType, T.BooleanType) for x in cols]
    aggs = []
    for i, x in enumerate(cols):
        num_ok = F.lit(0.0) if is_bool[i] else to_number(named(x)).isNotNull().cast("double")
        dt_ok = F.lit(0.0) if is_bool[i] else datetime_valid(named(x)).cast("double")
        aggs += [F.avg(num_ok).alias(f"nr{i}"), F.avg(dt_ok).alias(f"dr{i}")]
    r = df.agg(F.count(F.lit(1)).alias("_n"), *aggs).first()
    rates = [(r[f"nr{i}"], r[f"dr{i}"]) for i in range(len(cols))]
    open_ = [x for x, (nr, dr) in zip(cols, rates)
             if every_level or ((nr or 0.0) < NUMERIC_COERCE_MIN and (dr or 0.0) < DATETIME_COERCE_MIN)]
    counts = {} if not open_ else {
        row["column"]: row["n"] for row in distinct_counts(df, {x: level(x) for x in open_}).collect()}
    rows = [(r["_n"], x, i, is_bool[i], *rates[i], counts.get(x, 0) if x in open_ else None)
            for i, x in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "_n long, column string, pos int, is_bool boolean, numeric_rate double, datetime_rate double, "
              "n_levels long")


def triage_decision(n: Column, is_bool: Column, nr: Column, dr: Column, nl: Column) -> Column:
    """P6 decision order: bool -> category; numeric >= .9 -> numeric;
    date >= .9 -> datetime; levels > max(1, floor(n*.5)) -> drop;
    <= 10 -> onehot; else target."""
    drop_lim = F.greatest(F.lit(1), F.floor(n * DROP_LEVEL_FRAC))
    cat = F.when(nl > drop_lim, "drop").when(nl <= ONEHOT_MAX_LEVELS, "onehot") \
           .otherwise("target")
    return F.when(is_bool, cat).when(nr >= NUMERIC_COERCE_MIN, "numeric") \
            .when(dr >= DATETIME_COERCE_MIN, "datetime").otherwise(cat)


def triage_columns(df: DataFrame, target: str, cols=None, every_level: bool = True) -> DataFrame:
    """Table (column, decision, numeric_rate, datetime_rate, n_levels),
    with exact level counts at every size (``every_level``: see triage_stats)."""
    st = triage_stats(df, target, cols, every_level)
    return st.select("column", "pos",
                     triage_decision(F.col("_n"), F.col("is_bool"), F.col("numeric_rate"),
                                     F.col("datetime_rate"), F.col("n_levels")).alias("decision"),
                     "numeric_rate", "datetime_rate", F.col("n_levels").cast("long"))


def onehot_levels(df: DataFrame, cols) -> dict:
    """Sorted levels (code-point order) of low-cardinality columns, in one job:
    the triage leaves <= 10 a column to reach the driver."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), level(x).alias("lv"))
                      for i, x in enumerate(cols)])
    rows = df.select(F.explode(cells).alias("p")).select("p.i", "p.lv").distinct().collect()
    return {x: sorted(r["lv"] for r in rows if r["i"] == i) for i, x in enumerate(cols)}


# ---------------- P7 / P8 ----------------

def missing_columns(df: DataFrame, required) -> tuple[DataFrame, list]:
    """Required columns absent from ``df`` are added as NULL (later median
    filled) and reported; first-seen order."""
    seen, missing = set(df.columns), []
    for x in required:
        if x not in seen and x not in missing:
            missing.append(x)
    out = df
    if missing:
        out = df.withColumns({x: F.lit(None).cast("double") for x in missing})
    return out, missing


NAN = NAN_LEVEL
