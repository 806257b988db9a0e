"""Leak-free feature encoders (inventory J1-J6, A13, E1, E3).

Small maps (<= 10 levels, bounds, recipes) go into the plan as literals;
level -> value maps of target encoders are DataFrames joined back. Their
size is bounded by the level count, which triage caps at n/2; when the map
is above the broadcast limit the join stays a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import c as named
from ..functions.expr import sql_text
from ..functions.expr import (DATE_PART_NAMES, KEY_PREFIX, NAN_LEVEL, composite_key,
                              datetime_parts, derived, derived_name, finite_or_null, level,
                              timestamp_parts)
from .select import distinct_counts

# ---- fixed values ----
TARGET_SMOOTHING = 20.0
KEY_MIN_ROWS = 30
KEY_MAX_LEVEL_FRAC = 0.05
KEY_MAX_GROUP_FRAC = 0.5
KEY_MAX_COLS = 2
KEY_ABS_LIMIT = 1e15
BROADCAST_MAP_ROWS = 1_000_000
# ----------------------


def onehot_exprs(col: str, levels, existing=()) -> list:
    """Indicator per level (code-point sorted); missing is a level,
    unseen levels give all zeros; an existing name is skipped."""
    out = []
    for lv in sorted(levels):
        name = f"{col}=={lv}"
        if name in existing:
            continue
        out.append((name, (level(col) == F.lit(lv)).cast("double")))
    return out


def onehot_absent_exprs(col: str, levels) -> list:
    """J1 at scoring when the source column is absent: only the __NaN__
    indicator is 1."""
    return [(f"{col}=={lv}", F.lit(1.0 if lv == NAN_LEVEL else 0.0)) for lv in sorted(levels)]


def target_encoder_map(df: DataFrame, col, y: str, smoothing: float = TARGET_SMOOTHING,
                       by=()) -> DataFrame:
    """Smoothed target mean per level: (n*mean + s*global)/(n + s);
    rows (by..., level, value, default). ``col`` may be a column name or a
    (name, Column) pair. The global mean is a one-row aggregate joined on the
    ``by`` keys (or cross-joined when there are none: one row)."""
    name, expr = (col, level(col)) if isinstance(col, str) else col
    g = df.groupBy(*by, expr.alias("level")).agg(F.count(y).alias("_n"), F.avg(y).alias("_m"))
    glob = df.groupBy(*by).agg(F.avg(y).alias("default")) if by else \
        df.agg(F.avg(y).alias("default"))
    j = g.join(glob, on=list(by), how="inner") if by else g.crossJoin(glob)
    return j.select(*by, "level",
                    ((F.col("_n") * F.col("_m") + smoothing * F.col("default"))
                     / (F.col("_n") + smoothing)).alias("value"), "default")


def target_encoder_oof(df: DataFrame, col, y: str, fold: str,
                       smoothing: float = TARGET_SMOOTHING) -> DataFrame:
    """For every fold k the map fitted on rows outside k, by subtraction:
    totals per level minus totals per (level, fold). Two small aggregates and
    joins; no loop over folds, no row explosion. Rows (fold, level, value,
    default) for every level seen outside the fold."""
    name, expr = (col, level(col)) if isinstance(col, str) else col
    yv = F.col(y).cast("double")
    per = df.groupBy(F.col(fold).alias("fold"), expr.alias("level")).agg(
        F.count(yv).alias("n_f"), F.sum(yv).alias("s_f"))
    tot = per.groupBy("level").agg(F.sum("n_f").alias("n_t"), F.sum("s_f").alias("s_t"))
    fsum = df.groupBy(F.col(fold).alias("fold")).agg(F.count(yv).alias("fn"),
                                                     F.sum(yv).alias("fs"))
    allsum = fsum.agg(F.sum("fn").alias("an"), F.sum("fs").alias("as_"))
    folds = fsum.select("fold").crossJoin(F.broadcast(allsum)).join(fsum, "fold")
    glob = folds.select("fold", ((F.col("as_") - F.col("fs")) / (F.col("an") - F.col("fn")))
                        .alias("default"))
    grid = tot.crossJoin(F.broadcast(glob))  # levels x folds (folds <= 10)
    m = grid.join(per, on=["fold", "level"], how="left").fillna({"n_f": 0, "s_f": 0.0})
    n_tr = F.col("n_t") - F.col("n_f")
    s_tr = F.col("s_t") - F.col("s_f")
    return m.filter(n_tr > 0).select(
        "fold", "level",
        ((s_tr + smoothing * F.col("default")) / (n_tr + smoothing)).alias("value"), "default")


def apply_target_encoder(df: DataFrame, col: str, enc: DataFrame, out: str | None = None,
                         level_expr: Column | None = None, by=(), n_levels: int | None = None
                         ) -> DataFrame:
    """Level -> value by a left join; unseen level -> default. The map
    is broadcast only when its row count is known to be small."""
    out = out or col
    lv = level_expr if level_expr is not None else level(col)
    m = enc.select(*by, F.col("level").alias("_lv"), F.col("value").alias("_val"))
    if n_levels is None:          # size check on the (small) map, not the data
        n_levels = m.count()
    if n_levels <= BROADCAST_MAP_ROWS:
        # broadcast: a level holding a third of the rows cannot skew a task
        m = F.broadcast(m)
    d = enc.select(*by, "default").distinct()
    d = F.broadcast(d)
    j = df.withColumn("_lv", lv).join(m, on=[*by, "_lv"], how="left")
    j = j.join(d, on=list(by), how="left") if by else j.crossJoin(d)
    return j.withColumn(out, F.coalesce(F.col("_val"), F.col("default"))) \
            .drop("_lv", "_val", "default")


def key_candidates_stats(df: DataFrame, cols) -> DataFrame:
    """J4 statistics in one aggregate: non-null count, all integral, max |v|,
    least and greatest."""
    aggs = []
    for i, x in enumerate(cols):
        v = finite_or_null(named(x).cast("double"))
        aggs += [F.count(v).alias(f"c{i}"), F.min((v == F.round(v, 0)).cast("int")).alias(f"w{i}"),
                 F.max(F.abs(v)).alias(f"a{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    return df.agg(F.count(F.lit(1)).alias("_n"), *aggs)


def detect_composite_key(df: DataFrame, cols, n_rows: int | None = None):
    """candidates = numeric, >= 2 distinct, distinct/n <= .05, integral,
    |v| < 1e15; only 1 or 2 candidates; groups of the combined key >= 2 and
    <= n/2. Returns (key name, source cols, n groups) or None. Distinct values
    are counted only of columns that the plain statistics leave in."""
    cols = list(cols)
    if not cols:
        return None
    r = key_candidates_stats(df, cols).first()
    n = r["_n"] if n_rows is None else n_rows
    if n < KEY_MIN_ROWS:
        return None
    left = {x: finite_or_null(named(x).cast("double")) for i, x in enumerate(cols)
            if r[f"c{i}"] and r[f"w{i}"] == 1 and r[f"a{i}"] < KEY_ABS_LIMIT and r[f"lo{i}"] < r[f"hi{i}"]}
    counts = {row["column"]: row["n"] for row in distinct_counts(df, left).collect()} if left else {}
    cand = [x for x in cols if x in counts and counts[x] >= 2 and counts[x] / n <= KEY_MAX_LEVEL_FRAC]
    if not cand or len(cand) > KEY_MAX_COLS:
        return None
    groups = df.select(composite_key(cand).alias("k")).distinct().count()
    if groups < 2 or groups / n > KEY_MAX_GROUP_FRAC:
        return None
    return KEY_PREFIX + "_".join(cand), cand, groups


def date_part_exprs(col: str, existing=()) -> list:
    """Four numeric parts per date-like source column."""
    p = datetime_parts(col)
    return [(f"{col}__{part}", p.getField(part)) for part in DATE_PART_NAMES
            if f"{col}__{part}" not in existing]


def timestamp_part_exprs(df: DataFrame, col: str, existing=()) -> list:
    """J6 for a native time column; text in its place is read as a time."""
    x = F.col(f"`{col}`")
    if isinstance(df.schema[col].dataType, T.StringType):
        x = x.try_cast("timestamp")
    p = timestamp_parts(x)
    return [(f"{col}__{part}", p.getField(part)) for part in DATE_PART_NAMES
            if f"{col}__{part}" not in existing]


def candidate_recipe(cols, signs: dict) -> list:
    """E1 candidates: products of pairs, squares, and sign(a) only when a has
    both signs; as (name, op, cols)."""
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append((derived_name("mul", [a, b]), "mul", [a, b]))
    for a in cols:
        out.append((derived_name("sq", [a]), "sq", [a]))
    for a in cols:
        if signs.get(a):
            out.append((derived_name("sign", [a]), "sign", [a]))
    return out


def candidate_stats(df: DataFrame, recipe) -> DataFrame:
    """E1 filter statistics: finite count, population std, min, max per
    candidate in one aggregate (long form)."""
    aggs = []
    for i, (name, op, cs) in enumerate(recipe):
        v = derived(op, cs)
        aggs += [F.count(v).alias(f"c{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"{sql_text(name)}, {i}, c{i}, s{i}, lo{i}, hi{i}"
                      for i, (name, _, _) in enumerate(recipe))
    return wide.selectExpr(f"stack({len(recipe)}, {parts}) as (feature, pos, n_finite, std, "
                           "min_v, max_v)")


def apply_recipe(df: DataFrame, recipe, existing=None) -> DataFrame:
    """Add derived columns (X15) in one projection; names must be new."""
    existing = set(existing if existing is not None else df.columns)
    cols = {name: derived(op, cs) for name, op, cs in recipe if name not in existing}
    return df.withColumns(cols) if cols else df
