"""Aggregations (inventory A1-A19).

All statistics are single ``agg`` passes (grouped by fold where needed); the
driver only receives d x d matrices or a few numbers per column.

Quantiles come from :mod:`.quantiles`: additive bucket counts, exact at every
size, equal to SQL's ``quantile_cont``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, clip, finite_or_null
from .quantiles import ALL, quantiles_of

def quantiles(df: DataFrame, cols, probs) -> dict:
    """{column: [a quantile a prob] or None} over all rows."""
    return quantiles_of(df, cols, probs)[ALL]


def medians(df: DataFrame, cols) -> dict:
    """A1: column medians; an all-missing column gets 0."""
    return {x: q[0] if q else 0.0 for x, q in quantiles(df, cols, [0.5]).items()} if cols else {}


def filled_quantiles(df: DataFrame, cols, probs, group: str | None = None, rest: bool = False) -> tuple[dict, dict]:
    """(medians, quantiles) by model, the quantiles with missing cells filled by
    the model's median (0 without values): the fills are counted, not written."""
    found = quantiles_of(df, cols, [0.5, *probs], group, rest)
    fills = {m: {x: q[0] if q else 0.0 for x, q in per.items()} for m, per in found.items()}
    g = F.col(group).cast("long") if group else F.lit(ALL).cast("long")
    gone = {r["_g"]: r for r in df.groupBy(g.alias("_g")).agg(
        *[(F.count(F.lit(1)) - F.count(c(x))).alias(f"_{i}") for i, x in enumerate(cols)]).collect()}
    total = {x: sum(r[f"_{i}"] for r in gone.values()) for i, x in enumerate(cols)}
    if any(total.values()):
        missing = {m: {x: (fills[m][x], (gone[m][f"_{i}"] if m in gone and not rest else
                                         total[x] - (gone[m][f"_{i}"] if m in gone else 0)))
                       for i, x in enumerate(cols)} for m in found}
        some = [x for x in cols if total[x]]
        again = quantiles_of(df, some, [0.5, *probs], group, rest, fills=missing)
        found = {m: found[m] | again[m] for m in found}
    return fills, {m: {x: q[1:] if q else [0.0] * len(probs) for x, q in per.items()} for m, per in found.items()}


def impute(df: DataFrame, fills: dict) -> DataFrame:
    """A2: fill with given medians (model's own first, table's second, 0 last)."""
    return df.fillna({k: float(v) for k, v in fills.items()})


def clip_bounds(df: DataFrame, cols, lo_q=0.01, hi_q=0.99) -> dict:
    """A3: per-feature 1%/99% bounds, kept only when lo < hi."""
    found = quantiles(df, cols, [lo_q, hi_q]) if cols else {}
    return {x: tuple(q) for x, q in found.items() if q and q[0] < q[1]}


def iqr_bounds(df: DataFrame, y: str, mult: float):
    """A4: (Q1 - m*IQR, Q3 + m*IQR)."""
    q = quantiles(df, [y], [0.25, 0.75])[y]
    iqr = q[1] - q[0]
    return q[0] - mult * iqr, q[1] + mult * iqr


def winsorize(df: DataFrame, y: str, lo: float, hi: float, out: str | None = None):
    """A5: clip y to [lo, hi]; returns (frame, changed-row count column expr)."""
    out = out or y
    changed = F.sum(F.when((F.col(y) < lo) | (F.col(y) > hi), 1).otherwise(0))
    return df.withColumn(out, clip(y, lo, hi)), changed


def skewness_pop(col) -> Column:
    """Population skewness; 0 when the population std < 1e-12."""
    x = c(col)
    m = F.avg(x)
    sd = F.stddev_pop(x)
    return F.when(sd < 1e-12, F.lit(0.0)).otherwise(F.skewness(x))


def r2_from_sums(sse: Column, sst: Column) -> Column:
    """A10: 1 - SSE/SST; SST = 0 -> 1 if SSE = 0 else 0."""
    return F.when(sst > 0, 1.0 - sse / sst).otherwise(
        F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def regression_metrics(df: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    """N, R^2, RMSE, MAE per group (or overall)."""
    err = F.col(y) - F.col(pred)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("_mse"),
    ]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.select(*by, "n_rows",
                    r2_from_sums(F.col("_sse"), F.col("_sst")).alias("r2"),
                    F.sqrt("_mse").alias("rmse"), "mae")


def fold_r2_std(df: DataFrame, y: str, pred: str, fold: str = "fold") -> Column:
    """A12 helper frame: population std of per-fold R^2 over folds with >= 2
    rows; 0 when fewer than 2 such folds."""
    per = regression_metrics(df, y, pred, by=[fold]).filter(F.col("n_rows") >= 2)
    return per.agg(F.when(F.count(F.lit(1)) >= 2, F.stddev_pop("r2"))
                   .otherwise(F.lit(0.0)).alias("r2_std"))


def metrics_with_fold_spread(df: DataFrame, y: str, pred: str, fold: str = "fold",
                             by=()) -> DataFrame:
    """A10-A12 in ONE pass over the rows: additive per-fold sums (n, sum y,
    sum y^2, SSE, sum |e|) give the per-fold R^2 and, summed over the small
    per-fold table, the overall n, R^2, RMSE and MAE."""
    err = F.col(y) - F.col(pred)
    by = list(by)
    per = df.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"),
                               F.sum(F.col(y) * F.col(y)).alias("syy"),
                               F.sum(err * err).alias("sse"), F.sum(F.abs(err)).alias("sae"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    per = per.withColumn("r2", r2_from_sums(F.col("sse"), sst))
    aggs = [F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"),
            F.sum("sse").alias("sse"), F.sum("sae").alias("sae"),
            F.when(F.count(F.when(F.col("n") >= 2, 1)) >= 2,
                   F.stddev_pop(F.when(F.col("n") >= 2, F.col("r2"))))
            .otherwise(F.lit(0.0)).alias("r2_std")]
    tot = per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)
    return tot.select(*by, F.col("n").alias("n_rows"),
                      r2_from_sums(F.col("sse"), sst).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                      (F.col("sae") / F.col("n")).alias("mae"), "r2_std")


def gram_exprs(names) -> list:
    """Sums of all products of the augmented vector ``names`` (upper
    triangle incl. diagonal) as aggregate expressions, named g_i_j."""
    out = []
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            b = names[j]
            out.append(F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}"))
    return out


def gram_blocks(df: DataFrame, names, by) -> dict:
    """Gram matrix of ``names`` per group of ``by``; returns
    {group tuple: p x p ndarray}. Only (groups x p x p) numbers reach the
    driver; partial aggregation keeps the shuffle at one row per group per
    map task."""
    p = len(names)
    if p > WIDE_GRAM_COLUMNS:
        return arrow_gram_blocks(df, names, by)
    rows = df.groupBy(*by).agg(*gram_exprs(names)).collect()
    out = {}
    for r in rows:
        g = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                v = r[f"g_{i}_{j}"]
                g[i, j] = g[j, i] = 0.0 if v is None else float(v)
        out[tuple(r[b] for b in by)] = g
    return out


WIDE_GRAM_COLUMNS = 18     # above this, d(d+1)/2 sum expressions cost more to plan


def arrow_gram_blocks(df: DataFrame, names, by) -> dict:
    """A14 wide: per-partition NumPy Grams of ``names`` per group of ``by``
    (integer columns) inside ``mapInArrow``, summed with ``reduceByKey``;
    the shuffle carries one packed triangle per (group, partition)."""
    import pyarrow as pa
    from ..session import ship_package
    ship_package(df.sparkSession)
    by = list(by)
    nb, p = len(by), len(names)
    src = df.select(*[F.col(b).cast("long").alias(f"_b{i}") for i, b in enumerate(by)],
                    *[F.col(n).cast("double").alias(f"_v{i}") for i, n in enumerate(names)])
    iu = np.triu_indices(p)

    def part(batches):
        acc = {}
        for bt in batches:
            keys = np.column_stack([bt.column(i).to_numpy(zero_copy_only=False)
                                    for i in range(nb)]) if nb else np.zeros((bt.num_rows, 0))
            X = np.column_stack([bt.column(nb + i).to_numpy(zero_copy_only=False).astype(float)
                                 for i in range(p)])
            X = np.nan_to_num(X, nan=0.0)     # SQL sum skips NULL products: same result
            uk, inv = np.unique(keys, axis=0, return_inverse=True)
            for gi, k in enumerate(uk):
                Xm = X[inv.ravel() == gi]
                kk = "|".join(str(int(v)) for v in k)
                acc[kk] = acc.get(kk, 0.0) + Xm.T @ Xm
        ks = list(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ks, pa.string()), pa.array([acc[k][iu].tolist() for k in ks],
                                                  pa.list_(pa.float64()))], names=["g", "packed"])

    red = (src.mapInArrow(part, "g string, packed array<double>").rdd
           .map(lambda r: (r["g"], np.asarray(r["packed"])))
           .reduceByKey(lambda a, b: a + b).collectAsMap())
    out = {}
    for k, vec in red.items():
        g = np.zeros((p, p))
        g[iu] = vec
        g.T[iu] = vec
        out[tuple(int(v) for v in k.split("|")) if k else ()] = g
    return out


def smear_factor(df: DataFrame, y: str, pred: str) -> float:
    """Median of y / max(pred, 1e-6) over finite ratios, clipped to
    [0.5, 2] (used only when the y-transform is log1p)."""
    ratio = finite_or_null(F.col(y) / F.greatest(F.col(pred), F.lit(1e-6)))
    q = quantiles_of(df, {"ratio": ratio}, [0.5])[ALL]["ratio"]
    return min(2.0, max(0.5, q[0])) if q else 1.0


def y_clip_range(df: DataFrame, y: str, frac: float = 0.05):
    """Raw min/max widened by 5 % of the range (margin max(|max|, 1) when
    the range is 0)."""
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    rng = hi - lo
    margin = frac * rng if rng > 0 else frac * max(abs(hi), 1.0)
    return lo - margin, hi + margin


def y_clip_range_cols(y: str, frac: float = 0.05):
    """A16 as aggregate expressions (lo, hi)."""
    lo, hi = F.min(y), F.max(y)
    rng = hi - lo
    margin = F.when(rng > 0, rng * frac).otherwise(F.greatest(F.abs(hi), F.lit(1.0)) * frac)
    return (lo - margin).alias("y_lo"), (hi + margin).alias("y_hi")


# ---------------- Yeo-Johnson lambda (A19) ----------------

def yj_objective_cols(x: str, lams) -> list:
    """Negative log-likelihood pieces for many lambdas in one aggregate:
    var_pop(yj(x, lam_i)) per lambda plus the shared sum sign(x)*log1p|x|."""
    from ..functions.expr import yeo_johnson
    out = [F.var_pop(yeo_johnson(x, float(l))).alias(f"v{i}") for i, l in enumerate(lams)]
    out.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"))
    out.append(F.count(x).alias("n"))
    return out


def yj_nll(var: float, s: float, n: int, lam: float) -> float:
    if var is None or not np.isfinite(var) or var < 1e-12:
        return 1e10
    return 0.5 * n * np.log(var) - (lam - 1.0) * s


def yeo_johnson_lambda(df: DataFrame, x: str, lo=-5.0, hi=5.0, grid=21,
                       rounds=6, tol=1e-5) -> float:
    """Maximum-likelihood lambda by grid refinement; each round is one
    aggregate evaluating ``grid`` lambdas, then the bracket narrows around the
    best point. Matches golden-section search for a unimodal objective."""
    a, b = lo, hi
    best = 1.0
    for _ in range(rounds):
        lams = list(np.linspace(a, b, grid))
        r = df.agg(*yj_objective_cols(x, lams)).first()
        vals = [yj_nll(r[f"v{i}"], r["s"] or 0.0, r["n"], l) for i, l in enumerate(lams)]
        k = int(np.argmin(vals))
        best = lams[k]
        step = (b - a) / (grid - 1)
        a, b = max(lo, best - step), min(hi, best + step)
        if b - a < tol:
            break
    return float(best)
