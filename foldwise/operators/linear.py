"""Ridge regression from Gram blocks (inventory M1, M2, M10, M13, V7).

Per outer fold k the reference fills missing values with the training medians,
robust-scales with the training median/IQR, and picks alpha by an inner
5-fold CV, then fits on the whole training part. Here every one of those fits
comes from ONE grouped aggregate: Gram blocks of the augmented vector
[1, a, N, y] per (fold, inner fold), where a = (x - c0)/s0 (0 when missing)
and N = missing indicator. Filling and scaling are linear maps of that vector,
so any fold's filled + scaled Gram is T G T'. Inner CV SSE for any alpha is
u' G_val u with u = [-c, -b, 1]. The driver does d x d algebra only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c as named
from ..functions.keys import hash_rank
from .quantiles import ALL
from .stats import filled_quantiles, fold_r2_std, gram_blocks, regression_metrics

# ---- fixed values ----
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
POLY_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 1e4, 1e5)
INNER_SEED = 42
SCALE_FLOOR = 1e-8
# ----------------------


@dataclass
class LinearFit:
    """Coefficients in raw-column space: pred = intercept + sum w_i *
    coalesce(x_i, fill_i)."""
    intercept: float
    weights: dict
    fills: dict
    alpha: float
    scaled_coef: dict = field(default_factory=dict)

    def expr(self) -> Column:
        out = F.lit(self.intercept)
        for x, w in self.weights.items():
            out = out + F.lit(w) * F.coalesce(named(x).cast("double"), F.lit(self.fills[x]))
        return out


def _solve(a, b):
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def fit_from_gram(g: np.ndarray, alpha: float):
    """Centred ridge on a [1, z, y] Gram; intercept not penalised."""
    d = g.shape[0] - 2
    n = g[0, 0]
    if n <= 0:
        return 0.0, np.zeros(d)
    mz = g[0, 1:d + 1] / n
    my = g[0, d + 1] / n
    czz = g[1:d + 1, 1:d + 1] - n * np.outer(mz, mz)
    czy = g[1:d + 1, d + 1] - n * mz * my
    b = _solve(czz + alpha * np.eye(d), czy)
    return float(my - mz @ b), b


def sse_from_gram(g: np.ndarray, c0: float, b: np.ndarray) -> float:
    u = np.concatenate([[-c0], -b, [1.0]])
    return float(u @ g @ u)


def sst_from_gram(g: np.ndarray) -> float:
    n = g[0, 0]
    return float(g[-1, -1] - (g[0, -1] ** 2) / n) if n > 0 else 0.0


def choose_alpha(blocks_train: list, alphas) -> float:
    """Inner CV: ``blocks_train`` = list of (train Gram, val Gram) per inner
    fold; lowest total SSE wins, ties keep the first alpha."""
    best, best_sse = alphas[0], np.inf
    if not blocks_train:
        return best
    for a in alphas:
        tot = 0.0
        for gt, gv in blocks_train:
            if gt[0, 0] <= 0 or gv[0, 0] <= 0:
                continue
            c0, b = fit_from_gram(gt, a)
            tot += sse_from_gram(gv, c0, b)
        if tot < best_sse:
            best, best_sse = a, tot
    return best


@dataclass
class RidgeCVResult:
    oof: DataFrame                 # key, fold, y, pred
    fold_fits: dict                # fold -> LinearFit
    final: LinearFit
    train_r2: float
    importance: list               # [(feature, percent)] descending


def _transform(d, has_null, s0, c0, fill, med, iqr, ybar):
    """Map v = [1, a_1..a_d, N_(null features), y_s] to u = [1, z_1..z_d, y_s]."""
    nulls = [i for i in range(d) if has_null[i]]
    p = 1 + d + len(nulls) + 1
    t = np.zeros((d + 2, p))
    t[0, 0] = 1.0
    for i in range(d):
        t[1 + i, 0] = (c0[i] - med[i]) / iqr[i]
        t[1 + i, 1 + i] = s0[i] / iqr[i]
        if has_null[i]:
            t[1 + i, 1 + d + nulls.index(i)] = (fill[i] - c0[i]) / iqr[i]
    t[d + 1, p - 1] = 1.0
    return t


def ridge_cv(df: DataFrame, features, y: str, key: str, fold: str = "fold",
             k: int | None = None, alphas=ALPHAS, inner_k: int = 5,
             n_rows: int | None = None,
             fit_all: bool = True) -> RidgeCVResult:
    """M1 + V7: out-of-fold ridge with per-fold fill, robust scale and inner
    alpha CV; plus the final model on all rows (M13 train R^2, M10 shares)."""
    features = list(features)
    d = len(features)
    has_inner = "ifold" in df.columns
    base = df.select(key, fold, *(["ifold"] if has_inner else []),
                     F.col(y).cast("double").alias("_y"),
                     *[named(x).cast("double").alias(x) for x in features])
    if k is None:
        k = base.agg(F.max(fold)).first()[0] + 1
    # counts by fold give every training set's median, fill and quartiles (V5)
    # by subtraction (t = -1: all rows); the centring statistics are global
    st = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_ybar"),
                  *[F.count(named(x)).alias(f"_c{i}") for i, x in enumerate(features)],
                  *[F.avg(named(x)).alias(f"_m{i}") for i, x in enumerate(features)],
                  *[F.stddev_pop(named(x)).alias(f"_s{i}") for i, x in enumerate(features)]).first()
    n = int(st["_n"]) if n_rows is None else n_rows
    ybar = float(st["_ybar"])
    c0 = [float(st[f"_m{i}"] or 0.0) for i in range(d)]
    s0 = [max(float(st[f"_s{i}"] or 0.0), 1e-12) or 1.0 for i in range(d)]
    has_null = [st[f"_c{i}"] < st["_n"] for i in range(d)]
    fill, qs = filled_quantiles(base.withColumnRenamed(fold, "_fold"), features, [0.25, 0.5, 0.75], "_fold", True)
    fills = {t: [fill[t][x] for x in features] for t in fill}
    meds = {t: [qs[t][x][1] for x in features] for t in qs}
    iqrs = {t: [max(qs[t][x][2] - qs[t][x][0], SCALE_FLOOR) for x in features] for t in qs}

    # inner folds: the ``ifold`` column of assign_folds when present, else
    # balanced inside each outer fold by md5 order (seed 42); a single alpha
    # needs no inner CV at all
    if len(alphas) <= 1:
        ranked = base.withColumn("_ip", F.lit(0))
    elif has_inner:
        ranked = base.withColumn("_ip", F.col("ifold"))
    else:
        ranked = hash_rank(base, key, INNER_SEED, partition_cols=[fold], out="_ip", n_rows=n)
    names = ["_one"] + [f"_a{i}" for i in range(d)] + \
        [f"_n{i}" for i in range(d) if has_null[i]] + ["_ys"]
    gv = ranked.select(
        F.col(fold).alias("_f"), F.pmod(F.col("_ip"), F.lit(inner_k)).cast("int").alias("_j"),
        F.lit(1.0).alias("_one"),
        *[F.coalesce((named(x) - c0[i]) / s0[i], F.lit(0.0)).alias(f"_a{i}")
          for i, x in enumerate(features)],
        *[named(x).isNull().cast("double").alias(f"_n{i}")
          for i, x in enumerate(features) if has_null[i]],
        (F.col("_y") - ybar).alias("_ys"))
    blocks = gram_blocks(gv, names, by=["_f", "_j"])
    p = len(names)
    zero = np.zeros((p, p))
    folds = sorted({f for f, _ in blocks})
    inner = sorted({j for _, j in blocks})
    fold_tot = {f: sum((blocks.get((f, j), zero) for j in inner), zero.copy()) for f in folds}
    total = sum(fold_tot.values(), zero.copy())

    def fit_for(t):
        tr = total - (fold_tot.get(t, zero) if t >= 0 else zero)
        tm = _transform(d, has_null, s0, c0, fills[t], meds[t], iqrs[t], ybar)
        gtr = tm @ tr @ tm.T
        pairs = []
        for j in inner:
            val = sum((blocks.get((f, j), zero) for f in folds if f != t), zero.copy())
            gvj = tm @ val @ tm.T
            pairs.append((gtr - gvj, gvj))
        a = choose_alpha(pairs, alphas)
        c_, b = fit_from_gram(gtr, a)
        w = {x: float(b[i] / iqrs[t][i]) for i, x in enumerate(features)}
        icpt = ybar + c_ - sum(b[i] * meds[t][i] / iqrs[t][i] for i in range(d))
        lf = LinearFit(float(icpt), w, {x: fills[t][i] for i, x in enumerate(features)},
                       float(a), {x: float(b[i]) for i, x in enumerate(features)})
        return lf, gtr, c_, b

    fold_fits = {}
    for f in folds:
        fold_fits[f] = fit_for(f)[0]
    pred = None
    for f in folds:
        e = fold_fits[f].expr()
        pred = F.when(F.col(fold) == f, e) if pred is None else pred.when(F.col(fold) == f, e)
    oof = base.select(key, fold, F.col("_y").alias("y"), pred.alias("pred"))
    if fit_all:
        final, gtr, c_, b = fit_for(-1)
        sst = sst_from_gram(gtr)
        sse = sse_from_gram(gtr, c_, b)
        train_r2 = 1.0 - sse / sst if sst > 0 else (1.0 if sse == 0 else 0.0)
        imp = coef_importance(final.scaled_coef)
    else:
        final, train_r2, imp = fold_fits[folds[0]], float("nan"), []
    return RidgeCVResult(oof, fold_fits, final, float(train_r2), imp)


def ridge_fit(df: DataFrame, features, y: str, alpha: float = 1.0,
              ) -> LinearFit:
    """One ridge fit on all rows at a fixed alpha (median fill, robust scale,
    centred): one statistics pass and one Gram pass, no folds."""
    feats = list(features)
    d = len(feats)
    base = df.select(F.col(y).cast("double").alias("_y"),
                     *[named(x).cast("double").alias(x) for x in feats])
    st = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_ybar"),
                  *[F.count(named(x)).alias(f"_c{i}") for i, x in enumerate(feats)],
                  *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(feats)],
                  *[F.stddev_pop(x).alias(f"_s{i}") for i, x in enumerate(feats)]).first()
    c0 = [float(st[f"_m{i}"] or 0.0) for i in range(d)]
    s0 = [max(float(st[f"_s{i}"] or 0.0), 1e-12) for i in range(d)]
    has_null = [st[f"_c{i}"] < st["_n"] for i in range(d)]
    fill, q = filled_quantiles(base, feats, [0.25, 0.5, 0.75])
    fill0, q = fill[ALL], q[ALL]
    med = [q[x][1] for x in feats]
    iqr = [max(q[x][2] - q[x][0], SCALE_FLOOR) for x in feats]
    ybar = float(st["_ybar"])
    names = ["_one"] + [f"_a{i}" for i in range(d)] + \
        [f"_n{i}" for i in range(d) if has_null[i]] + ["_ys"]
    gv = base.select(F.lit(0).alias("_g"), F.lit(1.0).alias("_one"),
                     *[F.coalesce((named(x) - c0[i]) / s0[i], F.lit(0.0)).alias(f"_a{i}")
                       for i, x in enumerate(feats)],
                     *[named(x).isNull().cast("double").alias(f"_n{i}")
                       for i, x in enumerate(feats) if has_null[i]],
                     (F.col("_y") - ybar).alias("_ys"))
    g = gram_blocks(gv, names, by=["_g"])[(0,)]
    tm = _transform(d, has_null, s0, c0, [fill0[x] for x in feats], med, iqr, ybar)
    c_, b = fit_from_gram(tm @ g @ tm.T, alpha)
    w = {x: float(b[i] / iqr[i]) for i, x in enumerate(feats)}
    icpt = ybar + c_ - sum(b[i] * med[i] / iqr[i] for i in range(d))
    return LinearFit(float(icpt), w, fill0, float(alpha), {x: float(b[i]) for i, x in enumerate(feats)})


def coef_importance(coef: dict) -> list:
    """Share of absolute (scaled) coefficients, percent, 1 decimal,
    descending (stable for ties)."""
    tot = max(sum(abs(v) for v in coef.values()), 1e-9)
    rows = [(x, round(abs(v) / tot * 100.0, 1)) for x, v in coef.items()]
    return sorted(rows, key=lambda r: -r[1])


def oof_metrics(oof: DataFrame, y: str = "y", pred: str = "pred", fold: str = "fold"):
    """A10-A12 over an OOF table: one row n_rows, r2, rmse, mae, r2_std,
    from one pass (additive per-fold sums)."""
    from .stats import metrics_with_fold_spread
    return metrics_with_fold_spread(oof, y, pred, fold)


def poly_columns(cols) -> list:
    """Degree-2 expansion names/exprs: singles, then x_i*x_j for i <= j."""
    out = [(x, named(x)) for x in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            name = f"{a}^2" if a == b else f"{a} {b}"
            out.append((name, F.col(a) * F.col(b)))
    return out
