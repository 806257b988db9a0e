"""Tree models (inventory M3-M6, M9, P5, E2, V9, V10, V12) on the shared-pass
booster: leaf-wise trees with l1 / l2, row and column sampling and patience.

All models of a call (folds, candidates, target variants, trees of a forest)
are fitted in the same passes over the rows, see :mod:`.boost`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c as named
from . import boost as B
from .boost import ALL, Boosted, Job, Params
from .quantiles import quantiles_of
from .stats import regression_metrics

# ---- fixed values ----
QUICK_PARAMS = {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 500, "patience": 50}
SEARCH_DEFAULT = {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 3000, "patience": 50}
SEARCH_CANDIDATES = 24
SEARCH_SPACE = {
    "num_leaves": (7, 15, 31, 63, 127), "learning_rate": (0.01, 0.02, 0.03, 0.05, 0.1),
    "min_child_samples": (5, 10, 20, 40), "max_bin": (63, 127, 255, 511),
    "colsample": (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), "subsample": (0.6, 0.7, 0.8, 0.9, 1.0),
    "extra_trees": (False, True),
}
FINALISTS = 3
HALVING_FOLDS = 2
SCREEN_MIN_FEATURES = 10
SCREEN_PARAMS = {"num_leaves": 31, "learning_rate": 0.1, "n_estimators": 200}
FE_PARAMS = {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 200}
FE_TOP_K = 15
WINSOR_TRIAL_MARGIN = 0.003
FOREST_PARAMS = {
    "rf": {"num_leaves": 63, "n_estimators": 300, "subsample": 0.7, "colsample": 0.7,
           "min_child_samples": 10},
    "xt": {"num_leaves": 63, "n_estimators": 300, "subsample": 0.8, "colsample": 0.6,
           "min_child_samples": 5, "extra_trees": True},
}
# ----------------------


def search_candidates(n_candidates: int = SEARCH_CANDIDATES, seed: int = 42) -> list:
    """M4: the fixed default first, then settings whose value of each parameter
    is the one that md5(seed|number|parameter) points to in its range."""
    def value(number: int, name: str):
        digest = hashlib.md5(f"{seed}|{number}|{name}".encode()).hexdigest()
        return SEARCH_SPACE[name][int(digest, 16) % len(SEARCH_SPACE[name])]
    return [dict(SEARCH_DEFAULT)] + [
        {"n_estimators": SEARCH_DEFAULT["n_estimators"], "patience": SEARCH_DEFAULT["patience"]}
        | {x: value(i, x) for x in SEARCH_SPACE} for i in range(1, n_candidates)]


def params_of(p: dict, early_stop: bool = True) -> Params:
    """Settings by their usual names as booster settings."""
    base = Params()
    return Params(rounds=p.get("n_estimators", base.rounds), leaves=p.get("num_leaves", base.leaves),
                  rate=p.get("learning_rate", base.rate), l1=p.get("l1", base.l1), l2=p.get("l2", base.l2),
                  min_child=p.get("min_child_samples"), max_bin=p.get("max_bin", base.max_bin),
                  colsample=p.get("colsample", base.colsample), subsample=p.get("subsample", base.subsample),
                  patience=p.get("patience") if early_stop else None, extra_trees=p.get("extra_trees", False))


def fold_medians(df: DataFrame, features, fold: str, k: int) -> dict:
    """Training-part medians per fold (t = -1: all rows), by subtraction."""
    found = quantiles_of(df, features, [0.5], fold, True)
    return {t: {x: q[0] if q else 0.0 for x, q in per.items()} for t, per in found.items()}


@dataclass
class TreeCVResult:
    oof: DataFrame            # key, fold, y, pred (transformed-y inverse applied)
    models: dict              # fold -> fitted model (-1: the final one, if asked for)
    iters: list               # best round per fold
    r2: float | None


def fit_jobs(df: DataFrame, features, labels, key: str, fold: str, jobs: list, n_rows=None,
             passes: list | None = None, own: bool = False, tasks: bool = True) -> list:
    """Fit (fold, settings, kind, label) jobs in shared passes. Kinds: "gbt",
    "final" (its rounds follow the others, M5), "rf" and "xt" (M6)."""
    flat, owner = [], []
    for i, (f, p, kind, y) in enumerate(jobs):
        if kind in ("gbt", "final"):
            mine = [Job(f, params_of(p, kind == "gbt"), y, kind == "final")]
        else:
            mine = B.forest(Job(f, replace(params_of(p), l1=0.0, l2=0.0), y), p["n_estimators"])
        flat += mine
        owner += [i] * len(mine)
    found: list = [[] for _ in jobs]
    for i, m in zip(owner, B.fit_models(df, features, labels, key, fold, flat, n_rows, passes, own,
                                         tasks) if flat else []):
        found[i].append(m)
    return [B.averaged(m) if jobs[i][2] in ("rf", "xt") else m[0] for i, m in enumerate(found)]


def fold_fits(df: DataFrame, features, y: str, key: str, fold: str, k: int, params: dict,
              kind: str = "gbt", folds=None, n_rows=None, inverse=None, y_raw: str | None = None,
              final: bool = False) -> TreeCVResult:
    """M3/M6 + V6 + V7: one model per fold on its training rows (its own
    medians and bins), early-stopping rows held out inside the training part,
    OOF predictions on the held-out fold. ``final``: also the model of all
    rows (M5), in the same passes."""
    folds = list(range(k)) if folds is None else list(folds)
    jobs = [(f, params, kind, 0) for f in folds]
    if final:
        jobs.append((ALL, params, "final" if kind == "gbt" else kind, 0))
    found = fit_jobs(df, features, [y], key, fold, jobs, n_rows)
    models = {j[0]: m for j, m in zip(jobs, found)}
    return scored_folds(df, features, models, folds, key, fold, y_raw or y, inverse)


def scored_folds(df: DataFrame, features, models: dict, folds, key: str, fold: str, y: str,
                 inverse=None) -> TreeCVResult:
    """OOF rows and their R2 of fitted fold models."""
    rows = df.where(F.col(fold).isin(list(folds))).withColumn("_truth", named(y).cast("double"))
    oof = B.predictions(rows, features, {f: models[f] for f in folds}, key, fold, keep=["_truth"]) \
        .withColumnRenamed("_truth", "y")
    if inverse is not None:
        oof = oof.withColumn("pred", inverse(F.col("pred")))
    r = regression_metrics(oof, "y", "pred").first()
    return TreeCVResult(oof, models, [len(models[f].trees) for f in folds], float(r["r2"]) if r else None)


def fit_all(df: DataFrame, features, y: str, params: dict, kind: str = "gbt", n_rows=None,
            n_trees: int | None = None, key: str | None = None) -> Boosted:
    """A model on all rows, every round of it."""
    p = dict(params) | {"patience": None}
    if n_trees is not None:
        p["n_estimators"] = n_trees
    parts = [F.coalesce(named(x).cast("string"), F.lit("\u0000")) for x in (*features, y)]
    rows = df.withColumns({"_fold_": F.lit(0), "_key_": F.col(key).cast("string") if key
                           else F.sha2(F.concat_ws("\u0001", *parts), 256)})
    return fit_jobs(rows, features, [y], "_key_", "_fold_", [(ALL, p, kind, 0)], n_rows)[0]


def shares_from_counts(counts: dict) -> list:
    """Split counts -> percent shares, 1 decimal, descending."""
    tot = max(sum(counts.values()), 1.0)
    return sorted([(x, round(n / tot * 100.0, 1)) for x, n in counts.items()], key=lambda t: -t[1])


def screen_features(df: DataFrame, features, y: str, n_rows=None, params: dict = SCREEN_PARAMS) -> list:
    """P5: only with > 10 features: a boosted model (200 trees, 31 leaves,
    lr .1, min leaf rows max(3, n/30)); keep split importance > 0; keep all
    when fewer than 2 survive."""
    if len(features) <= SCREEN_MIN_FEATURES:
        return list(features)
    counts = fit_all(df, features, y, params, n_rows=n_rows).split_counts()
    keep = [x for x in features if counts[x] > 0]
    return keep if len(keep) >= 2 else list(features)


def engineered_features(df: DataFrame, raw, derived_names, y: str, n_rows=None,
                        params: dict = FE_PARAMS) -> list:
    """<= 15 derived candidates with split importance > 0 from a boosted
    model on raw + derived columns (200 trees, lr .05)."""
    counts = fit_all(df, list(raw) + list(derived_names), y, params, n_rows=n_rows).split_counts()
    ranked = sorted([x for x in derived_names if counts[x] > 0], key=lambda x: -counts[x])
    return ranked[:FE_TOP_K]


def trial_scores(df: DataFrame, features, arms: dict, y_raw: str, key: str, fold: str, n_rows=None,
                 params: dict = SCREEN_PARAMS, tasks: bool = True) -> dict:
    """R2 on the raw target of 2-fold trials, all arms in the same passes.
    ``arms``: {name: (target column, inverse of predictions or None)}; an arm
    whose target has a non-finite value drops out (-inf)."""
    cols = {name: f"_arm{i}" for i, name in enumerate(arms)}
    d = df.withColumns({cols[name]: y for name, (y, _) in arms.items()})
    bad = d.agg(*[F.max((F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")).alias(x)
                  for x in cols.values()]).first()
    fine = [name for name in arms if not bad[cols[name]]]
    folds = range(HALVING_FOLDS)
    jobs = [(f, params, "gbt", i) for i in range(len(fine)) for f in folds]
    found = iter(fit_jobs(d, features, [cols[x] for x in fine], key, fold, jobs, n_rows, tasks=tasks)
                 if fine else [])
    scores = {}
    for name in arms:
        r2 = None
        if name in fine:
            models = {f: next(found) for f in folds}
            r2 = scored_folds(d, features, models, folds, key, fold, y_raw, arms[name][1]).r2
        scores[name] = r2 if r2 is not None and np.isfinite(r2) else -np.inf
    return scores


def choose_winsorize(df: DataFrame, features, y: str, key: str, fold: str, lo: float,
                     hi: float, n_rows=None, params: dict = SCREEN_PARAMS,
                     tasks: bool = True) -> tuple[bool, float, float]:
    """V9: 2-fold boosted trial, clipped vs raw target, both scored on raw y;
    clip only when R^2 beats no-clip by > 0.003. Returns (clip?, r2_clip,
    r2_raw)."""
    from ..functions.expr import clip as clip_expr
    got = trial_scores(df, features, {"clip": (clip_expr(y, lo, hi), None), "raw": (named(y).cast("double"), None)},
                       y, key, fold, n_rows, params, tasks)
    return got["clip"] > got["raw"] + WINSOR_TRIAL_MARGIN, got["clip"], got["raw"]


def choose_ytransform_trial(df: DataFrame, features, y: str, key: str, fold: str, arms: dict,
                            n_rows=None, params: dict = SCREEN_PARAMS, tasks: bool = True) -> tuple[str, dict]:
    """arms = {name: YTransform}; 2-fold boosted trial per arm, R^2 on
    the original scale; the best arm wins, failures drop out."""
    scores = trial_scores(df, features, {name: (t.forward(y), t.inverse) for name, t in arms.items()},
                          y, key, fold, n_rows, params, tasks)
    return max(scores, key=lambda k: scores[k]), scores


def halving(df: DataFrame, features, y: str, key: str, fold: str, k: int, candidates,
            n_rows=None, finalists: int = FINALISTS) -> tuple[int, list, TreeCVResult]:
    """Every candidate on the first 2 folds, in shared passes; the best
    ``finalists`` (NaN last) on the other folds, their first two models kept;
    returns (best index, qualifying scores, best result)."""
    first = list(range(min(HALVING_FOLDS, k)))
    jobs = [(f, c, "gbt", 0) for c in candidates for f in first]
    found = iter(fit_jobs(df, features, [y], key, fold, jobs, n_rows))
    models = [{f: next(found) for f in first} for _ in candidates]
    q = [scored_folds(df, features, m, first, key, fold, y).r2 for m in models]
    q = [x if x is not None and np.isfinite(x) else -np.inf for x in q]
    order = [int(i) for i in np.argsort(q, kind="stable")[::-1][:finalists]]
    rest = [f for f in range(k) if f not in first]
    found = iter(fit_jobs(df, features, [y], key, fold, [(f, candidates[i], "gbt", 0) for i in order for f in rest],
                          n_rows) if rest else [])
    best, best_r2, best_res = None, -np.inf, None
    for i in order:
        full = models[i] | {f: next(found) for f in rest}
        r = scored_folds(df, features, full, range(k), key, fold, y)
        if best is None or (r.r2 is not None and r.r2 > best_r2):
            best, best_r2, best_res = i, r.r2 if r.r2 is not None else -np.inf, r
    return best, q, best_res
