"""``train`` / ``predict``: the reference's two entry points as Spark jobs.

train: validate the target (F1-F5) -> optional instant cap (F7) -> type
triage (P6) and encoders (J1, J4, J6) -> screening (P1-P3) -> derived
features (E1/E2, thorough) -> folds (V1-V4) -> long per-model frame (V5)
with per-fold winsor (A4/A5, V9), y-transform (V10/V11), clip (A3), target
encoding (J3) -> models (ridge M1/M10/M13, boosted trees M3/M5/M9 with the
fold bag, RBF kernel M7, MLP M8, forests M6 in thorough mode) -> blend
(B1-B5, thorough) and choice (J8) -> post-processing (A15, A16, B7) ->
reports (D9-D11) -> FittedPlan (S10).

Only small things reach the driver: per-column statistics, level lists
(<= 10 per one-hot column), per-model bounds, d x d Grams, model metrics.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import c as named
from ..functions.expr import composite_key, level, to_number
from ..operators import blend as B
from ..operators import boost
from ..operators import longfit as LF
from ..operators import select as S
from ..operators import stats as A
from ..operators import trees as TR
from ..operators.cv import SMALL_N_OOF, assign_folds, fold_count
from ..operators.encode import (date_part_exprs, detect_composite_key, onehot_exprs,
                                timestamp_part_exprs)
from ..operators.mlp import EPOCHS_QUICK, EPOCHS_SEARCH
from ..operators.post import (PostProcess, YTransform, choose_ytransform_by_skew, feature_shares, fit_postprocess,
                              shift_importance)
from ..session import cut_lineage, shared_path
from ..sources.csv import read_table
from .fitted import FittedPlan, predicted_path, write_scored
from .models import _member

# ---- fixed values ----
WINSOR_MULT = {"thorough": 3.0, "quick": 4.5, "instant": 4.5}
WINSOR_MIN_TRAIN_ROWS = 20
KERNEL_MIN_ROWS = 10
MLP_MIN_ROWS = 30
FE_MIN_ROWS = 50
FE_MAX_RAW = 12
# ----------------------


@dataclass
class TrainResult:
    plan: FittedPlan
    candidates: DataFrame
    oof: DataFrame
    warnings: DataFrame
    summary: DataFrame


def _row_key(df: DataFrame, cols) -> F.Column:
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def train(df: DataFrame, target: str | None = None, mode: str = "quick",
          key: str | None = None, models=("ridge", "gbt", "kernel", "mlp"),
          work_dir: str | None = None,
          mlp_epochs: int | None = None, tree_rounds: int | None = None) -> TrainResult:
    spark = df.sparkSession
    if work_dir is None:     # model folders live in the shared checkpoint folder
        work_dir = shared_path(spark, "train")
    else:                    # the caller's folder is there, whether maps go into it or not
        at = spark._jvm.org.apache.hadoop.fs.Path(work_dir)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    raw_cols = [c.strip() for c in df.columns]
    df = S.normalize_missing(df.toDF(*raw_cols))
    target = S.resolve_target(df, target)
    checks = S.target_checks(df, target).first()
    if checks["n_non_numeric"]:
        raise S.DataError("target_not_numeric", checks["non_numeric_example"])
    S.require_varying_target(checks)
    n_na = int(checks["n_missing"])
    y_expr = (named(target).cast("double") if S._is_num(df, target) else to_number(target))
    df = df.withColumn(target, y_expr).filter(named(target).isNotNull())
    feat_src = [c for c in df.columns if c not in (target, key)]
    n_dup = S.count_duplicate_rows(df.select(*[named(x) for x in [*feat_src, target]])).first()["duplicate_rows"]
    if key is None:
        key = "_key"
        df = df.withColumn(key, _row_key(df, feat_src + [target]))
        if n_dup:      # equal rows are rows of their own: numbered, and the numbers kept
            number = F.monotonically_increasing_id().cast("string")
            df = cut_lineage(df.withColumn(key, F.concat(key, F.lit("#"), number)))
    if mode == "instant":
        df = S.hash_sample(df, S.INSTANT_MAX_ROWS, S.INSTANT_SAMPLE_SEED, key)
    n = df.count()
    if n == 0:
        raise S.DataError("no_rows")
    df = df.cache()

    # ---- P6 triage and encoders ----
    ts_cols = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
               and f.name not in (target, key)]
    non_num = [f.name for f in df.schema.fields
               if f.name not in (target, key, *ts_cols) and not S.is_numeric_type(f.dataType)]
    decisions = {}
    if non_num:
        for r in S.triage_columns(df, target, non_num, every_level=False).collect():
            decisions[r["column"]] = r["decision"]
    numeric_text = [c for c, d in decisions.items() if d == "numeric"]
    dt_cols = [c for c, d in decisions.items() if d == "datetime"]
    oh_cols = [c for c, d in decisions.items() if d == "onehot"]
    te_cols = [c for c, d in decisions.items() if d == "target"]
    dropped = [c for c, d in decisions.items() if d == "drop"]
    adds = {c: to_number(c) for c in numeric_text}
    levels = S.onehot_levels(df, oh_cols) if oh_cols else {}
    existing = set(df.columns)
    for c in oh_cols:
        adds.update(dict(onehot_exprs(c, levels[c], existing)))
    for c in dt_cols:
        adds.update(dict(date_part_exprs(c, existing)))
    for c in ts_cols:      # native time columns go to the same four parts
        adds.update(dict(timestamp_part_exprs(df, c, existing)))
    enc = df.withColumns(adds) if adds else df
    enc = enc.drop(*oh_cols, *dt_cols, *dropped, *ts_cols)
    for c in te_cols:
        enc = enc.withColumn(c, level(c))
    generated = set(adds) - set(numeric_text)

    # ---- J4 composite key ----
    num_cols = [f.name for f in enc.schema.fields if f.name not in (target, key)
                and S.is_numeric_type(f.dataType) and f.name not in generated]
    composite = None
    found = detect_composite_key(enc, num_cols, n_rows=n) if n >= 30 else None
    if found:
        name, cols, _ = found
        enc = enc.withColumn(name, composite_key(cols))
        te_cols.append(name)
        composite = {"name": name, "cols": cols}

    # ---- P1-P3 screening ----
    cand = [f.name for f in enc.schema.fields if f.name not in (target, key, *te_cols)
            and S.is_numeric_type(f.dataType)]
    st = S.column_stats(enc, cand).first() if cand else None
    feats = [c for c in cand if st[f"{c}__null_rate"] < S.MAX_MISS_RATE] if cand else []
    const = set(S.constant_columns(enc, feats, st)) if feats else set()
    feats = [c for c in feats if c not in const]
    if len(feats) > 1:
        fills = A.medians(enc, feats)
        walk = S.duplicate_columns(enc, feats, fills)
        feats = [c for c, kept, _ in walk if kept]

    # ---- E1/E2 derived features (thorough, >= 50 rows) ----
    recipe = []
    if mode == "thorough" and n >= FE_MIN_ROWS and len(feats) >= 1:
        enc, recipe, feats = _derived_features(enc, feats, target, st, n, tree_rounds)

    # ---- folds ----
    oof_eval = mode == "thorough" or n < SMALL_N_OOF
    k = fold_count(n, oof_eval)
    if k == 0:
        enc = enc.withColumn("fold", F.lit(0))
        k_eff, eval_kind = 1, "train"
    else:
        enc, plan = assign_folds(enc, target, key, k, n_rows=n)
        k_eff, eval_kind = plan.n_folds, ("oof" if oof_eval else "val")
    # persist the 1x folded table; the (k + 1)x long frame is re-exploded
    # map-side by each per-model aggregate instead of being stored
    enc = enc.persist()
    L = LF.long_frame(enc, "fold", k_eff)
    if eval_kind == "val":
        L = L.filter(F.col(LF.MODEL).isin(0, -1))
    if eval_kind == "train":
        L = L.filter(F.col(LF.MODEL) == -1).withColumn(LF.VAL, F.lit(False))
    L = L.withColumn("_yraw", F.col(target))

    # ---- winsorizing (A4/A5, V9) ----
    mult = WINSOR_MULT.get(mode, 4.5)
    Lw, changed, wlo, whi = LF.winsorize_long(L, target, "_yw", mult)
    n_changed = int(Lw.agg(changed).first()[0] or 0)
    winsor_skipped = False
    if n_changed and n >= WINSOR_MIN_TRAIN_ROWS and k_eff >= 2 and feats:
        lo_all, hi_all = wlo.get(-1), whi.get(-1)
        clip_ok, _, _ = TR.choose_winsorize(enc, feats, target, key, "fold", lo_all, hi_all,
                                            n_rows=n, params=_trial(TR.SCREEN_PARAMS, tree_rounds))
        if not clip_ok:
            winsor_skipped, n_changed = True, 0
            Lw = L.withColumn("_yw", F.col(target))
    # ---- y transform (V11 quick, V10 thorough) ----
    fit_rows = Lw.filter((F.col(LF.MODEL) == -1)).select(F.col("_yw").alias("y"))
    if mode == "thorough" and feats and k_eff >= 2:
        arms = {"none": YTransform("none")}
        if Lw.agg(F.min("_yraw")).first()[0] >= 0:
            arms["log1p"] = YTransform("log1p")
        arms["yeo-johnson"] = YTransform("yeo-johnson", A.yeo_johnson_lambda(fit_rows, "y"))
        best, _ = TR.choose_ytransform_trial(enc, feats, target, key, "fold", arms, n_rows=n,
                                              params=_trial(TR.SCREEN_PARAMS, tree_rounds))
        yt = arms[best]
    else:
        yt = choose_ytransform_by_skew(fit_rows, "y")
    Lw = Lw.withColumn("_yfit", yt.forward("_yw"))

    # ---- per-model clip (A3) and target encoding (J3) ----
    Lc, xclip = LF.clip_long(Lw, feats)
    te_maps = {}
    if te_cols:
        Lc, maps, glob = LF.target_encode_long(Lc, te_cols, "_yw")
        g_all = glob.first()
        from .fitted import INLINE_MAP_LEVELS
        for c, mp in maps.items():
            if mp.count() <= INLINE_MAP_LEVELS:      # small: a literal map in the plan
                te_maps[c] = {"map": {r["_lv"]: float(r["_te"]) for r in mp.collect()},
                              "default": float(g_all["_g"])}
            else:                                     # large: stays a table
                mpath = os.path.join(work_dir, "maps", "".join(
                    ch if ch.isalnum() else "_" for ch in c))
                mp.select(F.col("_lv").alias("level"), F.col("_te").alias("value")) \
                    .write.mode("overwrite").parquet(mpath)
                te_maps[c] = {"map": None, "path": mpath, "default": float(g_all["_g"])}
    model_feats = feats + te_cols

    # ---- models ----
    cands = {}
    if "ridge" in models and model_feats:
        oof, fits, tr2 = LF.ridge_long(Lc, model_feats, "_yfit", "_yraw", key, n_rows=n)
        oof = oof.withColumn("pred", yt.inverse("pred"))
        cands["ridge"] = dict(oof=oof, train_r2=tr2, type="linear",
                              model={"type": "linear", "intercept": fits[-1].intercept,
                                     "weights": fits[-1].weights},
                              importance=_shares(fits[-1].scaled_coef))
    skipped = {}
    if "kernel" in models and model_feats and n >= KERNEL_MIN_ROWS:
        from ..operators.kernel import rbf_long
        oof, kmodel, ktr2 = rbf_long(Lc, model_feats, key)
        cands["kernel"] = dict(oof=oof.withColumn("pred", yt.inverse("pred")), train_r2=ktr2,
                               type="kernel", model=kmodel, importance=[])
    if "gp" in models and model_feats and n >= KERNEL_MIN_ROWS:
        from ..operators.gp import gp_long
        oof, fitted = gp_long(Lc, model_feats, key)
        cands["gp"] = dict(oof=oof.withColumn("pred", yt.inverse("pred")), train_r2=fitted[-1].train_r2,
                           type="kernel", model=fitted[-1].as_dict(), importance=fitted[-1].importance())
    if "mlp" in models and model_feats:
        if n < MLP_MIN_ROWS:
            skipped["mlp"] = "min_rows"
        else:
            from ..operators.mlp import mlp_long, search_specs
            search = mode == "thorough"
            oof, mmodel, own = mlp_long(Lc, model_feats, key, specs=search_specs() if search else None,
                                        max_epochs=mlp_epochs or (EPOCHS_SEARCH if search else EPOCHS_QUICK),
                                        inverse=yt.inverse)
            fitted = A.regression_metrics(own.withColumn("pred", yt.inverse("pred")), "y", "pred").first()
            cands["mlp"] = dict(oof=oof.withColumn("pred", yt.inverse("pred")),
                                train_r2=fitted["r2"], type="mlp", model=mmodel, importance=[])
    tree_kinds = [m for m in models if m in ("gbt", "rf", "xt")]
    if mode == "thorough":
        tree_kinds += [m for m in ("rf", "xt") if m not in tree_kinds]
    if model_feats and tree_kinds:
        cands.update(_trees_long(Lc, model_feats, key, tree_kinds, yt, n, tree_rounds))
    scores = []
    for name, c in cands.items():
        r = A.regression_metrics(c["oof"], "y", "pred").first()
        c["r2"] = float(r["r2"]) if r and r["n_rows"] else None
        scores.append((name, c["r2"]))
    blend_r2 = None
    if mode == "thorough" and len(cands) >= 2:
        wide = None
        for name, c in cands.items():
            p = c["oof"].select(key, "y", F.col("pred").alias(name))
            wide = p if wide is None else wide.join(p.drop("y"), key)
        names = list(cands)
        st2 = B.blend_stats(wide, "y", names)
        bl = B.fit_blend(st2, names, B.eligible_members(st2, names))
        if bl is not None:
            blend_r2 = bl.r2
            cands["blend"] = dict(oof=wide.select(key, "y", bl.expr().alias("pred")),
                                  r2=bl.r2, type="blend", train_r2=None,
                                  model={"type": "blend", "weights": bl.weights,
                                         "members": [dict(cands[m]["model"]) for m in bl.members]},
                                  importance=[])
    chosen = B.pick_model(scores, blend_r2)
    best = cands[chosen]
    for name in bl.members if chosen == "blend" else [chosen]:
        if cands[name]["type"] in ("kernel", "mlp") and not cands[name]["importance"]:
            cands[name]["importance"] = _permuted_shares(Lc, model_feats, key, cands[name]["model"], yt)
    if chosen == "blend":
        shares = [(m, x, float(p)) for m in bl.members for x, p in cands[m]["importance"]]
        best["importance"] = sorted(map(tuple, B.blend_importance(bl, spark.createDataFrame(
            shares, "model string, feature string, pct double")).collect()), key=lambda t: (-t[1], t[0]))

    # ---- post-processing (A15, A16, B7) ----
    is_int = enc.agg(S.is_integer_valued(target)).first()[0]
    pp = fit_postprocess(best["oof"].withColumnRenamed("y", "_y"), "_y", "pred", yt,
                         bool(is_int))
    post = PostProcess(pp.smear, pp.y_lo, pp.y_hi, pp.round_output)
    final_oof = best["oof"].withColumn("pred_post", post.apply("pred"))
    after = A.regression_metrics(final_oof, "y", "pred_post").first()

    meds = A.medians(enc, feats) if feats else {}
    for c in te_cols:
        meds[c] = te_maps[c]["default"]
    plan_obj = FittedPlan(
        target=target, features=model_feats, raw_columns=[c for c in raw_cols],
        onehot=levels, datetime=dt_cols, timestamps=ts_cols, numeric_text=numeric_text,
        target_maps=te_maps, composite=composite, x_clip={c: list(b) for c, b in xclip.items()
                                     if b[0] is not None}, recipe=recipe,
        medians=meds, y_transform={"kind": yt.kind, "lam": yt.lam},
        postprocess={"smear": pp.smear, "y_lo": pp.y_lo, "y_hi": pp.y_hi,
                     "round_output": pp.round_output},
        model=best["model"],
        reports={"chosen": chosen, "eval_kind": eval_kind, "n_rows": n,
                 "importance": best.get("importance", []), "dropped": dropped})
    cand_rows = [(nm, c.get("r2"), c["type"], nm == chosen,
                  c.get("train_r2")) for nm, c in cands.items()]
    cand_rows += [(nm, None, f"skipped:{why}", False, None) for nm, why in skipped.items()]
    candidates = spark.createDataFrame(cand_rows, "name string, r2 double, type string, "
                                                  "is_best boolean, train_r2 double")
    warn = []
    if n < 10:
        warn.append(("small_full_data", n))
    elif eval_kind == "oof":
        warn.append(("oof_eval_small_n" if n < SMALL_N_OOF else "oof_eval", n))
    if n_na:
        warn.append(("target_na_excluded", n_na))
    if n_changed:
        warn.append(("outliers_corrected", n_changed))
    if winsor_skipped:
        warn.append(("winsorize_skipped_cv", 0))
    if n_dup:
        warn.append(("duplicate_rows", int(n_dup)))
    if dropped:
        warn.append(("cat_cols_dropped", len(dropped)))
    warnings = spark.createDataFrame(warn or [("none", 0)], "code string, n long")
    summary = spark.createDataFrame(
        [(chosen, float(after["r2"]), best.get("r2"), float(after["rmse"]),
          float(after["mae"]), eval_kind, int(after["n_rows"]))],
        "model string, r2 double, r2_raw double, rmse double, mae double, eval_on string, "
        "eval_rows long")
    return TrainResult(plan_obj, candidates, final_oof, warnings, summary)


def _trial(p: dict, rounds: int | None) -> dict:
    return p | {"n_estimators": min(rounds, p["n_estimators"])} if rounds else p


def _derived_features(enc: DataFrame, feats, target: str, st, n: int, rounds: int | None):
    """E1 + E2: candidates over <= 12 raw features (the 12 with the largest
    |r| with the target when there are more), products of pairs, squares,
    sign(a) when a takes both signs; drop non-finite or constant ones (one
    aggregate); keep <= 15 with split importance > 0 from a boosted model on
    raw + candidates. Selected on all rows (the reference refits per fold)."""
    from ..operators.encode import apply_recipe, candidate_recipe, candidate_stats
    from ..operators.select import top_k_by_corr
    raw = [c for c in feats if "==" not in c and "__" not in c]
    if len(raw) > FE_MAX_RAW:
        raw = top_k_by_corr(enc, raw, target, FE_MAX_RAW)
    if not raw:
        return enc, [], feats
    signs = {c: (st[f"{c}__min"] is not None and st[f"{c}__min"] < 0 < st[f"{c}__max"])
             for c in raw}
    cands = [r for r in candidate_recipe(raw, signs) if r[0] not in enc.columns]
    if not cands:
        return enc, [], feats
    cs = {r["feature"]: r for r in candidate_stats(enc, cands).collect()}
    ok = [r for r in cands if cs[r[0]]["n_finite"] and cs[r[0]]["std"] is not None
          and cs[r[0]]["std"] >= 1e-12]
    if not ok:
        return enc, [], feats
    safe = {r[0]: f"_d{i}" for i, r in enumerate(ok)}
    tmp = apply_recipe(enc, ok).select(
        target, *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(raw)],
        *[F.col(f"`{nm}`").alias(safe[nm]) for nm in safe])
    kept_safe = TR.engineered_features(tmp, [f"_r{i}" for i in range(len(raw))],
                                       list(safe.values()), target, n_rows=n, params=_trial(TR.FE_PARAMS, rounds))
    back = {v: k for k, v in safe.items()}
    kept = [back[s] for s in kept_safe]
    recipe = [r for r in ok if r[0] in kept]
    return apply_recipe(enc, recipe), [list(r) for r in recipe], feats + kept


def _shares(coef: dict) -> list:
    tot = max(sum(abs(v) for v in coef.values()), 1e-9)
    return sorted([(k, round(abs(v) / tot * 100, 1)) for k, v in coef.items()],
                  key=lambda t: -t[1])


def _permuted_shares(L: DataFrame, feats, key: str, model: dict, yt: YTransform) -> list:
    """M12 shares in percent of a final model without importances of its own,
    on the rows it learned from."""
    own = L.where((F.col(LF.MODEL) == -1) & ~F.col(LF.VAL))
    found = shift_importance(own, feats, "_yraw", key,
                             lambda d: _member(d, model, feats, "pred").withColumn("pred", yt.inverse("pred")))
    return [(r["feature"], float(r["pct"]))
            for r in feature_shares(found, value="importance", top=None).orderBy("rank").collect()]


def _trees_long(L: DataFrame, feats, key: str, kinds, yt, n: int, rounds: int | None) -> dict:
    """Trees on the long frame, all kinds and models in the same passes: model
    m learns from its own copies of the training rows and predicts its
    validation rows; the final model (m = -1) and the fold bag go to the plan."""
    models = sorted(r[0] for r in L.select(LF.MODEL).distinct().collect())
    safe = [f"_f{i}" for i in range(len(feats))]
    base = L.select(LF.MODEL, LF.VAL, F.col(key).alias("_k"), "_yraw", F.col("_yfit").alias("_yt"),
                    *[named(x).alias(s) for x, s in zip(feats, safe)])
    trains = base.where(~F.col(LF.VAL))
    jobs = []
    for kind in kinds:
        p = dict(TR.QUICK_PARAMS if kind == "gbt" else TR.FOREST_PARAMS[kind])
        p["n_estimators"] = rounds or p["n_estimators"]
        jobs += [(m, p, "final" if kind == "gbt" and m == -1 and len(models) > 1 else kind, 0) for m in models]
    found = iter(TR.fit_jobs(trains, safe, ["_yt"], "_k", LF.MODEL, jobs, n, own=True))
    out = {}
    for kind in kinds:
        fitted = {m: next(found) for m in models}
        # the training rows are scored where there is no split
        held = base.where(F.col(LF.VAL)) if len(models) > 1 else base
        oof = boost.predictions(held, safe, fitted, "_k", LF.MODEL, keep=["_yraw"])
        oof = oof.select(F.col("_k").alias(key), F.greatest(F.col(LF.MODEL), F.lit(0)).alias("fold"),
                         F.col("_yraw").alias("y"), yt.inverse("pred").alias("pred"))
        tr = boost.predictions(trains.where(F.col(LF.MODEL) == -1), safe, fitted, "_k", LF.MODEL, keep=["_yraw"])
        r = A.regression_metrics(tr.withColumn("pred", yt.inverse("pred")), "_yraw", "pred").first()
        for m in fitted.values():
            m.features = list(feats)
        final = {"type": "trees", "model": fitted[-1].to_dict()}
        if kind == "gbt" and len(models) > 1:      # M5: fold models as an equal-weight bag (B6)
            final["bag"] = {"type": "bag", "members": [{"type": "trees", "model": fitted[m].to_dict()}
                                                       for m in models if m >= 0]}
        out[kind] = dict(oof=oof, type=kind, train_r2=float(r["r2"]) if r and r["n_rows"] else None,
                         importance=TR.shares_from_counts(fitted[-1].split_counts()), model=final)
    return out


def predict(plan: FittedPlan, df: DataFrame) -> DataFrame:
    """The reference's ``predict``: score a table with a fitted plan."""
    return plan.score(df)


def predict_file(plan: FittedPlan, spark, path: str, fmt: str = "csv") -> str:
    """Read a table, score it and write it beside the input as
    ``<stem>_predicted``; returns that path. CSV goes out as UTF-8 with BOM."""
    out = predicted_path(path)
    write_scored(predict(plan, read_table(spark, path, fmt)), out, fmt)
    return out
