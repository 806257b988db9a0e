"""Cross-validation as data (inventory V1-V6).

The fold assignment is an integer ``fold`` column; "all rows but fold k"
statistics are either total-minus-fold (additive) or computed on rows
exploded to the k-1 folds they train (non-additive, e.g. percentiles).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_rank
from .quantiles import ALL, quantiles_of
from .stats import quantiles

# ---- fixed values ----
FOLD_SEED = 42
ES_SPLIT_SEED = 20260716
ES_VAL_FRAC = 0.1
ES_MIN_TRAIN_ROWS = 20
MIN_ROWS_FOR_SPLIT = 10
SMALL_N_OOF = 50
INNER_K = 5          # inner CV folds of the ridge alpha search
# ----------------------


def n_bins_for(n_rows: int, k: int = 5) -> tuple[int, int]:
    """V1: (folds wanted A, quantile bins E) for ``n_rows``."""
    a = max(2, min(k, n_rows // 2))
    e = min(a, max(2, n_rows // 10))
    return a, e


def bin_edges(df: DataFrame, y: str, n_bins: int) -> list:
    """Sorted distinct quantile edges (0, 1/E, ..., 1)."""
    q = quantiles(df, [y], [i / n_bins for i in range(n_bins + 1)])[y] or []
    return sorted(set(q))


def bin_of(y: str, edges: Column) -> Column:
    """Bin index = number of *interior* distinct edges strictly below y
    (right-closed bins, the lowest edge included in bin 0)."""
    return F.size(F.filter(edges, lambda e, i: (i > 0) & (i < F.size(edges) - 1)
                           & (e < F.col(y)))).cast("int")


def quantile_bins(df: DataFrame, y: str, n_bins: int, out: str = "bin") -> DataFrame:
    """V1: quantile bin column. The <= n_bins + 1 edges are computed once and
    enter the plan as literals (no lazily repeated aggregate)."""
    edges = bin_edges(df, y, n_bins)
    lit = F.array(*[F.lit(float(e)) for e in edges]) if edges else \
        F.array().cast("array<double>")
    return df.withColumn(out, bin_of(y, lit))


@dataclass
class FoldPlan:
    kind: str          # "stratified" or "kfold"
    n_folds: int
    n_rows: int


def assign_folds(df: DataFrame, y: str, key: str, k: int = 5, seed=FOLD_SEED,
                 n_rows: int | None = None):
    """V1-V3: stratified folds over quantile bins of y, else plain K-fold.

    Returns (frame with ``bin``, ``fold`` and ``ifold`` columns, FoldPlan). The
    edges come from additive bucket counts; per-(bin, md5 bucket) counts also
    give the bin sizes, and the ranking is the last pass."""
    n = n_rows if n_rows is not None else df.count()
    a, e = n_bins_for(n, k)
    binned = quantile_bins(df, y, e)
    ranked, cnt = hash_rank(binned, key, seed, partition_cols=["bin"], out="_pos", n_rows=n,
                            return_counts=True)
    sizes = [r["s"] for r in cnt.groupBy("bin").agg(F.sum("_cnt").alias("s")).collect()]
    smallest = min(sizes) if sizes else 0
    g = min(a, smallest)
    if g >= 2:
        # inner folds for nested CV come free from the same rank: inside a
        # bin, the rows of fold f in md5 order are those with pos = f mod g,
        # so pos // g deals them round-robin again (balanced per bin x fold)
        out = ranked.withColumns({
            "fold": F.pmod(F.col("_pos"), F.lit(g)).cast("int"),
            "ifold": F.pmod(F.floor(F.col("_pos") / g), F.lit(INNER_K)).cast("int")}) \
            .drop("_pos", "_pos_n")
        return out, FoldPlan("stratified", g, n)
    kk = max(2, min(a, n))
    return kfold(binned, key, kk, seed, n_rows=n), FoldPlan("kfold", kk, n)


def ntile_of(pos: Column, n: Column, k: int) -> Column:
    """0-based ``ntile(k)`` bucket of 0-based position ``pos`` among ``n``:
    the first n % k buckets hold one extra row (array_split semantics)."""
    q = F.floor(n / F.lit(k))
    r = n - q * k
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
        r + F.floor((pos - big) / F.greatest(q, F.lit(1)))).cast("int")


def kfold(df: DataFrame, key: str, k: int, seed=FOLD_SEED, n_rows=None,
          out: str = "fold") -> DataFrame:
    """V3: shuffled contiguous near-equal pieces = ntile over the md5 order."""
    ranked = hash_rank(df, key, seed, out="_pos", n_rows=n_rows)
    return ranked.withColumns({out: ntile_of(F.col("_pos"), F.col("_pos_n"), k),
                               "ifold": F.pmod(F.col("_pos"), F.lit(INNER_K)).cast("int")}) \
                 .drop("_pos", "_pos_n")


def fold_count(n_rows: int, oof: bool) -> int:
    """V4: OOF uses 10 folds under 100 rows, else 5; holdout uses 5 (fold 0
    validates); < 10 rows: no split (0)."""
    if n_rows < MIN_ROWS_FOR_SPLIT:
        return 0
    if oof:
        return 10 if n_rows < 100 else 5
    return 5


def stop_masks(df: DataFrame, key: str, fold: str, folds, own: bool = False) -> Column:
    """V6 as a cut: bit f of the mask is set for the early-stopping rows of the
    model without fold f (``own``: of the model on fold f): a tenth of its
    training rows, those of the smallest md5 numbers. The cut is one order
    statistic a fold, found from counts and written into the plan, so no row is
    copied, ranked or joined; rows of one key stay on one side of it."""
    def trains(f):
        return (F.col(fold) == f) if own else (F.col(fold) != f)

    def number(f):
        digest = F.md5(F.concat(F.lit(f"{ES_SPLIT_SEED + f}|"), F.col(key).cast("string")))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")      # 52 bits: exact in a double

    def last(n):
        held = max(1, round(n * ES_VAL_FRAC))
        return [held - 1] if n >= ES_MIN_TRAIN_ROWS and n - held >= 10 else [-1]

    wanted = {f"h{f}": F.when(trains(f), number(f)) for f in folds if f >= 0}
    if not wanted:
        return F.lit(0).cast("long")
    cuts = quantiles_of(df, wanted, lambda n: [max(0, x) for x in last(n)])[ALL]
    n_of = df.groupBy(fold).count().collect()
    total = sum(r["count"] for r in n_of)
    size = {r[fold]: r["count"] for r in n_of}
    mask = F.lit(0).cast("long")
    for f in folds:
        if f >= 0 and last(size.get(f, 0) if own else total - size.get(f, 0))[0] >= 0:
            mask = mask + F.when(trains(f) & (number(f) <= cuts[f"h{f}"][0]), F.lit(1 << f)).otherwise(0)
    return mask.cast("long")


def es_holdout(df: DataFrame, key: str, fold: str, k: int, out: str = "es_val") -> DataFrame:
    """V6: early-stopping split inside each fold's training part: for the
    model of fold f, round-half-even 10 % (>= 1 row) of its training rows, the
    first in md5 order with seed ES_SPLIT_SEED + f; only when the training part
    has >= 20 rows and >= 10 remain. Long form: (key, train_fold, es_val), made
    from the masks row by row, without a shuffle."""
    held = df.select(key, fold, stop_masks(df, key, fold, range(k)).alias("_mask"))
    long = train_copies(held, fold, k, out="train_fold")
    return long.withColumn(out, F.getbit("_mask", "train_fold") == 1).drop("_mask")


def train_copies(df: DataFrame, fold: str, k: int, out: str = "train_fold",
                 include_all: bool = False) -> DataFrame:
    """V5: each row repeated for every fold whose model it trains
    (``include_all`` adds copy -1 = all rows, for the final fit)."""
    seq = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    if include_all:
        seq = F.concat(F.array(F.lit(-1)), seq)
    return df.withColumn(out, F.explode(seq))
