"""Exact deduplication by a tree merge of sorted digest runs.

Every document gets a digest and belongs to one of ``2**levels`` runs. A run
is a table sorted by digest with one entry a digest: the identifier to keep
and the number of copies. In each binomial round neighbouring runs meet
(``run >> step``), and equal digests are merged into one entry. At the root one
entry a digest is left; the answer goes back down the same tree, where each
entry meets at most ``2**step`` entries of the next finer level. No key ever
gathers more than the copies within one run, so a group that holds a third of
all rows is dealt over all runs on the way up and on the way down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, fresh, numbered, partitions, written

KEY = ["_sha", "_len", "_check"]


def _levels(df: DataFrame) -> int:
    n = partitions(df.sparkSession)
    return max(6, (n - 1).bit_length() + 2)


def _order(ident: str, keep: str, *ties: Column) -> Column:
    """What the largest entry of a class is taken by: null identifiers last,
    then the largest (or smallest) identifier."""
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    i = F.col(ident)
    return F.struct(i.isNotNull().alias("known"), (i if keep == "max" else -i).alias("rank"),
                    i.alias("ident"), *ties)


def digest_run(rows: DataFrame, text: str, order: Column, seed: Column, levels: int) -> DataFrame:
    """One row a document: ``_keep`` (its order), the digest of the normalised
    text (SHA-256, byte length and an independent 64-bit hash, which verify
    each other) and its run, dealt by ``seed``. Null text counts as empty."""
    t = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return rows.select(order.alias("_keep"), seed.alias("_seed"), t.alias("_t")).select(
        "_keep", F.unhex(F.sha2(F.col("_t"), 256)).alias("_sha"),
        F.octet_length("_t").cast("long").alias("_len"), F.xxhash64("_t").alias("_check"),
        F.expr(f"cast(pmod(xxhash64(_seed, 7L), {1 << levels}) as int)").alias("_run"))


def merge_runs(run: DataFrame, step: int) -> DataFrame:
    """One round: runs whose number agrees after ``>> step`` are merged."""
    return (run.withColumn("_run", F.shiftright("_run", step)).groupBy(*KEY, "_run")
            .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n")))


def tree(flat: DataFrame, levels: int, step: int) -> tuple[list[DataFrame], list[int]]:
    """The runs at every level, finest first, and the step between levels."""
    up = [flat.groupBy(*KEY, "_run").agg(F.max("_keep").alias("_keep"),
                                         F.count(F.lit(1)).alias("_n"))]
    steps, left = [], levels
    while left:
        steps.append(min(step, left))
        left -= steps[-1]
        up[-1] = written(up[-1], "runs")
        up.append(merge_runs(up[-1], steps[-1]))
    return up, steps


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "max",
                levels: int | None = None, step: int = 3) -> DataFrame:
    """Classes of equal texts, one row a document.

    Returns ``ident``, keep_id (of the copy that stays), group_size, kept,
    text_sha256. Texts are equal when they agree after lower-casing A-Z.
    ``keep``: the "max" or "min" (numeric) identifier. Null text counts as
    empty; a null identifier stays only if its whole class has none. Repeated
    rows that carry the staying identifier all read kept = true; use
    :func:`drop_copies` for exactly one row a class. An empty table gives an
    empty table; columns other than the two named are not read. ``levels``:
    log2 of the number of runs (default: four or more runs a shuffle
    partition), ``step``: log2 of the number of runs that meet in a round."""
    levels = levels or _levels(docs)
    flat = written(digest_run(docs, text, _order(ident, keep), F.col(ident), levels), "digests")
    up, steps = tree(flat, levels, step)
    down = up.pop().select(*KEY, F.col("_run").alias("_up"), "_keep", "_n")
    for entries, s in zip(reversed(up), reversed(steps)):
        here = entries.select(*KEY, "_run").withColumn("_up", F.shiftright("_run", s))
        down = here.join(down, [*KEY, "_up"]).select(*KEY, F.col("_run").alias("_up"), "_keep", "_n")
    own, best = F.col("_own.ident"), F.col("_keep.ident")
    return (flat.withColumnsRenamed({"_run": "_up", "_keep": "_own"}).join(down, [*KEY, "_up"])
            .select(own.alias(ident), best.alias("keep_id"), F.col("_n").alias("group_size"),
                    own.eqNullSafe(best).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))


def drop_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "max",
                levels: int | None = None, step: int = 3) -> DataFrame:
    """``docs`` with exactly one row of each class of equal texts, all columns
    kept; null and tie rules as in :func:`exact_dedup`. Rows of one class that
    carry the same identifier are told apart by :func:`numbered`."""
    levels = levels or _levels(docs)
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    order = _order(ident, keep, F.col(row).alias("row"))
    up, _ = tree(digest_run(rows, text, order, F.col(row), levels), levels, step)
    stay = up[-1].select(F.col("_keep.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
