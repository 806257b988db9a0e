"""Mixing sources to target weights.

Sizes are word counts. A source's target is its share by weight of the whole
budget, held at ``max_epochs`` times its size, with the excess shared again.
Each document has a hash-random key. Within a source the keys are dealt to
ranges (the leading bits of the key); range sums and their running totals
show, for the last epoch, the one range in which the budget runs out. Ranges
before it are taken whole and those after it not at all; only within it are
documents sorted and added up one by one, until the budget is met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, fresh, numbered, partitions, word_count, written

SALTS = 32
KEY_HEX = 15


def source_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """Targets from one row a source (``_null``, ``_src``, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn. The
    targets add up to ``share`` times all sizes. A target above ``max_epochs``
    times its source's size is held there and the excess goes to the others by
    weight, until none is above: in order of (limit / weight), a source is held
    exactly if the limits before it, plus its own ratio times all weights from
    it on, stay below the budget. The table has a row a source, so it is small
    beside the documents; the two windows below run over it alone."""
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_i") % n + 1).cast("int"))
    by_code = Window.orderBy("_null", "_src")
    s = (sources.withColumn("_i", F.row_number().over(by_code) - 1).withColumn("weight", w)
         .withColumn("_limit", F.col("source_size") * max_epochs)
         .withColumn("_ratio", F.col("_limit") / F.col("weight")))
    order = Window.orderBy("_ratio", "_i")
    every = Window.partitionBy()
    s = (s.withColumn("_before", F.coalesce(F.sum("_limit").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("_held", F.col("_before") + F.col("_ratio") * F.col("_rest") < F.col("_budget"))
         .withColumn("_free", F.sum(F.when(~F.col("_held"), F.col("weight"))).over(every))
         .withColumn("_left", F.col("_budget") - F.coalesce(
             F.sum(F.when(F.col("_held"), F.col("_limit"))).over(every), F.lit(0))))
    target = F.when(F.col("_held"), F.col("_limit").cast("double")).otherwise(
        F.least(F.col("_left") / F.col("_free") * F.col("weight"), F.col("_limit").cast("double")))
    return s.select("_null", "_src", "source_size", "weight", target.alias("target"))


def random_key(ident: Column, seed: int) -> Column:
    """A hash-random whole number below 16**15, the same in every run."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_HEX), 16, 10).cast("long")


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source",
        weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 42,
        carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """What the mix takes of every document: ``ident``, size, source_size,
    target (of its source), taken (words, repeats counted), ``source`` and the
    ``carry`` columns.

    Every document is taken ``target // source size`` times whole; the rest of
    the target, rounded to words, is filled in the order of the random keys
    (ties by identifier, size and the text's hash), and the document at the cut
    is taken in part, so a source's total is its rounded target. With
    ``whole`` that document is taken whole if half of it or more lies before
    the cut, else not. Null text and empty text have size 0 and are never
    taken; a source without words has target 0; null is a source of its own;
    an empty table gives an empty table."""
    spark = docs.sparkSession
    buckets = 4 * max(64, partitions(spark))
    width = -(-16 ** KEY_HEX // buckets)
    src = F.col(source).cast("string")
    rows = written(docs.select(
        F.col(ident).alias("_id"), F.col(source).alias("_source"), src.isNull().alias("_null"),
        F.coalesce(src, F.lit("")).alias("_src"), word_count(F.col(text)).alias("size"),
        random_key(F.col(ident), seed).alias("_key"), F.xxhash64(F.col(text)).alias("_tie"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry or []])
        .withColumn("_bucket", F.floor(F.col("_key") / F.lit(width)).cast("int")), "sizes")
    ranges = written(rows.groupBy("_null", "_src", "_bucket").agg(F.sum("size").alias("_words")), "ranges")
    targets = source_targets(ranges.groupBy("_null", "_src").agg(F.sum("_words").alias("source_size")),
                             weights, share, max_epochs)
    size = F.col("source_size")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    plan = (targets.withColumn("_epochs", F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("long"))
            .withColumn("_rest", goal - F.col("_epochs") * size))
    run = Window.partitionBy("_null", "_src").orderBy("_bucket")
    cut = (ranges.withColumn("_before", F.sum("_words").over(run) - F.col("_words"))
           .join(plan, ["_null", "_src"])
           .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
           .select("_null", "_src", F.col("_bucket").alias("_cut"), F.col("_rest") - F.col("_before")))
    cut = cut.toDF("_null", "_src", "_cut", "_open")
    plan = written(plan.join(cut, ["_null", "_src"], "left"), "plan")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (rows.withColumn("_salt", (F.col("_key") % SALTS).cast("int"))
            .join(salted, ["_null", "_src", "_salt"]))
    at_cut = F.col("_bucket") == F.col("_cut")
    within = Window.partitionBy("_null", "_src", "_bucket").orderBy("_key", "_id", "size", "_tie")
    part = (rows.where(at_cut)
            .withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_start", F.col("_end") - F.col("size")))
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_open") - F.col("_start")))
    if whole:
        some = F.when(F.col("_start") * 2 + F.col("size") <= F.col("_open") * 2, F.col("size")).otherwise(0)
    part = part.withColumn("_last", some.cast("long")).drop("_end", "_start")
    rest = rows.where(~at_cut | F.col("_cut").isNull()).withColumn(
        "_last", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0).cast("long"))
    out = rest.unionByName(part)
    return out.select(
        F.col("_id").alias(ident), F.col("size"), F.col("source_size"), F.col("target"),
        (F.col("size") * F.col("_epochs") + F.col("_last")).cast("long").alias("taken"),
        F.col("_source").alias(source),
        *[F.col(f"_carry_{c}").alias(c) for c in carry or [] if c not in (ident, source)])


def mixed_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The documents of the mix, all columns kept: a document taken twice gives
    two rows, one not taken gives none, and each is whole (``whole=True``).
    Documents without words have nothing to take and give none. Rows of equal
    identifier are told apart by :func:`numbered`."""
    row, times, copy = fresh(docs, "_row"), fresh(docs, "_times"), fresh(docs, "_copy")
    rows = numbered(docs, row)
    plan = mix(rows, ident, text, whole=True, carry=[row], **params)
    plan = plan.where("taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(times))
    copies = F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)
    return rows.join(plan, row).select(*docs.columns, copies).select(*docs.columns)


#: The same mix in SQL, for one document row an identifier.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {KEY_HEX}) AS BIGINT) AS k
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS wt,
             row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
r AS (SELECT *, 2 * ss AS lim, CAST(2 * ss AS DOUBLE) / wt AS ratio, 1.5 * CAST(sum(ss) OVER () AS DOUBLE) AS budget FROM w),
h AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + ratio * sum(wt) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < budget AS held FROM r),
t AS (SELECT source, ss, CASE WHEN held THEN CAST(lim AS DOUBLE) ELSE least(
        (budget - coalesce(sum(lim) FILTER (held) OVER (), 0)) / CAST(sum(wt) FILTER (NOT held) OVER () AS DOUBLE) * wt,
        CAST(lim AS DOUBLE)) END AS target FROM h),
p AS (SELECT source, ss, target, CASE WHEN ss > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // ss ELSE 0 END AS epochs,
             CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
c AS (SELECT d.*, ss, target, epochs, goal - epochs * ss AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size) - size AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, ss AS source_size, target,
       CAST(size * epochs + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM c
"""
