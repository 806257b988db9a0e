"""How filters interact: what each removes, alone, in any order and on average.

Every document gets a mask of the filters it fails. The documents removed by a
coalition of filters, v(S), are those whose mask meets S; a part (a language)
needs just its counts of the 2**n masks. The Hart-Mas-Colell potential of the
removal game is P(S) = (v(S) + sum of P(S without i) over its members) / |S|,
and the Shapley value of filter i is P(all) - P(all without i). Differences of v
along an order are the steps of that order. Counts stay whole numbers: the
recursion runs on Q(S) = |S|! * P(S) = (|S| - 1)! * v(S) + sum of Q(S without i).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, written

SALTS = 32
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions by which a text (null: empty) fails: A under 200 words, B
    fewer than half of the words distinct, C over 3 % of A-Z among the code
    points, D one of ``#$%&*|``."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals.cast("long") > 3 * F.length(t).cast("long"),
            "D": t.rlike("[#$%&*|]")}


def _mask(fails: dict[str, Column], bits: dict[str, int]) -> Column:
    mask = F.lit(0)
    for name, condition in fails.items():
        mask = mask + F.when(condition, F.lit(1 << bits[name])).otherwise(0)
    return mask.cast("int")


def repeated(rows: DataFrame, bit: int) -> DataFrame:
    """Counted rows (_id, _part, _mask, _sha, _n) with ``bit`` added to the
    masks of those whose digest a smaller identifier has too. A class of any
    size meets its smallest identifier part by part."""
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")
    rows = rows.select("*", salt)
    low = rows.groupBy("_sha", "_salt").agg(F.min("_id").alias("_low"))
    parts = low.groupBy("_sha").agg(F.min("_low").alias("_low"), F.collect_set("_salt").alias("_salts"))
    low = parts.select("_sha", "_low", F.explode("_salts").alias("_salt"))
    later = F.coalesce(F.col("_low") < F.col("_id"), F.lit(False))
    return rows.join(low, ["_sha", "_salt"]).withColumn(
        "_mask", F.col("_mask") + F.when(later, F.lit(bit)).otherwise(0)).drop("_low", "_salt")


def failure_counts(docs: DataFrame, labels: DataFrame | None = None, ident: str = "doc_id", text: str = "text",
                   part: str = "lang", fails: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of
    filters they fail, a bit a filter in the order of their names.

    ``fails`` names the conditions on one row, ``copies`` the filter for a text
    that a smaller identifier has too, anywhere in the table. Null text counts
    as empty, a null part is ''. A document without identifier is no copy and
    makes none; rows that repeat a document, identifier too, count as often as
    they are there and are no copies of each other. ``labels`` (the identifier,
    quality, toxic) may name a document more than once: one row with 1 is
    enough; without a label, or with null, it is neither good nor toxic. Other
    columns are not read; an empty table gives no rows."""
    fails = fails or text_failures(F.col(text))
    bits = {name: 1 << k for k, name in enumerate(sorted([*fails, copies]))}
    shift = {name: b.bit_length() - 1 for name, b in bits.items()}
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flags = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
                        _mask(fails, shift).alias("_mask"), F.unhex(F.sha2(t, 256)).alias("_sha"))
    flags = written(flags.groupBy("_id", "_part", "_mask", "_sha").agg(F.count(F.lit(1)).alias("_n")), "flags")
    rows = repeated(flags, bits[copies]).groupBy("_id", "_part", "_mask").agg(F.sum("_n").alias("_n"))
    zero = F.lit(0)
    if labels is None:
        named = rows.withColumns({"_good": zero, "_toxic": zero})
    else:
        marks = labels.groupBy(F.col(ident).alias("_id")).agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
        named = rows.join(marks, "_id", "left")
    return named.groupBy(F.col("_part").alias("part"), F.col("_mask").alias("mask")).agg(
        F.sum("_n").alias("n"), *[F.sum(F.col("_n") * F.coalesce(F.col(f"_{m}"), zero)).cast("long").alias(m)
                                  for m in MEASURES[1:]])


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """One row a part: for each measure an array of 2**n counts, the documents
    that a coalition of filters (its number: the sum of their bits) removes."""
    size = 1 << n
    cells = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.array(*[F.sum(F.when(F.col("mask") == k, F.col(m)).otherwise(0)) for k in range(size)]).alias(m)
          for m in MEASURES])
    game = "transform(sequence(0, {0}), s -> aggregate(sequence(0, {0}), 0L, (a, k) -> a + if((k & s) <> 0, {1}[k], 0L)))"
    return cells.select("part", "total", *[F.expr(game.format(size - 1, m)).alias(m) for m in MEASURES])


def potentials(game: str, n: int) -> Column:
    """|S|! times the potential of every coalition S, from the array ``game``
    of its values: a coalition comes after all of its subsets."""
    rest = (f"aggregate(filter(sequence(0, {n - 1}), i -> (s & shiftleft(1, i)) <> 0), 0L, "
            "(a, i) -> a + q[s - shiftleft(1, i)])")
    return F.expr(f"aggregate(sequence(1, {(1 << n) - 1}), array(0L), "
                  f"(q, s) -> array_append(q, factorial(bit_count(s) - 1) * {game}[s] + {rest}))")


def order_audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (the Shapley value of the
    step's filter, times the number of orders). ``letters`` names the filters,
    sorted, at most six."""
    n = len(letters)
    full = (1 << n) - 1
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(letters))), ",")
    game = coalitions(counts, n).withColumn("q", potentials("n", n))
    rows = (game.withColumn("filter_order", F.explode(orders))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    bit = f"shiftleft(1, instr('{letters}', substr(filter_order, {{}}, 1)) - 1)"
    rows = rows.withColumns({
        "own": F.expr(bit.format("step")),
        "after": F.expr(f"aggregate(sequence(1, step), 0, (m, i) -> m + {bit.format('i')})")})
    rows = rows.withColumn("before", F.col("after") - F.col("own"))

    def lost(measure: str) -> Column:
        return F.col(measure)[F.col("after")] - F.col(measure)[F.col("before")]

    v, q = F.col("n"), F.col("q")
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - v[F.col("after")]).alias("kept"), lost("n").alias("removed"),
        (v[F.col("own")] - lost("n")).alias("redundant"),
        (v[full] - v[full - F.col("own")]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (q[full] - n * q[full - F.col("own")]).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame | None = None, **names) -> DataFrame:
    """:func:`order_audit` of the five filters of :func:`failure_counts`, with
    its rules for nulls, repeated rows and empty tables."""
    return order_audit(failure_counts(docs, labels, **names), "ABCDE")


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT d.doc_id, part,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
                    FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY part, fails),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, e.x, h.x] AS o FROM letters a, letters b, letters c, letters e, letters h
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
s AS (
  SELECT part, o, step, o[step] AS own, fails[o[step]] AS hit,
         len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS many, n, good, toxic FROM g, steps),
r AS (
  SELECT part, o, step, own,
         sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, o, step, own)
SELECT part, list_aggregate(list_transform(o, lambda i: chr(64 + i)), 'string_agg', '') AS filter_order, step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
