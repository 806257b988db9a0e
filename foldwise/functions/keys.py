"""Row keys and deterministic "which rows" order.

Spark tables have no row order, so every operator that needs positions takes a
key column and orders by ``md5('<seed>|<key>')`` then key. Both engines compute
the same md5 text, so folds and samples are oracle-checkable.

``hash_rank`` is a distributed ``row_number``: a plain window ordered over a
whole group would pull the group into one task. md5 is uniform, so a prefix of
the hex digest splits each group into equal-sized salt buckets that are
consistent with the md5 order; ranks are bucket offsets (a small table) plus a
row number inside the bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Integer text for every column of the eight-column lineitem key (doubles go
# through cents, the date through epoch days) so both engines print it alike.
KEY_SQL = {
    "lineitem": ("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                 "cast(round(l_extendedprice * 100) as bigint), "
                 "cast(round(l_discount * 100) as bigint), "
                 "cast(round(l_tax * 100) as bigint), "
                 "unix_date(cast(l_shipdate as date)))"),
    "conversations": "concat_ws('|', conv_id, turn)",
}
KEY_SQL_DUCKDB = {
    "lineitem": ("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                 "cast(round(l_extendedprice * 100) as bigint), "
                 "cast(round(l_discount * 100) as bigint), "
                 "cast(round(l_tax * 100) as bigint), "
                 "date_diff('day', DATE '1970-01-01', cast(l_shipdate as date)))"),
    "conversations": "concat_ws('|', conv_id, turn)",
}
FIRST_COL_KEY = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "labels": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
}


def key_expr(table: str) -> Column:
    """Row key of a driver table as a string column."""
    if table in KEY_SQL:
        return F.expr(KEY_SQL[table])
    return F.col(FIRST_COL_KEY[table]).cast("string")


def key_sql(table: str) -> str:
    """The same key for DuckDB oracle SQL."""
    if table in KEY_SQL_DUCKDB:
        return KEY_SQL_DUCKDB[table]
    return f"cast({FIRST_COL_KEY[table]} as varchar)"


def md5_order(key, seed) -> Column:
    """md5('<seed>|<key>'); ``seed`` may be a value or a column (per-group
    seeds, e.g. seed + fold)."""
    k = F.col(key) if isinstance(key, str) else key
    if isinstance(seed, Column):
        return F.md5(F.concat(seed.cast("string"), F.lit("|"), k.cast("string")))
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def md5_order_sql(key_sql_text: str, seed) -> str:
    return f"md5(concat('{seed}|', cast({key_sql_text} as varchar)))"


def salt_digits(n_rows: int | None, rows_per_bucket: int = 500_000) -> int:
    """Hex digits of md5 used as salt so that a bucket holds about
    ``rows_per_bucket`` rows (2 to 6 digits: at most 16.7 M buckets, so the
    per-(group, bucket) offset table stays far smaller than the data)."""
    if not n_rows or n_rows <= 0:
        return 3
    need = max(1.0, n_rows / rows_per_bucket)
    return int(min(6, max(2, math.ceil(math.log(need, 16)))))


def hash_rank(df: DataFrame, key: str, seed, partition_cols=(), out: str = "rn",
              n_rows: int | None = None, return_counts: bool = False):
    """Add ``out`` = 0-based position of each row inside ``partition_cols``
    in the order (md5(seed|key), key). Also adds ``<out>_n`` = group size.

    Work is split by md5-prefix salt buckets so no task sorts a whole group;
    the per-(group, bucket) count table has at most groups * 16^digits rows.
    """
    part = list(partition_cols)
    digits = salt_digits(n_rows)
    h = md5_order(key, seed)
    # non-nullable salt: no inferred IS NOT NULL filter re-hashing every key
    d = (df.withColumn("_h", h)
           .withColumn("_salt", F.coalesce(
               F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"), F.lit(0).cast("long"))))
    counts = d.groupBy(*part, "_salt").agg(F.count(F.lit(1)).alias("_cnt"))
    if return_counts:      # callers reuse the per-(group, bucket) counts: write
        from ..session import cut_lineage     # them once (reliable checkpoint)
        counts = cut_lineage(counts)
    w = (Window.partitionBy(*part).orderBy("_salt") if part
         else Window.orderBy("_salt"))
    offsets = counts.select(
        *part, "_salt",
        (F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding,
                                         Window.unboundedFollowing)).alias(f"{out}_n"))
    offsets = offsets.fillna({"_off": 0})
    wb = Window.partitionBy(*part, "_salt").orderBy("_h", key)
    res = (d.join(offsets, on=[*part, "_salt"], how="inner")
             .withColumn(out, (F.col("_off") + F.row_number().over(wb) - 1).cast("long"))
             .drop("_h", "_salt", "_off"))
    return (res, counts) if return_counts else res
