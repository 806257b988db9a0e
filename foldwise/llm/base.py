"""Shared helpers of the subpackage: written intermediate tables, ASCII
lower-casing and word patterns as Spark expressions."""

from __future__ import annotations

import uuid
from contextlib import AbstractContextManager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, setting

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of characters that are neither a space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Whole texts that a Python worker is sent at a time: both sides hold a batch.
TEXT_ROWS = 2000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder of
    ``spark.checkpoint.dir`` and read it back: later steps start from the
    table, also after executors are lost, and rows keep the values they got."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """For jobs run within: at most ``TEXT_ROWS`` rows an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name))
    return setting(spark, name, str(min(have, TEXT_ROWS) if have > 0 else TEXT_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _is_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of files, at most filtered."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("Relation", "LogicalRelation"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that tells all rows apart and never changes: the
    file and place of a row of Parquet files; other tables are written with a
    number."""
    if _is_scan(df):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        try:
            return df.select("*", place.alias(name))
        except AnalysisException:        # files of another format have no places
            pass
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_text(text: Column) -> Column:
    """crc32 of the text's UTF-8."""
    return F.crc32(text.cast("binary"))


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null counts as ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
