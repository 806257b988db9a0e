"""CSV ingest (inventory S1-S6) and the scored-table sink.

Encoding: the file is read as text lines (no decoding happens: Spark keeps
the raw bytes in its strings) and ``is_valid_utf8`` decides, in one
distributed aggregate, between UTF-8 (BOM allowed) and Shift-JIS (cp932 =
Java ``windows-31j``, which needs ``spark.sql.legacy.javaCharsets``).
Only the header line reaches the driver. Cells are read as strings; the type
triage (P6) decides what is numeric, as pandas' inference would.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.select import DataError, normalize_missing
from ..session import ship_package

BOM = "﻿"
CP932 = "windows-31j"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S1: 'UTF-8' when every line is valid UTF-8, else 'windows-31j'."""
    lines = spark.read.text(path)
    bad = lines.agg(F.sum((~F.is_valid_utf8(F.col("value"))).cast("long")).alias("bad")).first()
    if bad is None or bad["bad"] is None:
        raise DataError("empty_file", path)
    return "UTF-8" if bad["bad"] == 0 else CP932


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a cell may go
    on in the next line. A quote byte is never part of a longer character."""
    odd = F.regexp_count(F.col("value"), F.lit('"')) % 2 == 1
    return not spark.read.text(path).where(odd).limit(1).isEmpty()


def _open_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``, given whether one
    was open at its start. A quote opens a cell only as its first byte."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at:at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(b",", at) + 1
        if at == 0:
            return False


def _split_lines(batches):
    """(file, block, line) of the text scan's batches, in the file's order."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def _effects(batches):
    """One row a split: whether a cell is open at its end, when none / one was
    open at its start."""
    found = {}
    for file, block, line in _split_lines(batches):
        state = found.setdefault((file, block), (False, True))
        if b'"' in line:
            after = [_open_after(line, inside) for inside in (False, True)]
            found[file, block] = tuple(after[s] for s in state)
    yield pa.RecordBatch.from_pylist(
        [{"file": f, "block": k, "closed": s[0], "opened": s[1]} for (f, k), s in found.items()],
        pa.schema([("file", pa.string()), ("block", pa.int64()), ("closed", pa.bool_()), ("opened", pa.bool_())]))


_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int8()), ("starts", pa.bool_()),
                     ("whole", pa.bool_()), ("first", pa.bool_()), ("record", pa.binary())])


def _pieces(started_open) -> Callable:
    """Records of every split. A record cut by a split's edge gives pieces:
    ``place`` 0 at the split's head, 1 at its tail."""
    def run(batches):
        out, size = [], 0
        split, inside, starts, lines, n = None, False, True, [], 0

        def piece(whole):
            return {"file": split[0], "block": split[1], "place": 1 if starts else 0, "starts": starts,
                    "whole": whole and starts, "first": starts and split[1] == 0 and n == 0,
                    "record": b"\n".join(lines)}

        for file, block, line in _split_lines(batches):
            if (file, block) != split:
                if lines:
                    out.append(piece(False))
                split, n, lines = (file, block), 0, []
                inside = split in started_open.value
                starts = not inside
            lines.append(line)
            size += len(line)
            if inside or b'"' in line:
                inside = _open_after(line, inside)
            if not inside:
                out.append(piece(True))
                lines, starts, n = [], True, n + 1
            if size >= 1 << 23:
                yield pa.RecordBatch.from_pylist(out, _PIECES)
                out, size = [], 0
        if lines:
            out.append(piece(False))
        yield pa.RecordBatch.from_pylist(out, _PIECES)
    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files whose quoted cells may hold line ends: file,
    first (the file's first record, its header) and record (bytes).

    Every split says what it does to the state "a quoted cell is open": one
    result for either state at its start. These effects compose, so a prefix
    sum over the splits of a file (one row each) tells the state in which each
    split starts. Then all splits find their records at the same time; only
    pieces of records that an edge cuts, at most two a split, are put together
    in a shuffle. The driver holds the names of splits that start within a cell,
    one entry for a split's worth of bytes at most. Only ``\\n`` ends a line. A
    cell that is never closed runs to the end of its file."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("value").cast("binary").alias("line")))
    ship_package(spark)
    effects = lines.mapInArrow(_effects, "file string, block long, closed boolean, opened boolean")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((F.col("closed") & ~F.col("opened")).cast("int")).over(so_far)
    fixed = F.last(F.when(F.col("closed") == F.col("opened"), F.struct(
        F.col("closed").cast("int").alias("state"), F.col("flips"))), ignorenulls=True).over(so_far)
    state = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("flips") - F.coalesce(F.col("fixed.flips"), F.lit(0))
    edges = (effects.withColumn("flips", flips).withColumn("fixed", fixed)
             .withColumn("open", state % 2 == 1)
             .withColumn("open", F.lag("open", 1, False).over(Window.partitionBy("file").orderBy("block")))
             .where("open").select("file", "block"))
    started_open = spark.sparkContext.broadcast({(r["file"], r["block"]) for r in edges.toLocalIterator()})
    pieces = lines.mapInArrow(_pieces(started_open), "file string, block long, place byte, starts boolean, "
                                                     "whole boolean, first boolean, record binary")
    in_order = Window.partitionBy("file").orderBy("block", "place")
    cut = (pieces.where("not whole")
           .withColumn("number", F.sum(F.col("starts").cast("int")).over(in_order))
           .groupBy("file", "number")
           .agg(F.bool_or("first").alias("first"),
                F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("parts"))
           .select("file", "first", F.aggregate(
               "parts", F.lit(None).cast("binary"),
               lambda done, p: F.when(done.isNull(), p["record"]).otherwise(
                   F.concat(done, F.lit(b"\n"), p["record"]))).alias("record")))
    return pieces.where("whole").select("file", "first", "record").unionByName(cut)


def header_record(rows: DataFrame, encoding: str) -> list:
    """Names in the first record of the first file."""
    first = rows.where("first").orderBy("file").first()
    if first is None:
        raise DataError("empty_file", "")
    text = bytes(first["record"]).decode("utf-8-sig" if encoding == "UTF-8" else "cp932")
    return next(csv.reader(io.StringIO(text.lstrip(BOM).rstrip("\r"), newline="")))


def header_line(spark: SparkSession, path: str, encoding: str) -> list:
    """First line of the file decoded with ``encoding``; BOM stripped. The
    text reader keeps raw bytes, so casting to binary recovers them."""
    first = spark.read.text(path).select(F.col("value").cast("binary")).first()
    if first is None or first[0] is None:
        raise DataError("empty_file", path)
    text = bytes(first[0]).decode("utf-8-sig" if encoding == "UTF-8" else "cp932")
    text = text.lstrip(BOM).rstrip("\r")
    return next(csv.reader(io.StringIO(text)))


def check_duplicate_headers(names) -> None:
    """After trimming, names must be unique (``a`` and `` a`` collide)."""
    seen, dup = set(), []
    for n in names:
        t = n.strip()
        if t in seen and t not in dup:
            dup.append(t)
        seen.add(t)
    if dup:
        raise DataError("duplicate_headers", dup)


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               string_cols=None) -> DataFrame:
    """Encoding fallback, FAILFAST parse, trimmed unique headers,
    pandas missing tokens -> NULL. A doubled quote within a quoted cell is one
    quote; cells with line ends are read whole, from the records that
    ``records`` finds split by split. ``string_cols`` (S6) only documents that
    encoder sources stay text: every CSV cell is read as text anyway."""
    if fmt == "parquet":
        return normalize_missing(spark.read.parquet(path))
    allow_java_charsets(spark)
    enc = detect_encoding(spark, path)
    broken = has_quoted_newlines(spark, path)
    rows = records(spark, path) if broken else None
    names = header_record(rows, enc) if broken else header_line(spark, path, enc)
    check_duplicate_headers(names)
    trimmed = [n.strip() for n in names]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    quoting = {"mode": "FAILFAST", "quote": '"', "escape": '"'}
    if broken:
        text = F.rtrim(F.decode("record", enc), F.lit("\r"))
        cells = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), quoting)
        df = rows.where(~F.col("first") & (F.trim(text) != "")).select(cells.alias("r")).select("r.*")
    else:
        df = spark.read.options(header=True, encoding=enc, **quoting).schema(schema).csv(path)
    df = df.toDF(*trimmed)
    _ = string_cols
    return normalize_missing(df)


def allow_java_charsets(spark: SparkSession) -> None:
    """Shift-JIS (``windows-31j``) needs Spark's legacy Java charset switch
    (a runtime SQL setting)."""
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Text sink used by tests and the scored-table writer."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        allow_java_charsets(df.sparkSession)
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)
