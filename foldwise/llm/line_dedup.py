"""Substring deduplication by line or paragraph hashing.

Texts are cut into units; a unit's digest is that of its lower-cased words with
single spaces between. Digests are grouped over the whole corpus; the
occurrence that ranks first stays, every later one is removed, and its place in
the original text is kept.

A passage need not begin and end with a line: an edit or another line width
moves every break. ``repeated_passages`` therefore cuts texts a second way, into
units that end at words chosen by the hashes of the words around. A passage is then
cut alike wherever it stands, but for its outer words, and adjacent
repeated units are joined to passages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .base import WORD, fresh, partitions, written

SALTS = 32
#: Units of a chunk of texts, and keys that one bucket is laid out for.
CHUNK, BUCKET = 200_000, 1_000_000
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: What ends a unit.
BREAKS = {"line": r"\n", "paragraph": r"\n[ \t\r]*\n\s*"}
#: A word ends a phrase if no md5 of so many words before and after it is less:
#: a phrase has more than REACH words then and 2 * REACH + 1 in the mean, but for
#: the ends of a text and words that come again at once.
REACH = 4
#: A passage of 50 words and more has whole phrases but for about 2 * REACH + 1
#: words at each end, more by chance; so many words of whole phrases are asked for.
PASSAGE_WORDS = 25
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class _Hashes(dict):
    """First 32 bits of a word's md5, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return h


def _ends(h: np.ndarray) -> np.ndarray:
    """Numbers of the words that end a phrase, the last of the text too."""
    ends = np.ones(len(h), bool)
    for i in range(1, REACH + 1):
        ends[i:] &= h[i:] <= h[:-i]
        ends[:-i] &= h[:-i] <= h[i:]
    ends[-1] = True
    return np.flatnonzero(ends)


def _phrases() -> Callable:
    hashes = _Hashes()

    def find(text: str) -> tuple | None:
        text = text.encode().translate(_UPPER)
        found = text.split()
        if not found:
            return None
        raw = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
        place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])      # characters before a byte
        last = _ends(np.fromiter((hashes[w] for w in found), np.int64, len(found)))
        first = np.concatenate([[0], last[:-1] + 1])
        begin, stop = place[edge[2 * first]], place[edge[2 * last + 1]]
        return begin, stop - begin, last - first + 1, b"".join(
            [hashlib.blake2b(b" ".join(found[a:b + 1]), digest_size=16).digest()
             for a, b in zip(first.tolist(), last.tolist())])
    return find


def _units(breaks: str) -> Callable:
    def start() -> Callable:
        cut = re.compile(breaks)

        def find(text: str) -> tuple:
            start, length, words, digest, at = [], [], [], [], 0
            ends = [(m.start(), m.end()) for m in cut.finditer(text)]
            for stop, after in [*ends, (len(text), len(text))]:
                body = text[at:stop].encode().translate(_UPPER).split()
                start.append(at)
                length.append(stop - at)
                words.append(len(body))
                digest.append(hashlib.blake2b(b" ".join(body), digest_size=16).digest())
                at = after
            return start, length, words, b"".join(digest)
        return find
    return start


def _packed(start: Callable) -> Callable:
    """One row a text: its units' places and digests as packed numbers. Texts
    of about ``CHUNK`` units make a chunk, named after its first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        for batch in batches:
            held, count = [], 0
            for r, text in enumerate(batch.column(2)):
                found = find(text.as_py() or "")
                if found is None:
                    continue
                held.append((r, *[np.asarray(x, np.uint32).tobytes() for x in found[:3]], found[3]))
                count += len(found[0])
                if count >= CHUNK:
                    yield _batch(batch, held)
                    held, count = [], 0
            if held:
                yield _batch(batch, held)
    return run


def _batch(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    at, *blobs = zip(*held)
    row = batch.column(0).take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([row[0].as_py()] * len(at), pa.int64()), row, batch.column(1).take(pa.array(at, pa.int64())),
         *[pa.array(x, pa.binary()) for x in blobs]],
        ["_chunk", "_row", batch.schema.names[1], "start", "length", "words", "digest"])


def _numbers(column, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _keys(column) -> np.ndarray:
    """The first half of each digest."""
    return _numbers(column, np.uint64)[::2]


def _asked(bits: int, min_words: int) -> Callable:
    """The distinct keys of a chunk, dealt to buckets by their leading bits;
    a key that the chunk has more than once stands there twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            new = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
            for i, j in zip(new, [*new[1:], len(chunk)]):
                part = batch.slice(i, j - i)
                keys = np.sort(_keys(part.column(2))[_numbers(part.column(1)) >= min_words])
                third = np.zeros(len(keys), bool)
                third[2:] = keys[2:] == keys[:-2]
                keys = keys[~third]
                cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk[i])),
                     pa.array([keys[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary())],
                    ["bucket", "chunk", "keys"])
    return run


def _again(asked: pa.Table) -> pa.Table:
    """Of one bucket, each chunk's keys that occur twice or more in all."""
    keys = np.sort(_numbers(asked.column("keys"), np.uint64))
    again = np.unique(keys[1:][keys[1:] == keys[:-1]])
    chunk, found = [], []
    for c, own in zip(asked.column("chunk"), asked.column("keys")):
        own = np.frombuffer(own.as_py(), np.uint64)
        if len(own := own[_among(own, again)]):
            chunk.append(c.as_py())
            found.append(own.tobytes())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "keys": pa.array(found, pa.binary())})


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _candidates(min_words: int) -> Callable:
    """Units of a chunk's texts whose keys occur again, a row each."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        again = np.sort(_numbers(answers.column("keys"), np.uint64))
        words, blob = _numbers(texts.column("words")), b"".join(x.as_py() for x in texts.column("digest"))
        n = np.array([len(x.as_py()) // 4 for x in texts.column("words")], np.int64)
        at = np.flatnonzero(_among(_keys(texts.column("digest")), again) & (words >= min_words))
        text = np.repeat(np.arange(len(n)), n)[at]
        long = lambda name: pa.array(_numbers(texts.column(name))[at].astype(np.int64))
        return pa.table({
            "_row": texts.column("_row").take(pa.array(text)), texts.column_names[2]: texts.column(2).take(pa.array(text)),
            "unit": pa.array((at - (np.cumsum(n) - n)[text]).astype(np.int32)), "start": long("start"),
            "length": long("length"), "words": pa.array(words[at].astype(np.int32)),
            "digest": pa.array([blob[16 * k:16 * k + 16] for k in at.tolist()], pa.binary())})
    return run


def _units_again(src: DataFrame, cut: Callable, min_words: int) -> DataFrame:
    """One row for every unit of ``min_words`` words and more whose key, half
    its digest, occurs again: all repeated units, and few others.

    Texts are cut once, into a packed row each. Chunks of texts send their
    distinct keys, eight bytes each and a common one once a chunk, to the keys'
    buckets; what comes again there goes back to the chunk."""
    spark, ident = src.sparkSession, src.columns[1]
    kind = src.schema[ident].dataType.simpleString()
    texts = written(src.mapInArrow(_packed(cut), f"_chunk long, _row long, `{ident}` {kind}, start binary, "
                                                 "length binary, words binary, digest binary"), "units")
    total = texts.agg(F.sum(F.octet_length("words") / 4)).collect()[0][0] or 0
    bits = max(6, (partitions(spark) - 1).bit_length(), int(np.ceil(np.log2(total / BUCKET + 1))))
    asked = texts.select("_chunk", "words", "digest").mapInArrow(
        _asked(min(bits, 30), min_words), "bucket int, chunk long, keys binary")
    again = asked.groupBy("bucket").applyInArrow(_again, "chunk long, keys binary")
    found = texts.groupBy("_chunk").cogroup(again.groupBy("chunk")).applyInArrow(
        _candidates(min_words), f"_row long, `{ident}` {kind}, unit int, start long, length long, words int, digest binary")
    return written(found, "again")


def repeated_units(docs: DataFrame, ident: str = "doc_id", text: str = "text", unit: str = "line",
                   min_words: int = 5, row: str | None = None) -> DataFrame:
    """One row for every unit to remove: ``ident``, unit (its number in the
    text), start and length (characters of the original text), first_id and
    first_unit (the occurrence that stays) and occurrences.

    Units below ``min_words`` words, blank ones too, always stay: so short a
    line says nothing about copying. Occurrences rank by identifier (null
    last), row and unit; repeats within one text count as well. Null text
    counts as empty, repeated rows are documents of their own, an empty table
    gives an empty table; columns other than the two named are not read.
    ``row``: a column that numbers the rows, if the caller has one; it is then
    returned too. A digest's occurrences are counted in ``SALTS`` parts, and
    the answer is joined back part by part, so no line lands in one task."""
    return (_repeated(docs, ident, text, _units(BREAKS[unit]), min_words, row).where("removed")
            .select(*(["_row"] if row else []), ident, "unit", "start", "length",
                    F.col("_first.id").alias("first_id"), F.col("_first.unit").alias("first_unit"),
                    "occurrences"))


def _repeated(docs: DataFrame, ident: str, text: str, cut: Callable, min_words: int,
              row: str | None = None) -> DataFrame:
    """Every unit of ``min_words`` words and more that occurs again, the first
    of a kind too, with removed (false for the first)."""
    ship_package(docs.sparkSession)
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    src = docs.select(number.alias("_row"), F.col(ident), F.col(text).cast("string").alias("_text"))
    units = _units_again(src, cut, min_words)
    rank = F.struct(F.col(ident).isNull().alias("late"), F.col(ident).alias("id"),
                    F.col("_row").alias("row"), F.col("unit").alias("unit"))
    units = units.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(_row, unit), {SALTS}) as int)"))
    parts = units.groupBy("digest", "_salt").agg(F.min(rank).alias("_first"),
                                                 F.count(F.lit(1)).alias("_n"))
    whole = (parts.groupBy("digest").agg(F.min("_first").alias("_first"), F.sum("_n").alias("occurrences"))
             .where("occurrences > 1"))
    repeats = parts.select("digest", "_salt").join(whole, "digest")
    return units.join(repeats, ["digest", "_salt"]).withColumn("removed", rank != F.col("_first"))


def repeated_passages(docs: DataFrame, ident: str = "doc_id", text: str = "text",
                      min_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row for every run of adjacent repeated phrases of ``min_words`` words
    and more: ``ident``, start and length (characters of the original text),
    words, removed_words (words of the phrases that an earlier place has) and
    kept (no more than half of the words have an earlier place: the passage
    stays; a short phrase that stands elsewhere by chance does not decide).

    Phrases rank as units do in ``repeated_units``; repeats within one text
    count. Null and empty texts have no phrases, repeated rows are documents of
    their own, an empty table gives an empty table; columns other than the two
    named are not read. Runs are joined within one text, so no group is larger
    than a document."""
    found = _repeated(docs, ident, text, _phrases, 1)
    run = F.col("unit") - F.row_number().over(Window.partitionBy("_row").orderBy("unit"))
    removed = F.sum(F.when(F.col("removed"), F.col("words")).otherwise(0))
    return (found.select("_row", F.col(ident), "unit", "start", "length", "words", "removed").withColumn("_run", run)
            .groupBy("_row", ident, "_run")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("_stop"),
                 F.sum("words").alias("words"), removed.alias("removed_words"))
            .where(F.col("words") >= min_words)
            .select(ident, "start", (F.col("_stop") - F.col("start")).alias("length"), "words", "removed_words",
                    (2 * F.col("removed_words") <= F.col("words")).alias("kept")))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            text, spans = text.as_py(), spans.as_py()
            if text is not None and spans:
                at, kept = 0, []
                for s in sorted(spans, key=lambda s: s["start"]):
                    stop = s["start"] + s["length"]
                    kept.append(text[at:s["start"]])
                    at = stop + 1 if text[stop:stop + 1] == "\n" else stop
                text = "".join([*kept, text[at:]])
            texts.append(text)
        cols = [batch.column(k) for k in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), batch.column(batch.num_columns - 1)],
                                         batch.schema.names)


def drop_repeated_units(docs: DataFrame, ident: str = "doc_id", text: str = "text", unit: str = "line",
                        min_words: int = 5) -> DataFrame:
    """``docs`` with repeated units (and the line end after each) cut from the
    text, and removed_spans: the (start, length) of what went, in characters of
    the original text (a column of that name is replaced). All other columns and
    all rows stay; rules as above."""
    docs = docs.drop("removed_spans")
    number = fresh(docs, "_number")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    gone = (repeated_units(rows, ident, text, unit, min_words, row=number)
            .groupBy(F.col("_row").alias(number))
            .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("removed_spans")))
    others = [c for c in docs.columns if c != text]
    joined = rows.join(gone, number, "left").select(*others, F.col(text).cast("string").alias(text),
                                                       "removed_spans")
    return joined.mapInArrow(_cut_out, joined.schema).select(*docs.columns, "removed_spans")


#: Removed lines of five words and more, for one document row an identifier.
LINES_SQL = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS unit FROM a),
o AS (SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(length(line) AS BIGINT) AS length,
             CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS BIGINT) AS start,
             regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM u),
g AS (SELECT *, count(*) OVER (PARTITION BY w) AS occurrences, row_number() OVER r AS k,
             first_value(doc_id) OVER r AS first_id, first_value(unit) OVER r AS first_unit
      FROM o WHERE len(w) >= 5 WINDOW r AS (PARTITION BY w ORDER BY doc_id, unit))
SELECT doc_id, unit, start, length, first_id, first_unit, occurrences FROM g WHERE k > 1
"""

_SPACE = r"[\x20\x09-\x0D]"
#: Passages, for one document row an identifier.
PASSAGES_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws,
             list_transform(regexp_extract_all(t, '{_SPACE}+'), lambda g: length(g)) AS gs,
             regexp_matches(t, '^{_SPACE}') AS blank FROM a),
c AS (SELECT doc_id, unnest(ws) AS w, unnest(CASE WHEN blank THEN gs ELSE list_prepend(0, gs) END) AS gap,
             unnest(range(len(ws) + 1)) AS k FROM b),
o AS (SELECT doc_id, k, w, sum(gap + length(w)) OVER p - length(w) AS start,
             coalesce(h <= min(h) OVER (p ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), true)
             AND coalesce(h <= min(h) OVER (p ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING), true) AS ends
      FROM (SELECT *, substr(md5(w), 1, 8) AS h FROM c WHERE w IS NOT NULL)
      WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
n AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM o),
u AS (SELECT doc_id, unit, string_agg(w, ' ' ORDER BY k) AS s, min(start) AS start,
             max(start + length(w)) AS stop, count(*) AS words FROM n GROUP BY doc_id, unit),
g AS (SELECT *, count(*) OVER (PARTITION BY s) AS n,
             row_number() OVER (PARTITION BY s ORDER BY doc_id, unit) AS r FROM u),
e AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM g WHERE n > 1)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) - min(start) AS BIGINT) AS length,
       CAST(sum(words) AS BIGINT) AS words, CAST(sum(CASE WHEN r > 1 THEN words ELSE 0 END) AS BIGINT) AS removed_words,
       2 * sum(CASE WHEN r > 1 THEN words ELSE 0 END) <= sum(words) AS kept
FROM e GROUP BY doc_id, run HAVING sum(words) >= {PASSAGE_WORDS}
"""
