"""Language-model scoring: a gated recurrent model with class-factored output,
fitted and applied on the workers, beside an add-0.1 unigram base.

Counts of all training tokens are taken in buckets of their hashes. Frequent
words and the mass of each class come from them. The recurrent part is fitted
in rounds, and every training document falls to one of them: a round's shards
are trained by truncated backpropagation from the same parameters, which are
then averaged by tokens. To score, documents are dealt to chunks; each chunk asks the buckets
for the counts of its distinct words, and the answers meet its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import gru
from .base import partitions, written
from .text import blocks, column_bytes, word_hashes

END = np.uint64(0)
ADD = 0.1
FLUSH = 3_000_000
CHUNK_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """Shape of the network and its fitting: the training documents are dealt
    to ``rounds`` rounds, so that each is trained on once."""
    shape: gru.Shape = gru.Shape()
    rounds: int = 3
    rate: float = 0.1


def tokens(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, suffixes: int):
    """Token hashes of texts i..j-1, an end mark after each, the suffix class
    of each, and the documents' bounds."""
    low, s, e, h, first = word_hashes(raw, offsets, i, j)
    h = np.where(h == END, np.uint64(1), h)
    tail = low[e - 1].astype(np.int64) * 40503 if len(s) else np.zeros(0, np.int64)
    if len(s):
        tail += np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.int64) * 30011
    n = j - i
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
    out = np.full(len(h) + n, END)
    out[at] = h
    suffix = np.zeros(len(h) + n, np.uint8)
    suffix[at] = (tail >> 5) % suffixes
    return out, suffix, first + np.arange(n + 1)


def _bucket_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _count(bits: int, suffixes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h = np.concatenate([x for x, _ in held])
            s = np.concatenate([x for _, x in held])
            words, at, n = np.unique(h, return_index=True, return_counts=True)
            cut = _bucket_cuts(words, bits)
            full = np.flatnonzero(np.diff(cut))
            blob = lambda v: pa.array([v[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), blob(words), blob(n.astype(np.int64)), blob(s[at])],
                ["bucket", "words", "counts", "suffix"])

        for batch in batches:
            raw, offs = column_bytes(batch.column(0))
            for i, j in blocks(offs):
                h, s, _ = tokens(raw, offs, i, j, suffixes)
                held.append((h, s))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def _merge(words: int, suffixes: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["words"]), np.uint64)
        c = np.frombuffer(b"".join(pdf["counts"]), np.int64)
        s = np.frombuffer(b"".join(pdf["suffix"]), np.uint8)
        order = np.argsort(h, kind="stable")
        uniq, start = np.unique(h[order], return_index=True)
        n, s = np.add.reduceat(c[order], start), s[order][start]
        rest = uniq != END                  # the end mark has its place among the frequent words
        top = np.lexsort((uniq, -n))
        top = top[rest[top]][:words]
        mass = np.bincount(s[rest], n[rest] + ADD, minlength=suffixes)
        return pd.DataFrame({
            "bucket": [pdf["bucket"].iloc[0]], "words": [uniq.tobytes()], "counts": [n.tobytes()],
            "tokens": [int(n.sum())], "types": [len(uniq)], "ends": [int(n[~rest].sum())],
            "mass": [mass.tolist()],
            "top": [[{"w": int(w.astype(np.int64)), "c": int(k), "s": int(x)}
                     for w, k, x in zip(uniq[top], n[top], s[top])]]})
    return run


_MERGED = ("bucket int, words binary, counts binary, tokens long, types long, ends long, "
           "mass array<double>, top array<struct<w:long,c:long,s:int>>")


class LanguageModel:
    """Counts (a written table in buckets), frequent words and parameters."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def __getstate__(self) -> dict:
        """What the workers get: all but the table of counts."""
        return {k: v for k, v in self.__dict__.items() if k != "counts"}

    def numbers(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and class of each token."""
        shape = self.settings.shape
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        word = self.place[at]
        hit = self.known[at] == h
        symbol = np.where(hit, word, shape.words + suffix.astype(np.int64))
        return symbol, np.where(hit, word // shape.per_class, shape.groups + suffix.astype(np.int64))


def _texts(pdf: pd.DataFrame, column: str):
    return column_bytes(pa.array(pdf[column], pa.string(), from_pandas=True))


def _train_shard(model: LanguageModel) -> Callable:
    cfg = model.settings

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, offs = _texts(pdf.sort_values(["_order", "_text"], na_position="first"), "_text")
        flat, seen = model.flat, 0
        for i, j in blocks(offs):
            h, s, first = tokens(raw, offs, i, j, cfg.shape.suffixes)
            flat = gru.train(cfg.shape, flat, *model.numbers(h, s), first, cfg.rate)
            seen += len(h)
        weighted = (flat.astype(np.float64) * seen)
        return pd.DataFrame({"part": [int(pdf["_shard"].iloc[0]) % 16], "sum": [weighted.tobytes()], "n": [seen]})
    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "sum"])
    total = sum(np.frombuffer(x, np.float64) for x in pdf["sum"])
    return pd.DataFrame({"sum": [total.tobytes()], "n": [int(pdf["n"].sum())]})


def _bits(spark) -> int:
    return max(6, (partitions(spark) - 1).bit_length())


def fit(docs: DataFrame, text: str = "text", settings: Settings | None = None,
        ident: str = "doc_id") -> LanguageModel:
    """A model of all texts of ``docs``: null and empty texts are just an end
    mark, repeated rows count each time, an empty table gives a model without
    counts; columns other than the two named are not read. Rounds and shards
    are dealt by identifier and text, so copies of a text do not meet in one."""
    cfg = settings or Settings()
    shape, spark = cfg.shape, docs.sparkSession
    ship_package(spark)
    model = LanguageModel(cfg)
    src = docs.select(F.col(text).cast("string").alias("_text"), F.col(ident).alias("_id"))
    model.bits = _bits(spark)
    found = src.select("_text").mapInArrow(_count(model.bits, shape.suffixes),
                           "bucket int, words binary, counts binary, suffix binary")
    merged = written(found.groupBy("bucket").applyInPandas(_merge(shape.words, shape.suffixes), _MERGED), "counts")
    model.counts = merged.select("bucket", "words", "counts")
    stats = merged.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("ends").alias("e"),
                       *[F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(shape.suffixes)]).collect()[0]
    model.n, model.v = int(stats["n"] or 0), int(stats["v"] or 0)
    top = (merged.select(F.inline("top")).orderBy(F.desc("c"), "w").limit(shape.words - 1).collect())
    mass = np.array([stats[f"m{k}"] or 0.0 for k in range(shape.suffixes)]) + ADD
    words = np.zeros(shape.words)
    words[0] = (stats["e"] or 0) + ADD
    for k, r in enumerate(top, 1):
        words[k] = r["c"] + ADD
        mass[r["s"]] -= r["c"] + ADD
    words[len(top) + 1:] = 1e-6
    model.suffix_mass = np.maximum(mass, ADD)
    hashes = np.array([END, *[np.int64(r["w"]).astype(np.uint64) for r in top]], np.uint64)
    order = np.argsort(hashes)
    model.known, model.place = hashes[order], order
    class_mass = np.concatenate([words.reshape(shape.groups, -1).sum(1), model.suffix_mass])
    model.flat = gru.start(shape, class_mass, words)
    size = src.agg(F.sum(F.octet_length("_text"))).collect()[0][0] or 0
    shards = max(1, int(np.ceil(size / cfg.rounds / (CHUNK_BYTES // 2))))
    rows = src.select("_text", F.xxhash64("_id", "_text", F.lit(17)).alias("_order"))
    for k in range(cfg.rounds):
        part = rows.where(F.expr(f"pmod(_order, {cfg.rounds}) = {k}")).withColumn(
            "_shard", F.expr(f"cast(pmod(_order div {cfg.rounds}, {shards}) as int)"))
        got = (part.groupBy("_shard").applyInPandas(_train_shard(model), "part int, sum binary, n long")
               .groupBy("part").applyInPandas(_add_up, "sum binary, n long").collect())
        seen = sum(r["n"] for r in got)
        if seen:
            got = sorted(got, key=lambda r: (r["n"], bytes(r["sum"])))
            model.flat = (sum(np.frombuffer(r["sum"], np.float64) for r in got) / seen).astype(np.float32)
    return model


def _ask(bits: int, suffixes: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, offs = _texts(pdf, "_text")
        words = np.zeros(0, np.uint64)
        for i, j in blocks(offs):
            words = np.union1d(words, tokens(raw, offs, i, j, suffixes)[0])
        cut = _bucket_cuts(words, bits)
        full = np.flatnonzero(np.diff(cut))
        return pd.DataFrame({"chunk": np.int32(pdf["_chunk"].iloc[0]), "bucket": full.astype(np.int32),
                             "words": [words[cut[b]:cut[b + 1]].tobytes() for b in full]})
    return run


def _answer(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    have = np.frombuffer(counts["words"].iloc[0], np.uint64) if len(counts) else np.zeros(0, np.uint64)
    n = np.frombuffer(counts["counts"].iloc[0], np.int64) if len(counts) else np.zeros(0, np.int64)
    out = []
    for words in asked["words"]:
        w = np.frombuffer(words, np.uint64)
        at = np.minimum(np.searchsorted(have, w), max(len(have) - 1, 0))
        c = np.where(have[at] == w, n[at], 0) if len(have) else np.zeros(len(w), np.int64)
        out.append(np.concatenate([w, c.view(np.uint64)]).tobytes())
    return pd.DataFrame({"a_chunk": asked["chunk"], "found": out})


def _score(model: LanguageModel, ident: str) -> Callable:
    cfg = model.settings
    floor = model.n + ADD * (model.v + 1)

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pairs = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in answers["found"]]
        words = np.concatenate([x[0] for x in pairs]) if pairs else np.zeros(0, np.uint64)
        counts = np.concatenate([x[1] for x in pairs]).view(np.int64) if pairs else np.zeros(0, np.int64)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        raw, offs = _texts(docs, "_text")
        out = []
        for i, j in blocks(offs):
            h, s, first = tokens(raw, offs, i, j, cfg.shape.suffixes)
            c = counts[np.searchsorted(words, h)]
            symbol, cls = model.numbers(h, s)
            sums = lambda v: np.add.reduceat(v, first[:-1]) if len(v) else v
            rare = cls >= cfg.shape.groups
            own = np.where(rare, np.log((c + ADD) / model.suffix_mass[s]), 0.0)
            lp = gru.score(cfg.shape, model.flat, symbol, cls, first) + sums(own)
            out.append(pd.DataFrame({
                "n_tokens": np.diff(first), "n_known": sums((c > 0).astype(np.int64)),
                "base_score": sums(np.log10((c + ADD) / floor)), "score": lp / np.log(10)}))
        got = pd.concat(out, ignore_index=True)
        got.insert(0, ident, docs[ident].reset_index(drop=True))
        got.insert(3, "train_tokens", model.n)
        return got
    return run


def score(docs: DataFrame, model: LanguageModel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, n_tokens, n_known, train_tokens, base_score and score (log10
    probabilities) of every whole text. Null and empty texts are one end mark;
    repeated rows are scored alike; an empty table gives an empty table;
    columns other than the two named are not read. A word that is in no
    training text is one more type of its class."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(ident), F.col(text).cast("string").alias("_text"))
    size = src.agg(F.sum(F.octet_length("_text"))).collect()[0][0] or 0
    chunks = max(partitions(docs.sparkSession), int(np.ceil(size / CHUNK_BYTES)))
    src = src.withColumn("_chunk", F.expr(f"cast(pmod(xxhash64(`{ident}`, _text), {chunks}) as int)"))
    cfg = model.settings
    asked = src.groupBy("_chunk").applyInPandas(_ask(model.bits, cfg.shape.suffixes),
                                                "chunk int, bucket int, words binary")
    found = asked.groupBy("bucket").cogroup(model.counts.toDF("b", "words", "counts").groupBy("b")).applyInPandas(
        _answer, "a_chunk int, found binary")
    kind = src.schema[ident].dataType.simpleString()
    return src.groupBy("_chunk").cogroup(found.groupBy("a_chunk")).applyInPandas(
        _score(model, ident), f"`{ident}` {kind}, n_tokens long, n_known long, train_tokens long, "
                              "base_score double, score double")


def held_out(ident: Column) -> Column:
    """Documents that the query's model never learns from."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 10 == 0
