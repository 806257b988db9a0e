"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-Proximal) updates, scored as sparse dot
products.

A document's features are uni-, bi- and trigrams of its words in two spellings:
the lower-cased word itself (uni- and bigrams), and its shape, in which letters
of one case, digits and repeated marks are one symbol and a word equal to the
one before it has a shape of its own. Values are relative frequencies.
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
from .base import crc32_mod, fresh
from .text import LOWER, blocks, column_bytes, mix, span_hashes, word_spans

BITS = 18
SCALE = 8.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[48:58] = ord("9")
_SHAPE[128:] = ord("a")
_SEED = [np.uint64(x) for x in (0x51ED270B0A5F37D1, 0xA24BAED4963EE407, 0x9FB21C651E98DF25,
                                0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SAME = np.uint64(0x27D4EB2F165667C5)


def features(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: int = BITS):
    """Of rows i..j-1: feature numbers of all occurrences, family by family, as
    a list of (numbers, bounds of the rows)."""
    body = raw[offsets[i]:offsets[j]]
    bounds = offsets[i:j + 1] - offsets[i]
    s, e, first = word_spans(body, bounds)
    if not len(s):
        return []
    word = span_hashes(LOWER[body], s, e)
    shape = _SHAPE[body]
    new = np.ones(len(body), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[s] = True
    at = np.concatenate([[0], np.cumsum(new)])
    form = span_hashes(shape[new], at[s], at[e])
    head = np.zeros(len(s) + 1, bool)
    head[first] = True
    same = np.zeros(len(s), bool)
    same[1:] = (word[1:] == word[:-1]) & ~head[1:-1]
    form = np.where(same, _SAME, form)
    out, mask = [], np.uint64((1 << bits) - 1)
    for unit, seed, n in ((word, 0, 1), (word, 1, 2), (form, 2, 1), (form, 3, 2), (form, 4, 3)):
        if len(unit) < n:
            continue
        h = np.full(len(unit) - n + 1, _SEED[seed])
        ok = np.ones(len(h), bool)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + unit[k:len(unit) - n + 1 + k])
            if k:
                ok &= ~head[k:len(h) + k]
        number = (h & mask).astype(np.int64)
        start = np.minimum(first, len(ok))
        out.append((number[ok], np.concatenate([[0], np.cumsum(ok)])[start]))
    return out


def _rows(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, int, list]]:
    raw, offs = column_bytes(batch.column(batch.num_columns - 1))
    for i, j in blocks(offs):
        yield i, j, features(raw, offs, i, j, bits)


def _sparse(bits: int) -> Callable:
    """(shard, label, text) to (shard, label, numbers, values) of each document."""
    def run(batches):
        for batch in batches:
            numbers, values = [], []
            for i, j, fams in _rows(batch, bits):
                for r in range(j - i):
                    num, val = [], []
                    for f, b in fams:
                        if b[r + 1] > b[r]:
                            u, c = np.unique(f[b[r]:b[r + 1]], return_counts=True)
                            num.append(u)
                            val.append(c * (SCALE / (b[r + 1] - b[r])))
                    num = np.concatenate(num) if num else np.zeros(0, np.int64)
                    u, back = np.unique(num, return_inverse=True)
                    v = np.bincount(back, np.concatenate(val)) if len(num) else np.zeros(0)
                    numbers.append(u.astype(np.int32).tobytes())
                    values.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(numbers, pa.binary()),
                 pa.array(values, pa.binary())], ["shard", "turn", "label", "numbers", "vals"])
    return run


@dataclass
class Ftrl:
    """Parameters of the learner and of its bounded training sample."""
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    shards: int = 8
    max_rows: int = 20_000
    bits: int = BITS


def ftrl_fit(numbers: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> np.ndarray:
    """Weights after ``epochs`` passes; the last weight is the bias."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(k):
        l1 = np.where(k == size - 1, 0.0, p.l1)
        w = -(z[k] - np.sign(z[k]) * l1) / ((p.beta + np.sqrt(n[k])) / p.alpha + p.l2)
        return np.where(np.abs(z[k]) <= l1, 0.0, w)

    for _ in range(p.epochs):
        for num, val, y in zip(numbers, values, labels):
            k = np.append(num, size - 1)
            x = np.append(val, 1.0)
            w = weight(k)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            n2 = n[k] + g * g
            z[k] += g - (np.sqrt(n2) - np.sqrt(n[k])) / p.alpha * w
            n[k] = n2
    return weight(np.arange(size))


def _fit_shard(p: Ftrl) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "label", "numbers"])
        w = ftrl_fit([np.frombuffer(x, np.int32) for x in pdf["numbers"]],
                     [np.frombuffer(x, np.float32).astype(float) for x in pdf["vals"]],
                     pdf["label"].to_numpy(float), p)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "n": [len(pdf)]})
    return run


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text",
          label: str = "quality", params: Ftrl | None = None) -> np.ndarray:
    """Weights fitted on at most ``params.max_rows`` labelled documents, those
    with the smallest hashes of their identifiers. Labels are averaged by
    identifier (0.5 and more is 1); null labels and identifiers are left out.
    The sample is dealt to ``shards`` learners; their weights are averaged by
    documents seen. Without any labelled document all weights are 0."""
    p = params or Ftrl()
    ship_package(docs.sparkSession)
    turn = F.xxhash64(F.col("_id"), F.lit(11))
    sample = (labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull())
              .groupBy(F.col(ident).alias("_id")).agg(F.avg(label).alias("_avg"))
              .select("_id", turn.alias("turn"), (F.col("_avg") >= 0.5).cast("double").alias("label"))
              .orderBy("turn", "_id").limit(p.max_rows))
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_t")).join(
        F.broadcast(sample), "_id")                 # max_rows rows at most
    rows = rows.select(F.expr(f"cast(pmod(turn, {p.shards}) as int)").alias("shard"), "turn", "label", "_t")
    sparse = rows.mapInArrow(_sparse(p.bits), "shard int, turn long, label double, numbers binary, vals binary")
    got = sparse.groupBy("shard").applyInPandas(_fit_shard(p), "w binary, n long").collect()
    total = sum(r["n"] for r in got)
    out = np.zeros((1 << p.bits) + 1)
    for r in sorted(got, key=lambda r: bytes(r["w"])):
        out += np.frombuffer(r["w"], np.float32) * (r["n"] / total)
    return out


def _score(weights: np.ndarray, bits: int, new: str) -> Callable:
    w, bias = weights[:-1].astype(np.float32), float(weights[-1])

    def run(batches):
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, j, fams in _rows(batch, bits):
                z = np.full(j - i, bias)
                for f, b in fams:
                    run_ = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
                    z += (run_[b[1:]] - run_[b[:-1]]) * (SCALE / np.maximum(b[1:] - b[:-1], 1))
                out[i:j] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out)], [*batch.schema.names[:-1], new])
    return run


def score(docs: DataFrame, weights: np.ndarray, ident: str = "doc_id", text: str = "text",
          carry: list[str] | None = None, output: str = "score") -> DataFrame:
    """``carry`` (by default ``ident``) and score (named ``output``), from 0 to 1, of every whole
    text; null and empty texts get the score of the bias alone. Rows that
    repeat are scored alike, an empty table gives an empty table."""
    ship_package(docs.sparkSession)
    keep = carry or [ident]
    bits = (len(weights) - 1).bit_length() - 1
    body, new = fresh(docs, "_body"), fresh(docs, "_new")
    src = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias(body))
    schema = src.drop(body).schema.add(new, "double")
    return src.mapInArrow(_score(weights, bits, new), schema).withColumnRenamed(new, output)


def held_out(ident: str) -> Column:
    """Rows whose labels are never learned from."""
    return crc32_mod(F.col(ident), 4) == 2
