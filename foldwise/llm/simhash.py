"""SimHash near-duplicates by the general pigeonhole principle.

If the bits of a fingerprint are split into m partitions and each is given a
threshold t (-1: not looked at), thresholds that add up to radius - m + 1 are
enough: two fingerprints within the radius are within some partition's
threshold there. Correlated bits go into one partition, so partitions differ in
how many candidates they bring, and every fingerprint chooses its own
thresholds by dynamic programming on the candidates to expect. It probes the
keys within each threshold; what it meets is verified on all 64 bits.

Equal fingerprints are one class. A key that too many fingerprints share is
split by further bits, three ways, exactly (with radius 2, two of any three
parts can differ, not all), until its groups are small.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .base import partitions, written
from .components import components

RADIUS, BITS = 2, 64
SALTS = 32
#: Numbers of partitions that are weighed against each other.
SPLITS = (2, 3, 4)
#: Cells a partition's keys are counted in; the counts only guide the choice.
CELLS = 4096
#: What one probe costs, in verified candidates.
PROBE = 8.0
#: Rows under one key beyond which it is split by further bits.
GROUP = 4096
#: Rows that one task looks at together.
BUCKET = 100_000
PIECE = 1 << 20
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, in lists of bounded size."""
    i = 0
    while i < len(data):
        j = min(i + PIECE, len(data))
        while j < len(data) and data[j:j + 1].strip():       # not within a word
            j += 1
        yield data[i:j].lower().split()
        i = j


def _counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes, size: int = 3) -> int:
    """SimHash of a text's bytes: a bit is set if over half the XXH64 (seed 42)
    of its ``size``-word shingles have it, repeats counted."""
    tail: list[bytes] = []
    bits, n = np.zeros(BITS, np.int64), 0
    for words in _words(data):
        words = tail + words
        many = len(words) - size + 1
        if many > 0:
            joined = map(b" ".join, zip(*[words[k:] for k in range(size)]))
            bits += _counts(np.fromiter(map(_HASH, joined), np.uint64, many))
            n += many
        tail = words[-(size - 1):] if size > 1 else []
    if not n and tail:
        bits, n = _counts(np.array([_HASH(b" ".join(tail))], np.uint64)), 1
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _scan(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                                             ["_id", "fp"])
    return run


def _pairs_of_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()),
                                      pa.array(total.ravel().astype(np.int64))], ["cell", "n"])


def bit_groups(both: np.ndarray, n: int, m: int) -> list[int]:
    """Masks of ``m`` partitions of about equal width: each starts with the
    bit most correlated with those left and takes the most correlated ones."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, masks = list(range(BITS)), []
    for k in range(m):
        width = BITS * (k + 1) // m - BITS * k // m
        bits = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(bits[0])
        while len(bits) < width:
            bits.append(max(left, key=lambda b: (corr[b, bits].sum(), -b)))
            left.remove(bits[-1])
        masks.append(sum(1 << b for b in bits))
    return masks


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _flips(mask: int, t: int) -> np.ndarray:
    """All changes of just ``t`` bits of the mask."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(c) for c in itertools.combinations(bits, t)], np.uint64)


class Plan:
    """Thresholds by dynamic programming for one way to split the bits.

    ``cells``: fingerprints counted by partition and cell of the key;
    ``kinds``: distinct keys of each partition. A key is expected to bring the
    average of its partition, and what its cell holds beyond the usual."""

    def __init__(self, masks: list[int], cells: np.ndarray, kinds: list[int]):
        self.masks, n = masks, float(cells[0].sum())
        mean = n / CELLS
        self.excess = np.maximum(0, cells - mean - 3 * np.sqrt(mean))
        self.usual = [n / max(k, 1) for k in kinds]
        self.width = [bin(m).count("1") for m in masks]

    def choose(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of cells, a column a partition: the cost and thresholds."""
        n, m = cell.shape
        low, high = -m, RADIUS
        best = np.full((n, high - low + 1), np.inf)
        best[:, -low] = 0
        picked = []
        for i in range(m):
            own = self.usual[i] + self.excess[i][cell[:, i]]
            probes = cost = 0.0
            ways = [(-1, np.zeros(n))]
            for t in range(RADIUS + 1):
                ring = 1.0
                for k in range(t):
                    ring = ring * (self.width[i] - k) / (k + 1)
                probes += ring
                cost = cost + (own if t == 0 else ring * self.usual[i])
                ways.append((t, probes * PROBE + cost))
            here, how = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for t, c in ways:
                for b in range(best.shape[1]):
                    if 0 <= b - t < best.shape[1]:
                        v = best[:, b - t] + c
                        better = v < here[:, b]
                        here[better, b] = v[better]
                        how[better, b] = t
            best, _ = here, picked.append(how)
        at = np.full(n, RADIUS - m + 1 - low)
        total = best[np.arange(n), at]
        chosen = np.zeros((n, m), np.int8)
        for i in range(m - 1, -1, -1):
            chosen[:, i] = picked[i][np.arange(n), at]
            at = at - chosen[:, i]
        return total, chosen


def _rows(batch: pa.RecordBatch, column: int, m: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def _costs(plans: list[Plan]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plans))
        for batch in batches:
            for k, plan in enumerate(plans):
                total[k] += plan.choose(_rows(batch, k + 1, len(plan.masks)))[0].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(plans)), pa.int32()), pa.array(total)],
                                         ["plan", "cost"])
    return run


def _signatures(plan: Plan) -> Callable:
    """(part, bits, fp, probe, index): every fingerprint is in the index of
    every partition, and asks for the keys within its thresholds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            _, chosen = plan.choose(_rows(batch, 1, len(plan.masks)))
            for i, mask in enumerate(plan.masks):
                key = fp & np.uint64(mask)
                for t in range(int(chosen[:, i].max()) + 1 if len(fp) else 0):
                    asks = chosen[:, i] >= t
                    for flip in _flips(mask, t) if t else [np.uint64(0)]:
                        own = asks if t else np.ones(len(fp), bool)
                        yield _signature(i, key[own] ^ flip, fp[own], asks[own], t == 0)
                if not len(fp) or chosen[:, i].max() < 0:
                    yield _signature(i, key, fp, np.zeros(len(fp), bool), True)
    return run


def _signature(i, key, fp, asks, index) -> pa.RecordBatch:
    n = len(fp)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, i, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)),
         pa.array(asks), pa.array(np.full(n, index))], ["part", "bits", "fp", "probe", "index"])


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 by the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return label
        a, b = a[far], b[far]
        np.minimum.at(label, np.maximum(x, y)[far], np.minimum(x, y)[far])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a bucket of keys as a forest: (a, b), fingerprints within the
    radius of which one asked for a key the other has."""
    order = np.argsort(pdf["key"].to_numpy(), kind="stable")
    key = pdf["key"].to_numpy()[order]
    kinds, fp = np.unique(pdf["fp"].to_numpy()[order], return_inverse=True)
    probe, index = pdf["probe"].to_numpy()[order], pdf["index"].to_numpy()[order]
    bits = kinds.view(np.uint64)[fp]
    label = np.arange(len(kinds))
    i, d = np.arange(len(key) - 1), 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        j = i + d
        near = np.bitwise_count(bits[i] ^ bits[j]) <= RADIUS
        near &= (probe[i] & index[j]) | (probe[j] & index[i])
        a, b = label[fp[i[near]]], label[fp[j[near]]]
        if len(a):
            label = join_labels(len(kinds), a, b)[label]
        d += 1
    own = np.flatnonzero(label != np.arange(len(kinds)))
    return pd.DataFrame({"a": kinds[label[own]], "b": kinds[own]})


def _third(level: int, j: int) -> int:
    """Bits whose number has digit ``j`` at place ``level`` in base three."""
    return sum(1 << b for b in range(BITS) if b // 3**level % 3 == j)


class Search:
    def __init__(self, classes: DataFrame):
        self.fps = classes.select("fp")
        self.spark = classes.sparkSession

    def plan(self) -> Plan:
        n = self.fps.count()
        both = np.zeros(BITS * BITS)
        for r in (self.fps.mapInArrow(_pairs_of_bits, "cell int, n long").groupBy("cell")
                  .agg(F.sum("n").alias("n")).collect()):
            both[r["cell"]] = r["n"]
        splits = [bit_groups(both.reshape(BITS, BITS), n, m) for m in SPLITS]
        self.cells = [F.array(*[F.expr(f"cast(pmod(xxhash64(fp & {_signed(mask)}L), {CELLS}) as int)")
                                for mask in masks]) for masks in splits]
        flat = F.posexplode(F.concat(*self.cells)).alias("part", "cell")
        counts = np.zeros((sum(SPLITS), CELLS))
        for r in self.fps.select(flat).groupBy("part", "cell").count().collect():
            counts[r["part"], r["cell"]] = r["count"]
        kinds = self.fps.agg(*[F.approx_count_distinct(F.expr(f"fp & {_signed(mask)}L"))
                               for masks in splits for mask in masks]).collect()[0]
        plans, at = [], 0
        for masks in splits:
            plans.append(Plan(masks, counts[at:at + len(masks)], list(kinds[at:at + len(masks)])))
            at += len(masks)
        cost = np.zeros(len(plans))
        for r in (self.fps.select("fp", *[c.alias(f"c{k}") for k, c in enumerate(self.cells)])
                  .mapInArrow(_costs(plans), "plan int, cost double").groupBy("plan")
                  .agg(F.sum("cost").alias("cost")).collect()):
            cost[r["plan"]] = r["cost"]
        self.chosen = int(cost.argmin())
        return plans[self.chosen]

    def signatures(self, plan: Plan) -> DataFrame:
        cells = self.cells[self.chosen].alias("cells")
        found = self.fps.select("fp", cells).mapInArrow(
            _signatures(plan), "part int, bits long, fp long, probe boolean, index boolean")
        free = F.element_at(F.array(*[F.lit(_signed(~m & (2**64 - 1))) for m in plan.masks]), F.col("part") + 1)
        return found.select(F.xxhash64("part", "bits").alias("key"), "fp", "probe", "index", free.alias("free"))

    def links(self) -> DataFrame:
        """(a, b): enough links to connect what links connect."""
        rows = written(self.signatures(self.plan()), "signatures")
        found = None
        for level in range(5):
            keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("probe").alias("asked"))
            keys = written(keys.where("c > 1 and asked").select("key", "c"), "keys")
            hot = keys.where(F.col("c") > GROUP).select("key") if level < 4 else keys.limit(0).select("key")
            small = keys.where(F.col("c") <= GROUP).select("key") if level < 4 else keys.select("key")
            total = keys.agg(F.sum("c")).collect()[0][0] or 0
            buckets = max(partitions(self.spark), int(total) // BUCKET + 1)
            ready = (rows.join(small, "key").withColumn("bucket", F.expr(f"pmod(xxhash64(key), {buckets})"))
                     .select("bucket", "key", "fp", "probe", "index"))
            part = written(ready.groupBy("bucket").applyInPandas(_links, "a long, b long"), "links")
            found = part if found is None else found.unionByName(part)
            if level == 4 or hot.isEmpty():
                return found
            thirds = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(_signed(_third(level, j))).alias("mask"))
                               for j in range(3)])
            split = rows.join(hot, "key").withColumn("third", F.explode(thirds))
            mask = F.col("free").bitwiseAND(F.col("third.mask"))
            rows = written(split.select(
                F.xxhash64("key", "third.j", F.col("fp").bitwiseAND(mask)).alias("key"), "fp", "probe", "index",
                F.col("free").bitwiseAND(F.bitwise_not(mask)).alias("free")), "signatures")
        return found


def near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row a document: ``ident``, fingerprint (16 hex digits) and
    component_id, the smallest identifier among the documents reachable by
    links. Fingerprints of two or fewer different bits link.

    Words are lower-cased A-Z; a text of fewer words than ``size`` is one
    shingle; a null, empty or blank text has fingerprint zero and links like
    any other. Repeated rows are documents of their own; a null identifier is
    the smallest only if its component has no other; an empty table gives an
    empty table; columns other than the two named are not read."""
    ship_package(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = written(rows.mapInArrow(_scan(size), f"_id {kind}, fp long")
                   .withColumn("_salt", F.expr(f"cast(pmod(xxhash64(_id), {SALTS}) as int)")), "fingerprints")
    parts = written(rows.groupBy("fp", "_salt").agg(F.min("_id").alias("_id")), "classes")
    classes = written(parts.groupBy("fp").agg(F.min("_id").alias("_id")), "classes")
    label = components(Search(classes).links())
    if label is not None:
        classes = classes.join(label.withColumnRenamed("v", "fp"), "fp", "left").select(
            "fp", "_id", F.coalesce("label", "fp").alias("label"))
        low = classes.groupBy("label").agg(F.min("_id").alias("component_id"))
        classes = classes.join(low, "label").select("fp", "component_id")
    else:
        classes = classes.withColumnRenamed("_id", "component_id")
    # a class of any size is met part by part
    answer = parts.select("fp", "_salt").join(classes, "fp")
    return rows.join(answer, ["fp", "_salt"]).select(
        F.col("_id").alias(ident), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
