"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a set of pivots. The
index posts every vector in the inverted files of its ``prefix`` nearest
pivots, together with the pivot's place in the vector's order. A search opens
the files of the query's nearest pivots, adds up the footrule distance
(differences of places; a vector that is not posted counts the full prefix),
and reranks the nearest by the exact inner product. The largest inner product
becomes the nearest neighbour on the unit sphere by one extra coordinate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .base import written

#: Vectors looked at for each pivot, so that near copies leave enough others.
SPARE = 8

def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part: known identifier, no null
    or non-finite component, not zero, and of the most common length (ties to
    the longer). Of repeated rows with one identifier, one vector stays."""
    v = F.col(vector).cast("array<float>")
    fine = vectors.where(F.col(ident).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(
        F.col(ident).cast("long").alias("vec_id"), v.alias("vec")).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0))
    fine = fine.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return fine


def _matrix(col) -> np.ndarray:
    flat = np.concatenate([np.asarray(x, np.float32) for x in col]) if len(col) else np.zeros(0, np.float32)
    return flat.reshape(len(col), -1)


def _sphere(x: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors whose nearest neighbours are the largest inner products."""
    x = x.astype(np.float64) / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _orders(seen: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Place of every pivot in each row's order, held at ``prefix``."""
    order = np.argsort(-(seen @ pivots.T), axis=1, kind="stable")[:, :prefix]
    place = np.full((len(seen), len(pivots)), prefix, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return place


def _apart(sample: np.ndarray, pivots: int, closest: float = 0.8) -> np.ndarray:
    """The first ``pivots`` of the sample that are no near copies of one taken
    before (cosine up to ``closest``); the others follow only if too few are."""
    taken, spare = [], []
    for k, v in enumerate(sample):
        if len(taken) == pivots:
            break
        (spare if taken and (sample[taken] @ v).max() > closest else taken).append(k)
    return sample[(taken + spare)[:pivots]]


def _post(pivots: np.ndarray, norm: float, prefix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist())
            data = _sphere(x, norm)
            asked = np.concatenate([x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True),
                                    np.zeros((len(x), 1))], axis=1)
            cols = [batch.column(0)]
            for v in (x.astype(np.float32), _orders(data, pivots, prefix), _orders(asked, pivots, prefix)):
                cols.append(pa.array([r.tobytes() for r in v], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "vec", "places", "asked"])
    return run


def build_index(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", pivots: int = 256,
                prefix: int = 128) -> DataFrame:
    """The written index: vec_id, vec (float32 bytes), places (of the pivots in
    the vector's order as data) and asked (as a query). The ``pivots`` vectors
    with the smallest hashed identifiers serve as pivots: that bounded sample is all
    the index is fitted on (see ``_apart`` for copies), every vector is
    indexed."""
    if not 0 < prefix < 256:
        raise ValueError("prefix must lie between 1 and 255")
    spark = vectors.sparkSession
    ship_package(spark)
    fine = written(usable(vectors, ident, vector), "vectors")
    sizes = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    fine = fine.where(F.size("vec") == dim)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = float(fine.agg(F.max(F.sqrt(square)).alias("m")).collect()[0]["m"] or 1.0)
    sample = fine.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SPARE * pivots).collect()
    seen = _apart(_sphere(_matrix([r["vec"] for r in sample]), norm), pivots) if sample else np.zeros((0, 1))
    schema = "vec_id long, vec binary, places binary, asked binary"
    return written(fine.mapInArrow(_post(seen, norm, prefix), schema), "index")


def _open_lists(k: int, share: float, least: int, prefix: int) -> Callable:
    def run(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(data):
            data = data.sort_values("vec_id")
            ids = data["vec_id"].to_numpy()
            raw = np.array(list(data["vec"]), dtype=f"V{len(data['vec'].iloc[0])}")
            # equal vectors are one entry; k + 1 of its smallest identifiers can matter at most
            _, first, entry = np.unique(raw, return_index=True, return_inverse=True)
            members = np.split(np.argsort(entry, kind="stable"), np.cumsum(np.bincount(entry))[:-1])
            members = [m[:k + 1] for m in members]
            x = np.frombuffer(raw[first].tobytes(), np.float32).reshape(len(first), -1).astype(np.float64)
            # the inverted files: for every pivot its place in each entry's order
            files = np.ascontiguousarray(np.frombuffer(b"".join(data["places"].iloc[first]), np.uint8)
                                         .reshape(len(first), -1).T).astype(np.int16)
            keep = min(len(first), max(least, int(np.ceil(share * len(first)))))
            for q, v, places in zip(asked["vec_id"], asked["vec"], asked["asked"]):
                places = np.frombuffer(places, np.uint8)
                foot = np.zeros(len(first), np.int32)
                for p in np.flatnonzero(places < prefix):
                    foot += np.abs(files[p] - np.int16(places[p]))
                edge = np.partition(foot, keep - 1)[keep - 1]
                near = np.flatnonzero(foot <= edge)       # ties at the edge all come along
                score = (x[near] * np.frombuffer(v, np.float32).astype(np.float64)).sum(axis=1)
                # entries that can hold one of the k nearest, the query's own left out
                cut = min(len(near), k + 1)
                near_best = score >= np.partition(score, len(score) - cut)[len(score) - cut]
                rows = np.concatenate([members[m] for m in near[near_best]])
                value = np.repeat(score[near_best], [len(members[m]) for m in near[near_best]])
                value, rows = value[ids[rows] != q], rows[ids[rows] != q]
                best = np.lexsort((ids[rows], -value))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[rows][best], "score": value[best]}))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
             "score": pd.Series(dtype="float64")})
    return run


def search(index: DataFrame, queries, k: int = 20, prefix: int = 128, share: float = 0.1,
           least: int = 2000, block: int = 16384, query_block: int = 2048) -> DataFrame:
    """The ``k`` nearest found of every indexed vector that meets the condition
    ``queries`` (a Column over vec_id): query_id, rank, vec_id, score, nearest
    first, ties to the smaller vec_id, without the query itself.

    Blocks of about ``block`` vectors meet blocks of about ``query_block``
    queries; in each pairing the ``share`` of the block that is nearest by
    footrule distance, ``least`` at least and all that tie with the last, is
    reranked. ``share`` = 1 is exact. Fewer candidates give fewer rows; an
    empty index gives an empty table; repeated vectors are all candidates."""
    n = index.count()
    asked = index.where(queries)
    blocks, parts = max(1, -(-n // block)), max(1, -(-asked.count() // query_block))
    deal = lambda c, m, seed: F.expr(f"cast(pmod(xxhash64({c}, {seed}L), {m}) as int)")
    data = (index.select("vec_id", "vec", "places", deal("vec_id", blocks, 1).alias("b"))
            .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    asked = (asked.select("vec_id", "vec", "asked", deal("vec_id", parts, 2).alias("p"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    found = asked.groupBy("b", "p").cogroup(data.groupBy("b", "p")).applyInPandas(
        _open_lists(k, share, least, prefix), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
