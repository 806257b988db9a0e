"""Connected components by repeated contraction of written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def components(edges: DataFrame) -> DataFrame | None:
    """(v, label) for every end of the edges (a, b): label is the smallest
    number of its component. None if there is no edge between two ends.

    In each round every vertex takes the smallest of itself and its neighbours,
    and the edges are renamed by it; loops and repeats go. Renaming keeps what
    is connected connected, and the rounds end when no edge is left."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"),
                                                 F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("to")), "low")
        if label is None:
            label = low.withColumnRenamed("to", "label")
        else:
            label = written(label.join(low.select(F.col("v").alias("label"), "to"), "label", "left")
                            .select("v", F.coalesce("to", "label").alias("label")), "labels")
        a, b = low.toDF("a", "x"), low.toDF("b", "y")
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y")
                        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return label
