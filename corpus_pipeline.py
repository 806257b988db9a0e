"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of documents; the last returns the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import exact_dedup, jaccard, mixing, packing, quality
from foldwise.llm.base import fresh, numbered, written
from foldwise.llm.queries import word_tokenizer
from foldwise.session import load

#: Documents scored below this go.
QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from
    the labels of ``sf_dir`` outside the held-out fold, and from ``docs``."""
    labels = load(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    weights = quality.train(docs, labels)
    name = fresh(docs, "_quality")
    scored = quality.score(docs, weights, carry=docs.columns, output=name)
    return scored.where(F.col(name) >= QUALITY).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id
    (null last, then the first row); documents without words all stay."""
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = jaccard.similarity_components(rows.select(key.alias("_key"), "text"), ident="_key")
    stay = found.where(F.col("_key") == F.col("component_id")).select(F.col("_key.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each time one is taken."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A fitted classifier and a tokenizer can't be written in SQL; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
