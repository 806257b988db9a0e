"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import exact_dedup as dedup
from . import (ann, filter_audit, jaccard, line_dedup, lm, mixing, packing, preference, quality, repair, simhash,
               token_counts)

UPPER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    index = ann.build_index(load(spark, sf, "embeddings"))
    return ann.search(index, F.col("vec_id") % 20 == 0)


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup(load(spark, sf, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {UPPER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return token_counts.section_tokens(load(spark, sf, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_preference(spark: SparkSession, sf: str) -> DataFrame:
    pairs = preference.reply_pairs(load(spark, sf, "conversations"))
    return preference.preference_format(pairs).select(
        "conv_id", "partner_id", "prompt_turns", "prompt", "chosen_text", "rejected_text",
        F.size("chosen_mask").alias("chosen_spans"), F.size("rejected_mask").alias("rejected_spans"),
        "status")


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(load(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_jaccard_groups(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similarity_components(load(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.repeated_passages(load(spark, sf, "documents"))


def line_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.repeated_units(load(spark, sf, "documents"))


def op8_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    out = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~out))
    return lm.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                        "base_score", "score")


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(load(spark, sf, "documents"), word_tokenizer())


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    weights = quality.train(docs, labels.where(~quality.held_out("doc_id")))
    return quality.score(docs, weights).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(load(spark, sf, "conversations"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(load(spark, sf, "documents"), load(spark, sf, "labels"))


def op13_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_copies(load(spark, sf, "documents"))


QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_preference": op4_preference,
    "op5_mixing": op5_mixing,
    "op6_jaccard_groups": op6_jaccard_groups,
    "op7_line_dedup": op7_line_dedup,
    "line_repeats": line_repeats,
    "op8_language_model": op8_language_model,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_simhash": op13_simhash,
}
ORACLE = {
    "op2_exact_dedup": OP2_SQL,
    "op4_preference": preference.pair_sql(),
    "op5_mixing": mixing.MIX_SQL,
    "op7_line_dedup": line_dedup.PASSAGES_SQL,
    "line_repeats": line_dedup.LINES_SQL,
    "op11_repair": repair.REPAIR_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
}
