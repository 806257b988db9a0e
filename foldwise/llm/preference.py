"""Preference formatting: chosen and rejected conversations share their
longest common turn prefix, which is rendered once as the prompt; what follows
becomes two completions with loss masks over the assistant's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def _clean(text: Column) -> Column:
    """Control strings inside a text lose their meaning: '<|im_' is written '<| im_'."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"))


def render(turns: Column) -> Column:
    """The text of a list of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        _head(t), _clean(t["text"]), F.lit(CLOSE + "\n"))), "")


def loss_mask(turns: Column, trained_role: str) -> Column:
    """Character spans [start, end) of the trained role's texts and their end
    mark within ``render(turns)``."""
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(_head(t)).alias("head"),
        (F.length(_clean(t["text"])) + len(CLOSE)).alias("body"),
        F.coalesce(t["role"] == trained_role, F.lit(False)).alias("train")))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(sizes, start, lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"] + 1).alias("at"),
        F.when(t["train"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + t["head"]).alias("start"),
            (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")
    ), lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns in which two lists agree (null equals null)."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                      trained_role: str = "assistant") -> DataFrame:
    """Replaces the columns ``chosen`` and ``rejected`` (arrays of (role, text))
    by prompt_turns, prompt, chosen_text, rejected_text, chosen_mask,
    rejected_mask (spans within the completion) and status.

    status: 'ok'; 'identical' if nothing differs; 'no_chosen' / 'no_rejected'
    if a completion has no turn of the trained role. Null lists count as empty,
    a null role is written 'unknown', a null text is empty, an empty pair gives
    an empty prompt. Other columns are kept; an empty table stays empty."""
    keep = [c for c in pairs.columns if c not in (chosen, rejected)]
    empty = F.array().cast(TURNS)
    p = pairs.withColumns({"_c": F.coalesce(F.col(chosen).cast(TURNS), empty),
                           "_r": F.coalesce(F.col(rejected).cast(TURNS), empty)})
    p = p.withColumn("_k", common_turns(F.col("_c"), F.col("_r")))
    tail = lambda c: F.slice(F.col(c), F.col("_k") + 1, F.greatest(F.size(c) - F.col("_k"), F.lit(0)))
    p = p.withColumns({"_p": F.slice(F.col("_c"), F.lit(1), F.col("_k")), "_ct": tail("_c"), "_rt": tail("_r")})
    p = p.withColumns({"_cm": loss_mask(F.col("_ct"), trained_role), "_rm": loss_mask(F.col("_rt"), trained_role)})
    status = (F.when((F.size("_ct") == 0) & (F.size("_rt") == 0), "identical")
              .when(F.size("_cm") == 0, "no_chosen").when(F.size("_rm") == 0, "no_rejected").otherwise("ok"))
    return p.select(*keep, F.col("_k").alias("prompt_turns"), render(F.col("_p")).alias("prompt"),
                    render(F.col("_ct")).alias("chosen_text"), render(F.col("_rt")).alias("rejected_text"),
                    F.col("_cm").alias("chosen_mask"), F.col("_rm").alias("rejected_mask"),
                    status.alias("status"))


def reply_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Preference pairs from a table of turns: each conversation is chosen once;
    its rejected twin keeps every turn before the last reply of the trained role
    and takes instead the last reply of the neighbour conversation (2k and
    2k + 1 are neighbours). Returns conv_id, partner_id, chosen, rejected.

    Turns are ordered by turn number (null last), role and text; repeated rows
    stay. Rows without a conversation number belong to none and are left out. A
    conversation without a reply, or whose neighbour has none, is paired with
    its own turns before the reply. A conversation is one training example, so
    its turns meet in one row."""
    item = F.struct(F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"),
                    F.col(role).alias("role"), F.col(text).alias("text"))
    conv_rows = (turns.where(F.col(conv).isNotNull())
                 .groupBy(F.col(conv).cast("long").alias("conv_id"))
                 .agg(F.sort_array(F.collect_list(item)).alias("_all"))
                 .withColumn("chosen", F.transform("_all", lambda t: F.struct(t["role"], t["text"])).cast(TURNS)))
    is_reply = F.transform("chosen", lambda t: F.coalesce(t["role"] == trained_role, F.lit(False)))
    back = F.array_position(F.reverse(is_reply), F.lit(True))
    at = F.when(back > 0, F.size("chosen") + 1 - back).cast("int")
    conv_rows = conv_rows.drop("_all").withColumn("_at", at).withColumn(
        "_reply", F.when(F.col("_at").isNotNull(), F.element_at("chosen", F.col("_at"))))
    lent = conv_rows.select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"),
                            F.col("conv_id").alias("partner_id"), F.col("_reply").alias("_lent"))
    before = F.slice("chosen", F.lit(1), F.coalesce(F.col("_at") - 1, F.size("chosen")))
    rejected = F.when(F.col("_at").isNotNull() & F.col("_lent").isNotNull(),
                      F.concat(before, F.array("_lent"))).otherwise(before)
    return conv_rows.join(lent, "conv_id", "left").select("conv_id", "partner_id", "chosen",
                                                          rejected.alias("rejected"))


def pair_sql(open_: str = OPEN, close: str = CLOSE) -> str:
    """reply_pairs + preference_format in SQL (texts, prompt turns and status)."""
    body = "replace(coalesce({t}.text, ''), '<|im_', '<| im_')"
    line = (f"'{open_}' || replace(coalesce(t.role, 'unknown'), '<|im_', '<| im_') || chr(10) || "
            + body.format(t="t") + f" || '{close}' || chr(10)")
    return f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS LAST, role, text) AS a
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) AS at FROM c),
p AS (SELECT x.conv_id, y.conv_id AS partner_id, x.a AS ch,
             CASE WHEN x.at IS NOT NULL AND y.at IS NOT NULL THEN list_append(x.a[1:x.at - 1], y.a[y.at])
                  ELSE x.a[1:coalesce(x.at - 1, len(x.a))] END AS rj
      FROM l x LEFT JOIN l y ON y.conv_id = xor(x.conv_id, 1)),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(ch), len(rj)) + 1),
                lambda i: i > len(ch) OR i > len(rj) OR ch[i] IS DISTINCT FROM rj[i])) - 1, len(ch)) AS n FROM p),
q AS (SELECT *, ch[1:n] AS pt, ch[n + 1:] AS ct, rj[n + 1:] AS rt FROM k)
SELECT conv_id, partner_id, CAST(n AS INTEGER) AS prompt_turns,
       coalesce(list_aggregate(list_transform(pt, lambda t: {line}), 'string_agg', ''), '') AS prompt,
       coalesce(list_aggregate(list_transform(ct, lambda t: {line}), 'string_agg', ''), '') AS chosen_text,
       coalesce(list_aggregate(list_transform(rt, lambda t: {line}), 'string_agg', ''), '') AS rejected_text,
       CAST(len(list_filter(ct, lambda t: t.role = 'assistant')) AS INTEGER) AS chosen_spans,
       CAST(len(list_filter(rt, lambda t: t.role = 'assistant')) AS INTEGER) AS rejected_spans,
       CASE WHEN len(ct) = 0 AND len(rt) = 0 THEN 'identical'
            WHEN len(list_filter(ct, lambda t: t.role = 'assistant')) = 0 THEN 'no_chosen'
            WHEN len(list_filter(rt, lambda t: t.role = 'assistant')) = 0 THEN 'no_rejected' ELSE 'ok' END AS status
FROM q
"""
