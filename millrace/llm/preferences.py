"""Operator 4 (native): preference formatting.

Chosen and rejected conversations come as turn rows. The longest common turn prefix of a pair ends
before the first turn that differs or that only one side has. It is rendered once, as the prompt; the turns after it are rendered for
each side as its completion, with the spans (start:end in characters, comma-joined) of its assistant turns, on which alone the loss is taken.

A row holds the turns of one pair with equal turn // TURNS: prompt, chosen, chosen_spans, rejected, rejected_spans. So a
conversation of up to TURNS turns is one row, and one of any length is never gathered in one task: the chunks of
a pair, in order, make its three texts (spans count from the chunk's own start).

Only DataFrame functions. A '<|' in a role or text is written '<\\|', so no text can forge a marker. Rows with a null
conversation or turn are not part of any pair; repeated (conversation, turn) rows count once, the smallest (role, text) first;
null role or text is ''. If both sides are equal the pair has a prompt alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURNS = 64


def render(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), safe(role), F.lit("|>\n"), safe(text), F.lit("<|end|>\n"))


def clean_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, turn, t: role and text), one row for each conversation and turn."""
    kept = turns.where(F.col(id_col).isNotNull() & F.col("turn").isNotNull())
    entry = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.select(F.col(id_col).alias("pair_id"), F.col("turn").alias("turn"), entry.alias("t")).groupBy("pair_id", "turn").agg(F.min("t").alias("t"))


def pair_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, c, r) of two tables of clean turns; c or r is null where a side has no such turn."""
    return chosen.withColumnRenamed("t", "c").join(rejected.withColumnRenamed("t", "r"), ["pair_id", "turn"], "full")


def stale_reply_turns(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, in rejected its last assistant turn repeats
    the first one's text (is empty, if there is but one). Conversations without an assistant turn have equal sides."""
    replies = turns.where("t.role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"), F.min(F.struct("turn", "t.text")).alias("first"))
    stale = replies.select("pair_id", F.col("last").alias("turn"), F.struct(F.lit("assistant").alias("role"), F.when(F.col("first.turn") < F.col("last"), F.col("first.text")).otherwise("").alias("text")).alias("s"))
    return turns.join(stale, ["pair_id", "turn"], "left").select("pair_id", "turn", F.col("t").alias("c"), F.coalesce("s", "t").alias("r"))


def _texts(parts: Column) -> tuple[Column, Column]:
    """(text, spans with loss) of an array of (rendered, mask)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["rendered"])
        span = F.concat_ws(":", acc["at"].cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["mask"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.transform(parts, lambda x: x["rendered"]), ""), F.array_join(F.aggregate(parts, start, add)["spans"], ",")


def format_preferences(both: DataFrame) -> DataFrame:
    """(pair_id, chunk, prompt, chosen, chosen_spans, rejected, rejected_spans) from (pair_id, turn, c, r)."""
    split = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    placed = both.join(split, "pair_id", "left")
    side = lambda t: F.when(t.isNotNull(), F.struct(render(t["role"], t["text"]).alias("rendered"), (t["role"] == "assistant").alias("mask")))
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    entry = F.struct("turn", shared.alias("shared"), side(F.col("c")).alias("c"), F.when(~shared, side(F.col("r"))).alias("r"))
    chunks = placed.groupBy("pair_id", F.floor(F.col("turn") / TURNS).alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("x"))  # at most TURNS entries
    prompt, _ = _texts(F.transform(F.filter("x", lambda x: x["shared"]), lambda x: x["c"]))
    chosen, chosen_spans = _texts(F.transform(F.filter("x", lambda x: ~x["shared"] & x["c"].isNotNull()), lambda x: x["c"]))
    rejected, rejected_spans = _texts(F.transform(F.filter("x", lambda x: x["r"].isNotNull()), lambda x: x["r"]))
    return chunks.select("pair_id", "chunk", prompt.alias("prompt"), chosen.alias("chosen"), chosen_spans.alias("chosen_spans"), rejected.alias("rejected"), rejected_spans.alias("rejected_spans"))


def op4_preference_format(spark, sf_dir: str) -> DataFrame:
    return format_preferences(stale_reply_turns(clean_turns(table(spark, sf_dir, "conversations"))))


SQL = """WITH x AS (SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS t FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
k AS (SELECT pair_id, turn, t.role AS role, t.text AS text FROM x),
e AS (SELECT pair_id, max(turn) AS last, min(turn) AS first, arg_min(text, turn) AS f FROM k WHERE role = 'assistant' GROUP BY 1),
b AS (SELECT k.pair_id, turn, role, text AS c, CASE WHEN turn IS DISTINCT FROM last THEN text WHEN first < last THEN f ELSE '' END AS r FROM k LEFT JOIN e USING (pair_id)),
s AS (SELECT pair_id, min(turn) FILTER (c <> r) AS split FROM b GROUP BY 1),
o AS (SELECT b.pair_id, turn, turn // 64 AS chunk, role = 'assistant' AS mask, split IS NULL OR turn < split AS shared,
  '<|' || replace(role, '<|', '<\\|') || '|>' || chr(10) || replace(c, '<|', '<\\|') || '<|end|>' || chr(10) AS c,
  '<|' || replace(role, '<|', '<\\|') || '|>' || chr(10) || replace(r, '<|', '<\\|') || '<|end|>' || chr(10) AS r FROM b JOIN s USING (pair_id)),
p AS (SELECT *, sum(CASE WHEN shared THEN 0 ELSE length(c) END) OVER w - length(c) AS cs, sum(CASE WHEN shared THEN 0 ELSE length(r) END) OVER w - length(r) AS rs
  FROM o WINDOW w AS (PARTITION BY pair_id, chunk ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT pair_id, chunk, coalesce(string_agg(c, '' ORDER BY turn) FILTER (shared), '') AS prompt,
coalesce(string_agg(c, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen, coalesce(string_agg(cs || ':' || (cs + length(c)), ',' ORDER BY turn) FILTER (NOT shared AND mask), '') AS chosen_spans,
coalesce(string_agg(r, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected, coalesce(string_agg(rs || ':' || (rs + length(r)), ',' ORDER BY turn) FILTER (NOT shared AND mask), '') AS rejected_spans
FROM p GROUP BY pair_id, chunk"""
