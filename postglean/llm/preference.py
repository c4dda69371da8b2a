"""Preference formatting: one prompt, two masked completions.

Chosen and rejected conversations of a pair are lined up turn by turn. The
turns before the first difference are the prompt, rendered once; what follows
on each side is its completion, with the character spans that a loss may count:
the assistant's texts with their closing marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks about a turn: "<|im_start|>role\n", the text, "<|im_end|>", a line end.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _numbered(turns: DataFrame, side: str) -> DataFrame:
    order = Window.partitionBy("pair_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return turns.select("pair_id", F.row_number().over(order).alias("at"), F.struct(role.alias("role"), text.alias("text")).alias(side))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(rows), lambda x: x["s"]), "")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of conversations (pair_id, turn, role, text each) in one row: prompt, completions and masks.

    Returns pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask. A mask is "start:end" spans of characters of its completion,
    joined by commas. Turns go by number, equal ones by role and text, nulls
    first; a null role is "unknown", a null text empty. A side that is missing
    or ends with the prompt has an empty completion. Null ids make one pair.
    Repeated turns are turns. Very long texts are rendered whole: a pair's text
    must fit in a task. Other columns are left out, whatever their names; empty
    tables give no rows.

    Turns are sorted and summed by windows of one pair, not gathered before
    they are rendered.
    """
    a, b = _numbered(chosen, "chosen"), _numbered(rejected, "rejected")
    on = a["pair_id"].eqNullSafe(b["pair_id"]) & (a["at"] == b["at"])
    both = a.join(b, on, "full_outer").select(F.coalesce(a["at"], b["at"]).alias("at"), F.coalesce(a["pair_id"], b["pair_id"]).alias("pair_id"), "chosen", "rejected")
    whole = Window.partitionBy("pair_id")
    differs = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("at"))
    both = both.withColumn("cut", F.coalesce(F.min(differs).over(whole), F.max("at").over(whole) + 1))
    before = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.max(F.when(F.col("at") < F.col("cut"), F.col("at"))), F.lit(0)).alias("n_prompt_turns")]
    out.append(_joined(F.collect_list(F.when(F.col("at") < F.col("cut"), F.struct("at", F.col("chosen_s").alias("s"))))).alias("prompt"))
    for side in ("chosen", "rejected"):
        head = F.concat(F.lit(OPEN), F.col(side)["role"], F.lit("\n"))
        both = both.withColumn(f"{side}_s", F.concat(head, F.col(side)["text"], F.lit(CLOSE + "\n")))
        own = F.when(F.col("at") >= F.col("cut"), F.length(f"{side}_s"))
        start = F.coalesce(F.sum(own).over(before), F.lit(0)) + F.length(head)
        span = F.concat_ws(":", start, start + F.length(F.col(side)["text"]) + len(CLOSE))
        both = both.withColumn(f"{side}_m", F.when((F.col("at") >= F.col("cut")) & (F.col(side)["role"] == TRAINED), span))
        after = (F.col("at") >= F.col("cut")) & F.col(side).isNotNull()
        out.append(_joined(F.collect_list(F.when(after, F.struct("at", F.col(f"{side}_s").alias("s"))))).alias(side))
        spans = F.sort_array(F.collect_list(F.when(F.col(f"{side}_m").isNotNull(), F.struct("at", F.col(f"{side}_m").alias("s")))))
        out.append(F.array_join(F.transform(spans, lambda x: x["s"]), ",").alias(f"{side}_mask"))
    return both.groupBy("pair_id").agg(*out)


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """The rejected side for plain conversations: the last assistant turn's text is that of the neighbour (conv_id with its lowest bit flipped), if it has one.

    Rows with a null conv_id are kept as they are.
    """
    last = F.max(F.when(F.col("role") == TRAINED, F.struct("turn", "text"))).over(Window.partitionBy("conv_id"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("last", last)
    answers = conversations.where(F.col("role") == TRAINED).groupBy((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"))
    answers = answers.agg(F.max(F.struct("turn", "text"))["text"].alias("other"))
    rows = rows.join(answers, "conv_id", "left")
    is_last = (F.col("role") == TRAINED) & F.struct("turn", "text").eqNullSafe(F.col("last")) & F.col("conv_id").isNotNull()
    return rows.select("conv_id", "turn", "role", F.when(is_last & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("text")).alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs of each conversation (chosen) with its copy of another answer (rejected), by conv_id."""
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return preference_pairs(chosen, swapped_answers(conversations).withColumnRenamed("conv_id", "pair_id")).withColumnRenamed("pair_id", "conv_id")


SQL = """
WITH answers AS (
  SELECT xor(conv_id, 1) AS conv_id, max(struct_pack(turn := turn, text := text)).text AS other
  FROM conversations WHERE role = 'assistant' GROUP BY 1),
rejected AS (
  SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND other IS NOT NULL AND c.conv_id IS NOT NULL
      AND struct_pack(turn := turn, text := text) IS NOT DISTINCT FROM max(CASE WHEN role = 'assistant' THEN struct_pack(turn := turn, text := text) END) OVER (PARTITION BY c.conv_id)
    THEN other ELSE text END AS text
  FROM conversations c LEFT JOIN answers a ON a.conv_id = c.conv_id),
turns AS (
  SELECT side, conv_id, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM (SELECT 'c' AS side, conv_id, turn, role, text FROM conversations UNION ALL SELECT 'r', conv_id, turn, role, text FROM rejected)),
same AS (
  SELECT conv_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM turns GROUP BY ALL),
cuts AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN pos END), max(pos) + 1) AS cut FROM same GROUP BY 1),
rendered AS (
  SELECT side, t.conv_id, pos, cut, role, text, '<|im_start|>' || role || chr(10) AS head, head || text || '<|im_end|>' || chr(10) AS s
  FROM turns t JOIN cuts c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN pos >= cut THEN length(s) END) OVER (PARTITION BY side, conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM rendered)
SELECT conv_id, coalesce(max(CASE WHEN pos < cut THEN pos END), 0) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'c' AND pos < cut), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'c' AND pos >= cut), '') AS chosen,
  coalesce(string_agg((start::BIGINT)::VARCHAR || ':' || ((start + length(text) + 10)::BIGINT)::VARCHAR, ',' ORDER BY pos) FILTER (side = 'c' AND pos >= cut AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'r' AND pos >= cut), '') AS rejected,
  coalesce(string_agg((start::BIGINT)::VARCHAR || ':' || ((start + length(text) + 10)::BIGINT)::VARCHAR, ',' ORDER BY pos) FILTER (side = 'r' AND pos >= cut AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
