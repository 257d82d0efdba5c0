"""Preference formatting: one prompt and a pair of masked completions per preference pair.

A pair is two conversations, chosen and rejected, as arrays of turns.  The
longest common turn prefix (same role and text, turn by turn) is rendered
once as the prompt; what follows in either conversation is rendered as its
completion, with the character spans that count for the loss: the text and
end mark of assistant turns.  Headers and all other turns are masked.
All of it is column expressions on one row per pair.  A pair is one training
example and has to fit into a row, as its rendered text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, without
from trialspark.operators.ordering import with_row_index

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
OUT = ("n_prefix", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans")


def _clean(c: Column) -> Column:
    """No text can open or close a turn; null is empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), _clean(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_clean(turn["text"]), F.lit(END + "\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that both arrays share; null role and text equal each other."""
    shorter = F.least(F.size(a), F.size(b))
    at = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0), lambda n, i: F.when((n == i) & F.get(a, i).eqNullSafe(F.get(b, i)), i + 1).otherwise(n))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start,end>>: code points of the rendered turns that count for the loss (end excluded)."""
    spans = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_header(t))
        end = start + F.char_length(_body(t))
        mine = F.array(F.struct((start).alias("start"), (end - 1).alias("end"))).cast(spans)  # not the line end
        return F.struct(end.alias("at"), F.when(t["role"].eqNullSafe(F.lit(role)), F.concat(acc["spans"], mine))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` plus n_prefix, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans.

    ``chosen`` and ``rejected`` are arrays of (role, text); a null array has no
    turns.  Equal conversations are all prompt, with empty completions; with
    no shared turn the prompt is empty.  Rows are kept one for one, repeated
    ones too; input columns with the names of added ones are replaced.
    """
    pairs = without(pairs, OUT)
    none = F.array().cast(f"array<{TURN}>")
    # evaluated once: the prefix length is a column before it is used
    a, b = fresh(pairs, "side_a", "side_b")
    sides = pairs.withColumns({s: F.coalesce(F.col(f"`{c}`").cast(f"array<{TURN}>"), none)
                               for s, c in ((a, chosen), (b, rejected))})
    sides = sides.withColumn("n_prefix", common_prefix(F.col(a), F.col(b)))
    rest = {s: F.slice(F.col(s), F.col("n_prefix") + 1, F.greatest(F.size(s), F.lit(1))) for s in (a, b)}
    return sides.select(
        *[F.col(f"`{c}`") for c in pairs.columns], "n_prefix",
        render(F.slice(F.col(a), F.lit(1), F.col("n_prefix"))).alias("prompt"),
        render(rest[a]).alias("chosen_text"), render(rest[b]).alias("rejected_text"),
        trained_spans(rest[a]).alias("chosen_spans"), trained_spans(rest[b]).alias("rejected_spans"))


def swapped_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): every conversation with all its turns, and with its last assistant reply swapped.

    Conversations are neighbours by their place in conv_id order, 2i and
    2i + 1, whatever their ids.  The rejected side takes the last assistant
    reply of the neighbour and keeps the turns around it.  If there is no
    neighbour (the last of an odd number) or it has no reply, the rejected side
    lacks the reply; a conversation without a reply has nothing to swap, and
    both sides are equal.  Rows without conv_id belong to no conversation.
    Turns are ordered by (turn, role, text), nulls first, and repeated rows are
    repeated turns.  Action: the ids are written once with their places.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    place = with_row_index(rows.select("conv_id").distinct(), ["conv_id"], "place")
    none = F.array().cast(f"array<{TURN}>")
    bare = lambda a: F.coalesce(F.transform(a, lambda t: F.struct(t["role"], t["text"]).cast(TURN)), none)
    # cut: place of the last assistant turn, one past the end if there is none
    convs = (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
             .withColumn("cut", F.size("turns") - F.array_position(
                 F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")))), "assistant").cast("int") + 1)
             .withColumn("turns", bare(F.col("turns"))))
    couple = (convs.join(place, "conv_id")
              .select(F.shiftright("place", 1).alias("couple"), F.struct("conv_id", "turns", "cut").alias("c"))
              .groupBy("couple").agg(F.sort_array(F.collect_list("c")).alias("both")))
    first, second = F.get("both", F.lit(0)), F.get("both", F.lit(1))
    each = couple.select(F.explode(F.array(F.struct(first.alias("own"), second.alias("other")),
                                           F.struct(second.alias("own"), first.alias("other")))).alias("p"))
    each = each.filter("p.own is not null")
    own, other = F.col("p.own"), F.col("p.other")
    size = F.size(own["turns"])
    swapped = F.concat(F.slice(own["turns"], F.lit(1), own["cut"] - 1),
                       F.coalesce(F.slice(other["turns"], other["cut"], F.lit(1)), none),
                       F.slice(own["turns"], own["cut"] + 1, size))
    return each.select(own["conv_id"].alias("conv_id"), own["turns"].alias("chosen"),
                       F.when(own["cut"] <= size, swapped).otherwise(own["turns"]).alias("rejected"))


def _flat_examples(pairs: DataFrame) -> DataFrame:
    out = format_preferences(pairs)
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"),
                                                                    s["end"].cast("string"))), ";")
    return out.select("conv_id", "n_prefix", "prompt", "chosen_text", "rejected_text",
                      flat("chosen_spans").alias("chosen_mask"), flat("rejected_spans").alias("rejected_mask"))


def preference_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, n_prefix, prompt, chosen_text, rejected_text and the spans as ``start-end;...`` strings.

    Every conversation and all its turns, see ``swapped_reply_pairs``.
    """
    return _flat_examples(swapped_reply_pairs(conversations))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text,
         '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS cut, row_number() OVER (ORDER BY conv_id) - 1 AS place
  FROM t GROUP BY conv_id),
own AS (
  SELECT a.conv_id, a.cut, b.conv_id AS other, b.cut AS other_cut
  FROM c a LEFT JOIN c b ON a.place // 2 = b.place // 2 AND a.place <> b.place),
swapped AS (
  SELECT t.* FROM t JOIN own USING (conv_id) WHERE cut IS NULL OR i <> cut
  UNION ALL
  SELECT own.conv_id, own.cut, y.role, y.text, y.head, y.body
  FROM own JOIN t y ON y.conv_id = other AND y.i = other_cut WHERE cut IS NOT NULL),
sides AS (
  SELECT 'chosen' AS side, * FROM t
  UNION ALL
  SELECT 'rejected', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i), role, text, head, body FROM swapped),
turns AS (
  SELECT conv_id, i, count(*) = 1 OR min(role) IS DISTINCT FROM max(role) OR min(text) IS DISTINCT FROM max(text)
         OR count(role) = 1 OR count(text) = 1 AS differs
  FROM sides GROUP BY conv_id, i),
prefix AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE differs) - 1, max(i)) AS n FROM turns GROUP BY conv_id),
said AS (
  SELECT conv_id, string_agg(head || body, '' ORDER BY i) AS prompt
  FROM t JOIN prefix USING (conv_id) WHERE i <= n GROUP BY conv_id),
rest AS (
  SELECT *, coalesce(sum(length(head || body)) OVER (
    PARTITION BY side, conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS since
  FROM sides JOIN prefix USING (conv_id) WHERE i > n),
done AS (
  SELECT side, conv_id, string_agg(head || body, '' ORDER BY i) AS text,
         string_agg(CASE WHEN role = 'assistant' THEN since || '-' || (since + length(body) - 1) END, ';' ORDER BY i) AS mask
  FROM rest GROUP BY side, conv_id)
SELECT conv_id, n::INT AS n_prefix, coalesce(prompt, '') AS prompt,
       coalesce(x.text, '') AS chosen_text, coalesce(y.text, '') AS rejected_text,
       coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM prefix LEFT JOIN said USING (conv_id)
LEFT JOIN (SELECT * FROM done WHERE side = 'chosen') x USING (conv_id)
LEFT JOIN (SELECT * FROM done WHERE side = 'rejected') y USING (conv_id)
"""
