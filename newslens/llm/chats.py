"""Preference formatting: the turns that a chosen and a rejected conversation begin with in common are rendered once as the prompt, the
rest of each as a completion with a mask of what is trained.

Turns are ordered by number, then role and text (null first); repeated rows are one turn. Two turns are the same if role and text are (null
equals null). A null text is rendered empty, a null role as `unknown`. The mask holds the spans (code points of the completion, end
exclusive) of the assistant's words and their end mark; headers and other roles are not trained. A pair is usable if both completions have
such a span. A side without turns gives an empty completion. A null pair id is a pair of its own. Other columns are not read.

A conversation is one training record, so its turns meet in one row; no more than one conversation per side does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the chat template.
OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
SPANS = "array<struct<start:bigint,end:bigint>>"


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn.role, F.lit("unknown")), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn.text, F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Spans of the trained parts of the rendered turns."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, t: Column) -> Column:
        first = state.at + F.length(head(t))
        last = first + F.length(body(t))
        span = F.array(F.struct(first.alias("start"), last.alias("end"))).cast(SPANS)
        spans = F.when(t.role == TRAINED, F.concat(state.spans, span)).otherwise(state.spans)
        return F.struct((last + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add).spans


def common_turns(x: Column, y: Column) -> Column:
    """Number of turns that both begin with."""
    same = F.zip_with(x, y, lambda a, b: a.isNotNull() & b.isNotNull() & a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair from turns (pair_id, side: chosen or rejected, turn, role, text)."""
    turn = F.struct("turn", "role", "text")

    def side(name: str) -> Column:
        return F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)))).alias(name)

    pairs = turns.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    pairs = pairs.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in ("chosen", "rejected")}
    out = pairs.select(
        "pair_id",
        F.col("n").alias("prompt_turns"),
        render(F.slice("chosen", 1, F.col("n"))).alias("prompt"),
        *[render(rest[s]).alias(s) for s in rest],
        *[mask(rest[s]).alias(f"{s}_mask") for s in rest],
    )
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Pairs of preference data: each conversation, and the same with the last text of its neighbour (2k and 2k + 1) in its last turn.

    Without a neighbour, the rejected side stops before the last turn.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = rows.groupBy("pair_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("said"))
    own = last.select(F.col("pair_id").alias("own_id"), "last")
    other = last.select(F.col("pair_id").bitwiseXOR(1).alias("other_id"), F.coalesce("said", F.lit("")).alias("said"))
    known = own.join(other, F.col("own_id") == F.col("other_id"), "left")
    rejected = rows.join(known, F.col("pair_id") == F.col("own_id")).where("turn <> last or said is not null")
    rejected = rejected.select("pair_id", F.lit("rejected").alias("side"), "turn", "role", F.when(F.col("turn") == F.col("last"), F.col("said")).otherwise(F.col("text")).alias("text"))
    return rows.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(rejected)


def preference_report(conversations: DataFrame) -> DataFrame:
    out = preferences(swapped_endings(conversations))
    shown = [F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias(c) for c in ("chosen_mask", "rejected_mask")]
    return out.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected", *shown, "usable")


SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
l AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS said FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.turn = a.last THEN b.said ELSE t.text END AS text
  FROM t JOIN l a USING (conv_id) LEFT JOIN l b ON b.conv_id = xor(t.conv_id, 1) WHERE t.turn <> a.last OR b.said IS NOT NULL),
k AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE NOT coalesce(t.role = r.role AND t.text = r.text, false)), max(turn) + 1) AS k
  FROM t FULL JOIN r USING (conv_id, turn) GROUP BY conv_id),
s AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM r),
p AS (SELECT side, conv_id, turn, k, role, concat('{OPEN}', role, chr(10)) AS h, concat(text, '{CLOSE}') AS b FROM s JOIN k USING (conv_id)),
o AS (SELECT *, sum(CASE WHEN turn >= k THEN length(h) + length(b) + 1 ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY turn)
  - length(b) - 1 AS pos FROM p),
m AS (SELECT conv_id, side,
  coalesce(string_agg(concat(h, b, chr(10)), '' ORDER BY turn) FILTER (WHERE turn < k), '') AS prompt,
  coalesce(string_agg(concat(h, b, chr(10)), '' ORDER BY turn) FILTER (WHERE turn >= k), '') AS rest,
  coalesce(string_agg(concat(pos::BIGINT, ':', (pos + length(b))::BIGINT), ',' ORDER BY turn) FILTER (WHERE turn >= k AND role = '{TRAINED}'), '') AS mask
  FROM o GROUP BY conv_id, side)
SELECT k.conv_id AS pair_id, k.k::BIGINT AS prompt_turns, c.prompt, c.rest AS chosen, coalesce(r.rest, '') AS rejected, c.mask AS chosen_mask,
  coalesce(r.mask, '') AS rejected_mask, c.mask <> '' AND coalesce(r.mask, '') <> '' AS usable
FROM k JOIN m c ON c.conv_id = k.conv_id AND c.side = 'c' LEFT JOIN m r ON r.conv_id = k.conv_id AND r.side = 'r'
"""
