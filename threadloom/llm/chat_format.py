"""Preference formatting of paired conversations, in Column functions only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix (same role and text, turn
by turn) is rendered once as the prompt; the turns after it make two completions. The loss mask of a
completion is given as code point spans, those of the texts of assistant turns.

Turns are ordered by number, role and text, so that repeated or unnumbered turns have a fixed place; a null
role or text is rendered empty and equals only another null. A pair with one side missing has an empty
prompt and an empty completion for that side. Equal conversations have empty completions. Empty tables give
no pairs.

Turns are compared as rows, a conversation is assembled only at the end: what meets in one group is the
turns of one pair, which are the output row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import source


def rendered(turns: Column) -> Column:
    """Turns as ``<|role|>`` lines with their texts."""
    return F.array_join(F.transform(turns, lambda t: piece(t)), "")


def piece(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def mask(turns: Column) -> Column:
    """``start, end`` in code points of the assistant texts in ``rendered(turns)``."""
    sizes = F.transform(turns, lambda t: F.length(piece(t)))
    spans = F.transform(
        turns,
        lambda t, i: F.struct(
            (
                F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
                + F.length(F.coalesce(t["role"], F.lit("")))
                + 5
            ).alias("start"),
            t["role"].alias("role"),
            F.length(F.coalesce(t["text"], F.lit(""))).alias("n"),
        ),
    )
    spans = F.filter(spans, lambda s: (s["role"] == "assistant") & (s["n"] > 0))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")))


def preferences(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pairs`` has ``pair_id, chosen_id, rejected_id`` (null: missing), ``turns`` has
    ``conv_id, turn, role, text``.
    """
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("is_chosen"), F.col("chosen_id").alias("conv_id")),
                F.struct(F.lit(False).alias("is_chosen"), F.col("rejected_id").alias("conv_id")),
            )
        ).alias("s"),
    ).select("pair_id", "s.*").filter("conv_id IS NOT NULL")
    said = sides.join(turns.select("conv_id", "turn", "role", "text"), "conv_id")
    said = said.withColumn("t", F.struct("turn", "role", "text"))
    grouped = said.groupBy("pair_id", "is_chosen").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    both = grouped.groupBy("pair_id").agg(
        F.max(F.when(F.col("is_chosen"), F.col("turns"))).alias("c"),
        F.max(F.when(~F.col("is_chosen"), F.col("turns"))).alias("r"),
    )
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = both.select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first_change = F.array_position(F.slice(same, 1, shorter), F.lit(False))
    both = both.withColumn("n", F.when(first_change > 0, first_change - 1).otherwise(shorter).cast("int"))
    rest = {s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in "cr"}
    return pairs.select("pair_id").join(both, "pair_id", "left").select(
        "pair_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_common"),
        F.coalesce(rendered(F.slice("c", 1, F.col("n"))), F.lit("")).alias("prompt"),
        F.coalesce(rendered(rest["c"]), F.lit("")).alias("chosen"),
        F.coalesce(rendered(rest["r"]), F.lit("")).alias("rejected"),
        F.coalesce(mask(rest["c"]), F.array().cast("array<struct<start:int,end:int>>")).alias("chosen_mask"),
        F.coalesce(mask(rest["r"]), F.array().cast("array<struct<start:int,end:int>>")).alias("rejected_mask"),
    )


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected); rows without a conversation id are in none."""
    ids = turns.filter("conv_id IS NOT NULL").select("conv_id").distinct()
    even = F.pmod("conv_id", F.lit(2)) == 0
    return ids.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(
        F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id"),
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations; masks as ``start-end`` lists."""
    turns = source(spark, sf_dir, "conversations")
    done = preferences(adjacent_pairs(turns), turns)
    for side in ("chosen_mask", "rejected_mask"):
        spans = F.transform(side, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
        done = done.withColumn(side, F.array_join(spans, " "))
    return done


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), pairs AS (SELECT DISTINCT pair_id FROM t),
j AS (
  SELECT pair_id, pos, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
    AND a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b USING (pair_id, pos)
), n AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS n FROM j GROUP BY pair_id
), x AS (
  SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS piece
  FROM t JOIN n USING (pair_id)
), y AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    - coalesce(sum(CASE WHEN pos <= n THEN length(piece) ELSE 0 END) OVER (PARTITION BY pair_id, side), 0)
    + length(coalesce(role, '')) + 5 AS s
  FROM x
)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_common,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= n), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n), '') AS rejected,
  coalesce(string_agg(CAST(CAST(s AS INT) AS VARCHAR) || '-' || CAST(CAST(s AS INT) + length(text) AS VARCHAR), ' ' ORDER BY pos)
    FILTER (WHERE side = 0 AND pos > n AND role = 'assistant' AND length(text) > 0), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(s AS INT) AS VARCHAR) || '-' || CAST(CAST(s AS INT) + length(text) AS VARCHAR), ' ' ORDER BY pos)
    FILTER (WHERE side = 1 AND pos > n AND role = 'assistant' AND length(text) > 0), '') AS rejected_mask
FROM y GROUP BY pair_id
"""
