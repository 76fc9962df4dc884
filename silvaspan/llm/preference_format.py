"""Preference formatting of chosen and rejected conversations.

For each pair the longest common prefix of turns (same role and text) is found by joining the two
conversations on their turn positions and taking the first position where they differ. The prefix is
rendered once as the prompt; the turns after it are the two completions. A completion's mask lists the
spans, in code points, of assistant texts with their end marks: what a loss may be taken on.

A turn renders as ``<|role|>``, line break, text, ``<|end|>``, line break; ``<|`` inside a text becomes
``<\\|``, so no text can forge a turn.

Turns are ordered by number (nulls last), then role and text. Each conversation is sorted and joined by
Spark as rows; only the final strings, which are the result, hold a whole conversation, built from its
own turns alone.

Defined results: rows with a null conversation id are in no conversation; null texts and roles count as
empty; a turn number that repeats, or a repeated row, is one more turn; a pair whose chosen or rejected
conversation has no turn is not returned; equal conversations have empty completions; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from silvaspan.sources.tables import table


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of every conversation, numbered from 0."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return rows.select("conv_id", (F.row_number().over(by) - 1).alias("pos"), "role", "text")


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) for rows of pairs (pair_id, chosen_id, rejected_id)."""
    turns = turns_of(conversations)
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id")
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x"))
    rows = sides.select("pair_id", "chosen_id", "rejected_id", "x.*").join(turns, "conv_id")
    # Both conversations' turns at one place meet in one row; the least place where they are not two equal turns ends the prefix.
    same = F.struct("role", "text")
    places = rows.groupBy("pair_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(same).alias("a"), F.max(same).alias("b"))
    ends = places.groupBy("pair_id").agg(F.min(F.when((F.col("n") < 2) | (F.col("a") != F.col("b")), F.col("pos"))).alias("first"), F.count(F.lit(1)).alias("all"))
    ends = ends.select("pair_id", F.coalesce("first", "all").cast("int").alias("prefix_turns"))
    text = F.concat(F.lit("<|"), F.replace("role", F.lit("<|"), F.lit("<\\|")), F.lit("|>\n"))
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>"))
    rows = rows.select("pair_id", "chosen_id", "rejected_id", "side", "pos", text.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("kept"))
    rows = rows.join(ends, "pair_id")
    before = F.col("pos") < F.col("prefix_turns")
    whole = F.concat("head", "body", F.lit("\n"))
    length = F.length(whole)
    start = F.coalesce(F.sum(F.when(~before, length)).over(W.partitionBy("pair_id", "side").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    span = F.when(~before & F.col("kept"), F.concat_ws("-", start, start + F.length("body")))
    rows = rows.select("pair_id", "chosen_id", "rejected_id", "side", "pos", "prefix_turns", before.alias("before"), whole.alias("whole"), span.alias("span"))

    def strings(when, value: str):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("pos", value)))), lambda x: x[value]), "" if value == "whole" else ",")

    first, second = F.col("side") == 0, F.col("side") == 1
    found = rows.groupBy("pair_id", "chosen_id", "rejected_id", "prefix_turns").agg(
        F.countDistinct("side").alias("sides"), strings(F.col("before") & first, "whole").alias("prompt"),
        strings(~F.col("before") & first, "whole").alias("chosen"), strings(~F.col("before") & second, "whole").alias("rejected"),
        strings(F.col("span").isNotNull() & first, "span").alias("chosen_mask"), strings(F.col("span").isNotNull() & second, "span").alias("rejected_mask"),
    )
    return found.where("sides = 2").drop("sides")


def id_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected: the table tells no pairs."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    even = ids.where("conv_id % 2 = 0").select(F.expr("conv_id div 2").alias("pair_id"), F.col("conv_id").alias("chosen_id"))
    odd = ids.where("conv_id % 2 <> 0").select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), F.col("conv_id").alias("rejected_id"))
    return even.join(odd, "pair_id")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, paired completions and masks of all pairs of conversations."""
    conversations = table(spark, sf_dir, "conversations")
    return format_pairs(conversations, id_pairs(conversations))


ORACLE = r"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id FROM t),
    pairs AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id FROM ids a JOIN ids b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1),
    ends AS (SELECT p.pair_id, coalesce(min(CASE WHEN x.role IS NULL OR y.role IS NULL OR x.role <> y.role OR x.text <> y.text THEN n.pos END), count(DISTINCT n.pos)) AS prefix_turns
             FROM pairs p JOIN (SELECT DISTINCT p2.pair_id, t2.pos FROM pairs p2 JOIN t t2 ON t2.conv_id IN (p2.chosen_id, p2.rejected_id)) n ON n.pair_id = p.pair_id
             LEFT JOIN t x ON x.conv_id = p.chosen_id AND x.pos = n.pos LEFT JOIN t y ON y.conv_id = p.rejected_id AND y.pos = n.pos GROUP BY p.pair_id),
    parts AS (SELECT conv_id, pos, role, '<|' || replace(role, '<|', '<\|') || '|>' || chr(10) AS head, replace(text, '<|', '<\|') || '<|end|>' AS body FROM t),
    r AS (SELECT p.pair_id, e.prefix_turns, s.conv_id, s.pos, s.role, s.head, s.body, s.head || s.body || chr(10) AS whole FROM pairs p JOIN ends e USING (pair_id) JOIN parts s ON s.conv_id IN (p.chosen_id, p.rejected_id)),
    spans AS (SELECT *, coalesce(sum(CASE WHEN pos >= prefix_turns THEN length(whole) END) OVER (PARTITION BY pair_id, conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM r)
    SELECT p.pair_id, p.chosen_id, p.rejected_id, CAST(any_value(prefix_turns) AS INTEGER) AS prefix_turns,
           coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE s.conv_id = chosen_id AND pos < prefix_turns), '') AS prompt,
           coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE s.conv_id = chosen_id AND pos >= prefix_turns), '') AS chosen,
           coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE s.conv_id = rejected_id AND pos >= prefix_turns), '') AS rejected,
           coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE s.conv_id = chosen_id AND pos >= prefix_turns AND role = 'assistant'), '') AS chosen_mask,
           coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE s.conv_id = rejected_id AND pos >= prefix_turns AND role = 'assistant'), '') AS rejected_mask
    FROM pairs p JOIN spans s USING (pair_id) GROUP BY p.pair_id, p.chosen_id, p.rejected_id"""
