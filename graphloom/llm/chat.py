"""Multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that one as
the assistant, the others as users by name, and a mask over what the assistant says. System turns
are no one's and are rendered as such for all. A dialogue is a row for each turn, with its place
in the rendered text, so that no conversation is gathered in one row or task; ``whole`` joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table

SYSTEM = "system"
#: Characters that a name holds as %xx in a segment's head, so that it ends no mark.
IN_NAMES = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}
#: Turns of one block of a conversation's prefix sum, about.
BLOCK = 4096


def escaped_name(name: Column) -> Column:
    for c, code in IN_NAMES.items():
        name = F.replace(name, F.lit(c), F.lit(code))
    return name


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(conv_id, speaker, turn, name, segment, start, end, in_loss, loss_start) of ``turns`` (conv_id, turn, role, text).

    A segment is ``<|assistant|>``, ``<|user:NAME|>`` or ``<|system|>``, a line end, the text,
    ``<|end|>`` and a line end. What a participant writes can't pass for a mark: in texts ``<|`` is written ``<||``
    (undone by the inverse), in names the characters of ``IN_NAMES`` as %xx. start and end are code points in the dialogue; in_loss marks the
    assistant's segments, whose loss counts from after the head (``loss_start``) to ``end``. Null texts are empty;
    a null role is the participant ``unknown``; null conv_ids are one conversation; null turns come first, ties go by
    role and text, and equal rows are each a turn. A conversation of system turns alone has
    no participant and gives no rows. Other columns are ignored; empty input, empty result.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    who = t.where(F.col("name") != system).select(F.col("conv_id").alias("w_conv"), F.col("name").alias("speaker")).distinct()
    r = t.join(who, F.col("conv_id").eqNullSafe(F.col("w_conv"))).drop("w_conv")
    head = F.when(F.col("name") == system, F.lit("<|system|>\n")).when(F.col("name") == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), escaped_name(F.col("name")), F.lit("|>\n")))
    r = r.withColumn("head", head).withColumn("segment", F.concat("head", F.replace("text", F.lit("<|"), F.lit("<||")), F.lit("<|end|>\n"))).withColumn("n", F.length("segment"))
    blocks = r.groupBy("conv_id", "speaker", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("speaker").alias("b_speaker"), F.col("block").alias("b_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "speaker", "block").orderBy("turn", "name", "text").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("upto", F.sum("n").over(inside))
    r = r.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("speaker") == F.col("b_speaker")) & (F.col("block") == F.col("b_block")))
    end = F.col("base") + F.col("upto")
    start = end - F.col("n")
    said = F.col("name") == F.col("speaker")
    return r.select("conv_id", "speaker", "turn", "name", "segment", start.alias("start"), end.alias("end"), said.alias("in_loss"), F.when(said, start + F.length("head")).alias("loss_start"))


def whole(segments: DataFrame) -> DataFrame:
    """(conv_id, speaker, dialogue, spans): one row a dialogue, for conversations that fit in one; spans are the [start, end) that count in the loss."""
    s = F.array_sort(F.collect_list(F.struct("start", "segment", "loss_start", "end")))
    g = segments.groupBy("conv_id", "speaker").agg(s.alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["end"].alias("end")))
    return g.select("conv_id", "speaker", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("dialogue"), spans.alias("spans"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS body FROM conversations
), w AS (
  SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'
), r AS (
  SELECT t.conv_id, w.speaker, t.turn, t.name, t.body,
    CASE WHEN name = 'system' THEN '<|system|>' || chr(10) WHEN name = speaker THEN '<|assistant|>' || chr(10)
         ELSE '<|user:' || replace(replace(replace(replace(replace(replace(name, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D')
           || '|>' || chr(10) END AS head
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id
), s AS (
  SELECT *, head || replace(body, '<|', '<||') || '<|end|>' || chr(10) AS segment FROM r
), u AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM s
)
SELECT conv_id, speaker, turn, name, segment, upto - length(segment) AS "start", upto AS "end", name = speaker AS in_loss,
  CASE WHEN name = speaker THEN upto - length(segment) + length(head) END AS loss_start FROM u
"""
