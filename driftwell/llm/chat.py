"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, all others as named users, and a mask that trains on the
assistant's words only.  A rendering is a sequence of segments, one a turn, so a
conversation of any length stays spread over tasks; its text is the segments joined in
the order of their positions.  Marks of the template within words or names are escaped, so
no turn can end itself or begin another.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infra import cut

#: The template of a segment: these texts stand around the speaker's name and words. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


#: Marks in words and names get one backslash more after their '<', which can be undone.
_MARK, _ESCAPED = r"<(\\*)\|(im_start|im_end)\|>", r"<\\$1|$2|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, _ESCAPED)


def _numbered(t: DataFrame) -> DataFrame:
    """t with position: the place of a turn in its conversation, from 0, by turn (null first), speaker and text.

    Turns are dealt by ranges of that order, equal ones included, so a long conversation
    lies in many tasks; its places are those within a task and the sums of the tasks before."""
    order = ["turn", "speaker", "text", "tie"]
    ranged = t.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("conv_id", *order)
    dealt = cut(ranged.withColumn("task", F.spark_partition_id()), "turns")
    within = dealt.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "task").orderBy(*order)))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), "before")
    return within.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k"))).select("conv_id", "turn", "speaker", "text", (F.col("i") + F.col("before") - 1).cast("long").alias("position"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", shared: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, train_start, train_length) for each turn and each participant's view.

    A view is its segments in order of position, which has no gaps and is the same in all
    views.  role is assistant (the perspective's own turns), user (named by its speaker) or,
    for speakers in `shared`, their own name: these instruct everybody, so they have no view
    of their own and keep their role in all.  train_start and train_length give the
    characters of the segment to learn from (the assistant's words and the closing mark;
    length 0 for others).

    Defined results: a null speaker is a participant named "unknown"; a null text is
    empty; a null conversation id is one conversation; turns of equal number go by speaker,
    then text, null numbers first; repeated rows are repeated segments; marks of the
    template in words and names are escaped, control characters in names become '_'; a
    conversation of shared speakers only has no view; other columns are ignored, so names
    cannot clash; an empty table gives an empty result.
    """
    t = _numbered(turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker_col}`"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ))
    # one row for each participant: combined before the shuffle, so a long conversation sends few
    views = t.where(~F.col("speaker").isin(*shared)).select(F.col("conv_id").alias("view_of"), F.col("speaker").alias("perspective")).distinct()
    both = t.join(views, F.col("conv_id").eqNullSafe(F.col("view_of"))).select("conv_id", "perspective", "position", "turn", "speaker", "text")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*shared), F.col("speaker")).otherwise("user")
    shown = escaped(F.regexp_replace("speaker", r"[\x00-\x1F\x7F]", "_"))
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), shown)).otherwise(""), F.lit("\n"))
    words = escaped(F.col("text"))
    return both.select(
        "conv_id",
        "perspective",
        "position",
        "turn",
        role.alias("role"),
        F.when(role == "user", F.col("speaker")).alias("name"),
        F.concat(head, words, F.lit(CLOSE)).alias("segment"),
        F.when(own, F.length(head)).otherwise(0).cast("long").alias("train_start"),
        F.when(own, F.length(words) + len(CLOSE)).otherwise(0).cast("long").alias("train_length"),
    )


ROTATE_SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS position,
  regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS words,
  regexp_replace(regexp_replace(speaker, '[\x00-\x1F\x7F]', '_', 'g'), '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS shown FROM t),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('system')),
b AS (SELECT n.conv_id, v.perspective, n.position, n.turn, n.speaker, n.words, n.shown,
  CASE WHEN n.speaker = v.perspective THEN 'assistant' WHEN n.speaker IN ('system') THEN n.speaker ELSE 'user' END AS role
  FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || shown ELSE '' END || chr(10) AS head FROM b)
SELECT conv_id, perspective, position, turn, role, CASE WHEN role = 'user' THEN speaker END AS name,
  head || words || '<|im_end|>' || chr(10) AS segment,
  CAST(CASE WHEN role = 'assistant' AND speaker = perspective THEN length(head) ELSE 0 END AS BIGINT) AS train_start,
  CAST(CASE WHEN role = 'assistant' AND speaker = perspective THEN length(words) + 11 ELSE 0 END AS BIGINT) AS train_length
FROM h"""
