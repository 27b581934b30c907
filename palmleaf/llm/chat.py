"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and everyone else as a named user; a system turn stays a
system turn.  One row is one turn in one perspective: its rendered segment, the
place where it starts in that perspective's dialogue and the part of it to train
on.  A perspective's dialogue is its segments in order of ``start``, so no
conversation, however long, is gathered into one row or one task's memory.

Skew: places are prefix sums on two levels, blocks of ``BLOCK`` turns and turns
within a block; only the blocks' sums of one conversation meet in a task.
Everything is DataFrame and SQL functions.

Markers cannot be forged: ``<|`` in a text or a name, and ``|>`` in a name, get a
backslash between their two characters, one more than they have; to take one away
gives the original back.

Defined results: only the columns conv_id, turn, role and text are read, and no other is
carried, whatever its name; an empty table gives no row; turns go by turn (null last), role, text; a null role is the
participant ``unknown``; a null text is empty; rows with a null conv_id form one
conversation; a conversation with system turns only has no perspective; repeated
rows are rendered once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
SYSTEM = "system"
UNKNOWN = "unknown"
_LAST = (1 << 62) // BLOCK


def escaped(text: Column, close: bool = False) -> Column:
    out = F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")
    return F.regexp_replace(out, r"\|(\\*+)>", r"|$1\\>") if close else out


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, is_target, start, target_from
    and target_to (code points within the dialogue; null where masked)."""
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block).cast("bigint"), F.lit(_LAST)).alias("block"),
    )
    cast = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(cast, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    target = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .when(target, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped(F.col("speaker"), close=True), F.lit("|>\n")))
    )
    shown = seen.withColumns({"is_target": target, "head": head}).withColumn(
        "segment", F.concat("head", "text", F.lit("<|end|>\n"))
    )
    who = ["conv_id", "perspective"]
    sums = shown.groupBy(*who, "block").agg(F.sum(F.length("segment")).alias("size"))
    before = Window.partitionBy(*who).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"{c}_") for c in [*who, "block"]], F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    for c in ("perspective", "block"):
        same = same & (F.col(c) == F.col(f"{c}_"))
    order = Window.partitionBy(*who, "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("inner", F.coalesce(F.sum(F.length("segment")).over(order), F.lit(0))).join(starts, same)
    start = F.col("base") + F.col("inner")
    return placed.select(
        *who,
        "turn",
        "speaker",
        "segment",
        "is_target",
        start.alias("start"),
        F.when(F.col("is_target"), start + F.length("head")).alias("target_from"),
        F.when(F.col("is_target"), start + F.length("segment") - 1).alias("target_to"),
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text FROM conversations),
"cast" AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS is_target,
         CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
              ELSE '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' END || chr(10) AS head
  FROM said JOIN "cast" ON conv_id IS NOT DISTINCT FROM conv),
shown AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM shown)
SELECT conv_id, perspective, turn, speaker, segment, is_target, start,
       CASE WHEN is_target THEN start + length(head) END AS target_from,
       CASE WHEN is_target THEN start + length(segment) - 1 END AS target_to
FROM placed
"""
