"""Chat formatting by multi-party perspective rotation, in native expressions only.

Every participant of a dialogue gets a rendering in which their turns are the assistant's and the
other participants' turns are those of named users. A rendering is a sequence of segments, one a
turn, with character offsets, so that no dialogue has to be gathered into one value; the loss mask
covers the text and the end mark of the participant's own turns. Offsets of blocks of turns come from lengths, so a text moves once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turns that are summed together; long dialogues are many groups' work.
TURNS_TOGETHER = 256


@dataclass(frozen=True)
class Template:
    system: str = "<|system|>\n"
    assistant: str = "<|assistant|>\n"
    user_before: str = "<|user:"
    user_after: str = "|>\n"
    end: str = "<|end|>\n"
    #: What opens every mark; in a text it is written with a space inside, so that no text can forge one.
    opener: str = "<|"
    opener_in_text: str = "< |"
    system_role: str = "system"
    #: The name of a turn without a role.
    nobody: str = "unknown"


def _safe(text: Column, t: Template) -> Column:
    return F.replace(text, F.lit(t.opener), F.lit(t.opener_in_text))


def rotate(
    turns: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    together: int = TURNS_TOGETHER,
) -> DataFrame:
    """One row per dialogue, participant and turn.

    Columns: ``conv_col``, perspective, ``turn_col``, role, segment, is_target, seg_start, mask_start,
    seg_end. Segments follow each other by turn, then role, then text; ``[mask_start, seg_end)`` is
    trained on where ``is_target``. System turns belong to every rendering and are nobody's, so a
    dialogue of system turns only has no rendering. A null role counts as the participant "unknown", a
    null text as empty, a null turn comes first, and null dialogue ids are one dialogue. Repeated rows
    are repeated turns. Further columns are ignored; no rows give no rows.
    """
    t = template
    role = F.coalesce(F.col(role_col), F.lit(t.nobody))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("at"), role.alias("role"), _safe(F.coalesce(F.col(text_col), F.lit("")), t).alias("body")
    )
    # null dialogues and turns join and sort like values
    rows = rows.withColumns({"no_conv": F.col("conv").isNull(), "conv_key": F.coalesce(F.col("conv").cast("string"), F.lit("")), "block": F.coalesce(F.floor(F.col("at") / together), F.lit(-(1 << 62)))})
    named = F.when(F.col("role") == t.system_role, F.lit(t.system)).otherwise(F.concat(F.lit(t.user_before), _safe(F.col("role"), t), F.lit(t.user_after)))
    rows = rows.withColumns({"named": named, "size": (F.length(named) + F.length("body") + len(t.end)).cast("long")})
    key = ["no_conv", "conv_key"]
    # lengths alone give the place at which each block of each rendering starts
    sizes = rows.groupBy(*key, "block", "role").agg(F.sum("size").alias("size"), F.sum(F.length("named").cast("long") - len(t.assistant)).alias("less"))
    people = sizes.where(F.col("role") != t.system_role).select(*key, F.col("role").alias("perspective")).distinct()
    sums = sizes.join(people, key).groupBy(*key, "perspective", "block").agg(F.sum(F.col("size") - F.when(F.col("role") == F.col("perspective"), F.col("less")).otherwise(F.lit(0).cast("long"))).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key, "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*key, "block", F.struct("perspective", before.alias("before")).alias("start")).groupBy(*key, "block").agg(F.collect_list("start").alias("starts"))
    # the texts move once, to their block
    wide = rows.join(starts, [*key, "block"]).select("*", F.explode("starts").alias("start")).select("*", "start.*")
    own = F.col("role") == F.col("perspective")
    wide = wide.withColumns({"own": own, "head": F.when(own, F.lit(t.assistant)).otherwise(F.col("named"))})
    wide = wide.withColumn("size", (F.length("head") + F.length("body") + len(t.end)).cast("long"))
    inside = F.sum("size").over(Window.partitionBy(*key, "block", "perspective").orderBy(F.col("at").asc_nulls_first(), "role", "body").rowsBetween(Window.unboundedPreceding, 0))
    placed = wide.withColumn("upto", inside)
    end = F.col("before") + F.col("upto")
    return placed.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("at").alias(turn_col),
        "role",
        F.concat("head", "body", F.lit(t.end)).alias("segment"),
        F.col("own").alias("is_target"),
        (end - F.col("size")).alias("seg_start"),
        (end - F.col("size") + F.length("head")).alias("mask_start"),
        end.alias("seg_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'
), w AS (
  SELECT r.*, perspective, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
    ELSE '<|user:' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), e AS (
  SELECT *, sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_end FROM w
)
SELECT conv_id, perspective, turn, role, head || body || '<|end|>' || chr(10) AS segment, role = perspective AS is_target,
  seg_end - length(head) - length(body) - 8 AS seg_start, seg_end - length(body) - 8 AS mask_start, seg_end FROM e
"""
