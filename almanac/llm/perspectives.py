"""Dialogues seen from every speaker's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from almanac.llm.base import column, query, table

BLOCK = 256


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    settings: tuple[str, ...] = ("system",),
) -> DataFrame:
    """The dialogue of every conversation once for each participant, as one row per turn in reading order.

    Columns: conv_id, perspective (the participant), turn, place (0 first), role, name, rendered, start, mask_start, mask_end.
    The participant's own turns get the role assistant and are the trained part: [mask_start, mask_end) covers their content
    and closing mark, in code points of the whole rendering, which is the concatenation of ``rendered`` by place. Other
    speakers are users who carry their name; turns of ``settings`` keep the role system, and settings are no participants.
    On turns that are not trained the mask is null.

    A null speaker is called unknown, a null text is empty, null turns come first, null conversations are one conversation.
    Repeated rows count once; other ties in turn are read by speaker and text. A conversation of settings alone has no
    participant and gives no rows, as does an empty table. Further columns are not read, whatever their names.

    A long conversation is never one group: places and offsets are running sums within blocks of 256 turn numbers plus the
    totals of earlier blocks, and the participants come by an equi join that adaptive execution may split.
    """
    plain = turns.select(
        column(turns, conversation).alias("conv_id"), column(turns, turn).alias("turn"),
        F.coalesce(column(turns, speaker), F.lit("unknown")).alias("speaker"), F.coalesce(column(turns, text), F.lit("")).alias("text"),
    ).distinct()
    people = plain.filter(~F.col("speaker").isin(*settings)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumnRenamed("conv_id", "of_conv")
    seen = plain.join(people, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv")
    own, setting = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*settings)
    role = F.when(own, "assistant").when(setting, "system").otherwise("user")
    name = F.when(~own & ~setting, F.col("speaker"))
    head = F.concat(F.lit("<|im_start|>"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    seen = seen.withColumns({"role": role, "name": name, "head": F.length(head), "block": F.floor(F.col("turn") / BLOCK)})
    seen = seen.withColumn("rendered", F.concat(head, "text", F.lit("<|im_end|>\n")))
    size = F.length("rendered").cast("bigint")

    whole = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = seen.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("chars"), F.count(F.lit(1)).alias("rows"))
    earlier = totals.select(
        F.col("conv_id").alias("of_conv"), F.col("perspective").alias("of_perspective"), F.col("block").alias("of_block"),
        F.coalesce(F.sum("chars").over(whole), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text")
    placed = seen.withColumns({
        "row": F.row_number().over(inside) - 1,
        "chars": F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).join(
        earlier,
        F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("perspective") == F.col("of_perspective"))
        & F.col("block").eqNullSafe(F.col("of_block")),
    )
    start = F.col("chars") + F.col("chars_before")
    trained = F.col("speaker") == F.col("perspective")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("row") + F.col("rows_before")).cast("bigint").alias("place"), "role", "name", "rendered",
        start.cast("bigint").alias("start"), F.when(trained, start + F.col("head")).cast("bigint").alias("mask_start"),
        F.when(trained, start + size - 1).cast("bigint").alias("mask_end"),
    )


OP9_SQL = r"""
WITH plain AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM plain WHERE speaker <> 'system'),
seen AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name
  FROM plain JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
made AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head,
    head || text || '<|im_end|>' || chr(10) AS rendered FROM seen),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place,
    coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM made WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, turn, CAST(place AS BIGINT) AS place, role, name, rendered, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN speaker = perspective THEN start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN speaker = perspective THEN start + length(rendered) - 1 END AS BIGINT) AS mask_end
FROM placed
"""


@query("op9_perspectives", OP9_SQL)
def op9_perspectives(spark, sf):
    return rotate(table(spark, sf, "conversations"))
