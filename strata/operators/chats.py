"""Conversation turns to ordered message arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_chats(
    df: DataFrame,
    conv: str,
    turn: str,
    role: str,
    text: str,
    system: str | None = None,
    turns_per_part: int | None = None,
) -> DataFrame:
    """`(conv, part, messages ARRAY<STRUCT<role, content>>)`, messages in turn order.

    Turns are whole numbers, unique in their conversation. With `system`, a conversation that does
    not begin with a system turn gets one in front. A conversation is one row (part 0), unless
    `turns_per_part` asks for parts of so many messages, by their place in the conversation: then no
    conversation, however long, becomes one huge row, and its parts in order give the whole.
    """
    message = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    rows = df.select(F.col(conv), F.col(turn).cast("bigint").alias("_turn"), F.lit(1).alias("_rank"), message.alias("_m"))
    if system is not None:
        opening = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
        first = df.groupBy(conv).agg(F.min(F.struct(F.col(turn).cast("bigint").alias("t"), F.col(role).alias("r"))).alias("f"))
        missing = first.filter(F.coalesce(F.col("f.r") != "system", F.lit(True)))
        rows = rows.unionByName(missing.select(conv, F.col("f.t").alias("_turn"), F.lit(0).alias("_rank"), opening.alias("_m")))
    part = F.lit(0).cast("bigint")
    if turns_per_part is not None:
        place = F.row_number().over(Window.partitionBy(conv).orderBy("_turn", "_rank"))
        part = F.floor((place - 1) / turns_per_part)
    return (
        rows.withColumn("part", part)
        .groupBy(conv, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_turn", "_rank", "_m"))).alias("_all"))
        .select(conv, "part", F.transform("_all", lambda x: x["_m"]).alias("messages"))
    )
