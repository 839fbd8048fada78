"""Records as chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string>>"


def messages(system: Column | str, user: Column, assistant: Column) -> Column:
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(part("system", F.lit(system) if isinstance(system, str) else system), part("user", user), part("assistant", assistant)).cast(MESSAGES)


def from_instructions(df: DataFrame, system: str) -> DataFrame:
    """instruction, input, output → messages; the input follows the instruction on a line of its own if there is any."""
    user = F.when(F.coalesce("input", F.lit("")) != "", F.concat_ws("\n", "instruction", "input")).otherwise(F.col("instruction"))
    return df.select(messages(system, user, F.col("output")).alias("messages"))


def from_any(df: DataFrame, system: str) -> DataFrame:
    """messages from whichever of the known column sets the frame has: instruction/input/output, question/answer,
    prompt/response, prompt/completion; rows without a question or an answer are dropped."""
    have = set(df.columns)
    col = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    instruction = F.when(col("input").isNotNull(), F.concat_ws("\n", col("instruction"), col("input"))).otherwise(col("instruction"))
    user = F.coalesce(F.when(col("output").isNotNull(), instruction), F.when(col("answer").isNotNull(), col("question")), F.when(F.coalesce(col("response"), col("completion")).isNotNull(), col("prompt")))
    answer = F.coalesce(F.when(instruction.isNotNull(), col("output")), F.when(col("question").isNotNull(), col("answer")), F.coalesce(col("response"), col("completion")))
    return df.select("*", user.alias("__u"), answer.alias("__a")).where("__u IS NOT NULL AND __a IS NOT NULL").select(*df.columns, messages(system, F.col("__u"), F.col("__a")).alias("messages"))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation with its messages in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return turns.groupBy(id_col).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
