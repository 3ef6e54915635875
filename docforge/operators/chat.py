"""Chat assembly (M1, F11, F12) and prompt tables (M3).

Each message row is rendered map-side; a conversation then only needs its
pre-rendered blocks concatenated in turn order (``collect_list`` of short
strings, sorted by turn).  The output row of a conversation is the whole
conversation, so that row is inherently as large as the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import default_system, generation_prompt, message
from ..functions.text import py_strip
from ..params import BEGIN_OF_TEXT, SERVING_SYSTEM_PROMPT
from ..sources.prompts import prompt_set_column


TURN_RUN = 1024


def nonblank(col) -> F.Column:
    """text is not empty after a Unicode strip."""
    return F.coalesce(py_strip(col) != "", F.lit(False))


def assemble_conversations(history: DataFrame, default: str = SERVING_SYSTEM_PROMPT,
                           add_generation_prompt: bool = False) -> DataFrame:
    """M1 + M2: one rendered transcript per conversation.

    system message first (the conversation's own non-empty system row, else
    ``default``), then user/assistant turns in turn order; assistant turns
    that are blank are omitted (F12), user turns are always kept."""
    turns = history.where(F.col("role") != "system").where(
        (F.col("role") != "assistant") | nonblank(F.col("text")))
    blocks = turns.select("conv_id", "turn",
                          message(F.col("role"), F.col("text")).alias("_blk"))
    # two-level concatenation: turns are first joined per (conversation,
    # run of TURN_RUN turns), so a very long conversation is spread over many
    # tasks; the last step only joins the pre-joined runs in order
    runs = blocks.groupBy("conv_id", F.floor(F.col("turn") / TURN_RUN).alias("_run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_blk"))),
                                 lambda s: s["_blk"]), "").alias("_part"),
        F.count(F.lit(1)).alias("_n"))
    body = runs.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_part"))),
                                 lambda s: s["_part"]), "").alias("_body"),
        F.sum("_n").alias("_n"))
    systems = history.where(F.col("role") == "system").where(F.col("text") != "") \
        .groupBy("conv_id").agg(F.min_by("text", "turn").alias("_sys"))
    convs = history.select("conv_id").distinct()
    out = (convs.join(body, "conv_id", "left").join(systems, "conv_id", "left")
           .select("conv_id",
                   (F.coalesce(F.col("_n"), F.lit(0)) + 1).cast("bigint").alias("n_messages"),
                   F.concat(F.lit(BEGIN_OF_TEXT),
                            message(F.lit("system"), default_system(F.col("_sys"), default)),
                            F.coalesce(F.col("_body"), F.lit(""))).alias("prompt")))
    if add_generation_prompt:
        out = out.withColumn("prompt", F.concat(F.col("prompt"), generation_prompt()))
    return out


def prompt_table(questions: DataFrame, id_cols: list[str], text_col: str,
                 system_col: str | None = None,
                 default: str = SERVING_SYSTEM_PROMPT) -> DataFrame:
    """M3: system + one question -> prompt with an open assistant turn.
    Blank questions are dropped (F11)."""
    sys_ = default_system(F.col(system_col), default) if system_col else F.lit(default)
    q = questions.where(nonblank(F.col(text_col)))
    return q.select(*id_cols, F.concat(
        F.lit(BEGIN_OF_TEXT), message(F.lit("system"), sys_),
        message(F.lit("user"), F.col(text_col)), generation_prompt()).alias("prompt"))


def evaluation_prompts(history: DataFrame, default: str = SERVING_SYSTEM_PROMPT) -> DataFrame:
    """S7 + M3: every fixed prompt asked under every conversation's system prompt.
    A prompt with a system prompt of its own keeps it; X18 fills in the default."""
    own = history.groupBy("conv_id").agg(F.min_by(
        "text", F.when((F.col("role") == "system") & (F.col("text") != ""), F.col("turn"))).alias("_own"))
    asked = own.select("conv_id", "_own", F.explode(prompt_set_column()).alias("q")).select(
        "conv_id", "q.prompt_set", "q.prompt_id", F.col("q.text").alias("text"),
        F.coalesce("q.system", "_own").alias("system"))
    return prompt_table(asked, ["conv_id", "prompt_set", "prompt_id"], "text", "system", default)
