"""Chat rendering scalars.

Layout: ``<|begin_of_text|>`` then per message
``<|start_header_id|>{role}<|end_header_id|>\\n\\n{content}<|eot_id|>``; an open
assistant header is appended when a generation prompt is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (BEGIN_OF_TEXT, CONTEXT, END_HEADER, END_OF_TURN, SERVING_SYSTEM_PROMPT,
                      START_HEADER, TRAIN_SYSTEM_PROMPT)
from .text import sql_str


def message(role: Column, content: Column) -> Column:
    """One rendered message block; a NULL content is rendered as an empty one."""
    return F.concat(F.lit(START_HEADER), role, F.lit(END_HEADER + "\n\n"), F.coalesce(content, F.lit("")),
                    F.lit(END_OF_TURN))


def generation_prompt() -> Column:
    return F.lit(START_HEADER + "assistant" + END_HEADER + "\n\n")


def user_turn(instruction: Column, input_: Column) -> Column:
    """Instruction + '\\nContext: ' + input."""
    return F.concat(instruction, F.lit(CONTEXT), input_)


def render_sample(instruction: Column, input_: Column, output: Column,
                  system: str = TRAIN_SYSTEM_PROMPT) -> Column:
    """Fixed three-turn training text of one sample."""
    return F.concat(
        F.lit(BEGIN_OF_TEXT),
        message(F.lit("system"), F.lit(system)),
        message(F.lit("user"), user_turn(instruction, input_)),
        message(F.lit("assistant"), output),
    )


def default_system(system: Column, default: str = SERVING_SYSTEM_PROMPT) -> Column:
    """The given system prompt unless NULL or empty."""
    return F.coalesce(F.nullif(system, F.lit("")), F.lit(default))


# --- SQL spellings ----------------------------------------------------------

def sql_message(role: str, content: str) -> str:
    return (f"({sql_str(START_HEADER)} || {role} || {sql_str(END_HEADER + chr(10) * 2)} || "
            f"coalesce({content}, '') || {sql_str(END_OF_TURN)})")


def sql_render_sample(instruction: str, input_: str, output: str,
                      system: str = TRAIN_SYSTEM_PROMPT) -> str:
    user = f"({instruction} || {sql_str(CONTEXT)} || {input_})"
    return (f"({sql_str(BEGIN_OF_TEXT)} || {sql_message(sql_str('system'), sql_str(system))} || "
            f"{sql_message(sql_str('user'), user)} || "
            f"{sql_message(sql_str('assistant'), output)})")


def sql_generation_prompt() -> str:
    return sql_str(START_HEADER + "assistant" + END_HEADER + "\n\n")
