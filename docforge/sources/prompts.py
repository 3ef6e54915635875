"""S7 prompt_source, and the small parameter tables of S1 (default seeds and
allow-list) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import (ALLOWED_DOMAINS, EVAL_SYSTEM_PROMPT, EXAMPLE_PROMPTS, GOLDEN_QUESTIONS,
                      SEED_URLS)


def prompt_sets() -> list[tuple[str, int, str, str | None]]:
    """(set, prompt_id, text, system) of the fixed prompts; no system prompt
    of its own: the conversation's or the default one is taken."""
    return ([("golden", i, q, EVAL_SYSTEM_PROMPT) for i, q in enumerate(GOLDEN_QUESTIONS)]
            + [("example", i, q, None) for i, q in enumerate(EXAMPLE_PROMPTS)])


def prompt_set_column() -> Column:
    """The fixed prompts as an array column, to explode per row of a table."""
    return F.array(*[F.struct(F.lit(s).alias("prompt_set"), F.lit(i).alias("prompt_id"),
                              F.lit(t).alias("text"), F.lit(y).cast("string").alias("system"))
                     for s, i, t, y in prompt_sets()])


def default_seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEED_URLS)), "pos long, url string")


def default_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in ALLOWED_DOMAINS], "domain string")
