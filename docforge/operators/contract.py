"""V1 sample_contract and the dataset-card numbers (A1, A5).

Contract per JSON line: a JSON object with exactly the keys instruction, input
and output, all of them strings; ``input`` starts with ``Source: ``; the
instruction is one of the templates with some topic substituted; the parsed row
survives a JSON round trip.  Rules are on parsed values, never on bytes: blanks and
escapes of the line are free.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import INSTRUCTION_TEMPLATES
from ..session import materialise

KEYS = ("input", "instruction", "output")
RULES = ("keys_ok", "types_ok", "input_ok", "instruction_ok", "round_trip_ok")
_STRUCT = "struct<instruction:string,input:string,output:string>"


def template_regex(templates=INSTRUCTION_TEMPLATES) -> str:
    """Matches a filled-in template; a topic may hold line breaks."""
    alts = [re.escape(t).replace(re.escape("{topic}"), ".+") for t in templates]
    return "(?s)^(" + "|".join(alts) + ")$"


def contract_checks(lines: DataFrame, line_col: str = "line",
                    templates=INSTRUCTION_TEMPLATES) -> DataFrame:
    """Adds n_keys and the columns of ``RULES``; a line that is no JSON object has
    no keys and breaks every rule."""
    doc = F.try_parse_json(F.col(line_col))
    rows = lines.withColumns({
        "_kind": F.schema_of_variant(doc),
        "_m": F.from_json(F.col(line_col), "map<string,string>"),
        "_s": F.from_json(F.col(line_col), _STRUCT)})
    no = lambda c: F.coalesce(c, F.lit(False))
    is_object = no(F.startswith("_kind", F.lit("OBJECT<")))
    keys = F.array_join(F.array_sort(F.map_keys("_m")), ",")
    strings = "OBJECT<" + ", ".join(f"{k}: STRING" for k in KEYS) + ">"
    given = F.col("_s.instruction").isNotNull() & F.col("_s.input").isNotNull() & F.col("_s.output").isNotNull()
    return rows.withColumns({
        "n_keys": F.when(is_object, F.size("_m")).otherwise(F.lit(0)).cast("bigint"),
        "keys_ok": is_object & no(keys == F.lit(",".join(KEYS))),
        "types_ok": no(F.col("_kind") == F.lit(strings)),
        "input_ok": is_object & no(F.startswith(F.col("_s.input"), F.lit("Source: "))),
        "instruction_ok": is_object & no(F.col("_s.instruction").rlike(template_regex(templates))),
        "round_trip_ok": is_object & no(given & F.from_json(F.to_json("_s"), _STRUCT).eqNullSafe(F.col("_s"))),
    }).drop("_kind", "_m", "_s")


def violations(checked: DataFrame, id_cols: list[str]) -> DataFrame:
    """(id..., rule) for every failed rule."""
    arr = F.array(*[F.when(~F.col(r), F.lit(r)) for r in RULES])
    return checked.select(*id_cols, F.explode(F.filter(arr, lambda x: x.isNotNull()))
                          .alias("rule"))


def size_category(n) -> str:
    """Dataset-card size class of a sample count."""
    if n < 1_000:
        return "n<1K"
    if n < 10_000:
        return "1K<n<10K"
    if n < 100_000:
        return "10K<n<100K"
    if n < 1_000_000:
        return "100K<n<1M"
    return "n>1M"


def card_stats(split_samples: DataFrame, topic_col: str) -> DataFrame:
    """A5: (stat, key, value) rows: sample total, size class, split counts and
    shares, per-topic counts.  All aggregates, one pass (grouping sets)."""
    g = materialise(split_samples.groupBy("split", topic_col).agg(F.count(F.lit(1)).alias("n")),
                    "card-counts")
    tot = g.agg(F.sum("n")).first()[0] or 0
    per_split = g.groupBy("split").agg(F.sum("n").alias("n"))
    per_topic = g.groupBy(topic_col).agg(F.sum("n").alias("n"))
    spark = split_samples.sparkSession
    head = spark.createDataFrame(
        [("samples", "all", str(tot)), ("size_category", "all", size_category(tot))],
        "stat string, key string, value string")
    return (head
            .unionByName(per_split.select(F.lit("split_count").alias("stat"),
                                          F.col("split").alias("key"),
                                          F.col("n").cast("string").alias("value")))
            .unionByName(per_split.select(
                F.lit("split_share").alias("stat"), F.col("split").alias("key"),
                F.format_number(F.col("n") / F.lit(max(tot, 1)), 4).alias("value")))
            .unionByName(per_topic.select(F.lit("topic_count").alias("stat"),
                                          F.col(topic_col).alias("key"),
                                          F.col("n").cast("string").alias("value"))))
