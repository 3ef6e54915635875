"""C1 chunk_fold: ordered fold packing paragraphs into ~chunk_max-char chunks.

Transition for paragraph ``x`` (defaults max=2000, min=200, sep="\\n\\n")::

    if len(buf) + len(x) < max:  buf = buf + x + sep
    else:                        if len(buf) > min: emit strip(buf)
                                 buf = x            # no separator (glue)

and the final ``buf`` is discarded.  ``emit_tail`` / ``glue_bug=False`` are
opt-in alternatives.

The fold runs over the paragraphs' lengths alone and gives the stretch of paragraphs of
each chunk; a chunk's text is cut once, at the end, and a count needs none.  All is a
per-row higher-order function: no shuffle, no Python, independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import bound
from ..functions.text import paragraphs, py_strip, sql_str, sql_strip
from ..params import HarvestParams


def chunk_stretches(paras: Column, p: HarvestParams) -> Column:
    """array<struct<first, n, glued>>: the paragraphs of each emitted chunk, from 0, and
    whether the first of them goes without a separator."""
    sep = len(p.sep)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("len"), F.lit(False).alias("glued"),
                     F.array().cast("array<struct<first:int,n:int,glued:boolean>>").alias("out"))

    def flushed(acc):
        return F.when(acc["len"] > p.chunk_min, F.array_append(acc["out"], F.struct(
            acc["first"].alias("first"), (acc["at"] - acc["first"]).alias("n"), acc["glued"].alias("glued")))
        ).otherwise(acc["out"])

    def step(acc, n):
        fits = acc["len"] + n < p.chunk_max
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(fits, acc["first"]).otherwise(acc["at"]).alias("first"),
            F.when(fits, acc["len"] + n + sep).otherwise(n + (0 if p.glue_bug else sep)).alias("len"),
            F.when(fits, acc["glued"]).otherwise(F.lit(p.glue_bug)).alias("glued"),
            F.when(fits, acc["out"]).otherwise(flushed(acc)).alias("out"))

    return F.aggregate(F.transform(paras, F.length), start, step, flushed if p.emit_tail else lambda acc: acc["out"])


def chunk_column(text: Column, p: HarvestParams = HarvestParams()) -> Column:
    """array<string> of emitted chunks for one text."""
    sep = F.lit(p.sep)

    def cut(paras, c):
        after = F.slice(paras, c["first"] + 2, c["n"] - 1)
        return py_strip(F.concat(
            F.get(paras, c["first"]), F.when(c["glued"], F.lit("")).otherwise(sep),
            F.array_join(after, p.sep), F.when(c["n"] > 1, sep).otherwise(F.lit(""))))

    return bound(paragraphs(text, p.sep), lambda paras: F.transform(
        chunk_stretches(paras, p), lambda c: cut(paras, c)))


def chunk(df: DataFrame, text_col: str = "text", p: HarvestParams = HarvestParams(),
          keep: list[str] | None = None) -> DataFrame:
    """One row per emitted chunk: ``keep`` columns + chunk_no (int) + chunk."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    return df.select(
        *keep, F.posexplode(chunk_column(F.col(text_col), p)).alias("chunk_no", "chunk")
    ).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def chunk_count(text: Column, p: HarvestParams = HarvestParams()) -> Column:
    return F.size(chunk_stretches(paragraphs(text, p.sep), p)).cast("bigint")


def sql_chunk_list(expr: str, p: HarvestParams = HarvestParams()) -> str:
    """DuckDB spelling of the same fold (list_reduce with a struct state)."""
    sep = sql_str(p.sep)
    restart = "x" if p.glue_bug else f"x || {sep}"
    tail = ""
    if p.emit_tail:
        tail = (f"CASE WHEN length(s.buf) > {p.chunk_min} THEN "
                f"list_append(s.out, {sql_strip('s.buf')}) ELSE s.out END")
    body = (
        f"list_reduce(string_split({expr}, {sep}), lambda acc, x: "
        f"CASE WHEN length(acc.buf) + length(x) < {p.chunk_max} "
        f"THEN {{'buf': acc.buf || x || {sep}, 'out': acc.out}} "
        f"ELSE {{'buf': {restart}, 'out': CASE WHEN length(acc.buf) > {p.chunk_min} "
        f"THEN list_append(acc.out, {sql_strip('acc.buf')}) ELSE acc.out END}} END, "
        f"{{'buf': '', 'out': []::VARCHAR[]}})"
    )
    if not p.emit_tail:
        return f"({body}).out"
    return f"(SELECT {tail} FROM (SELECT {body} AS s))"
