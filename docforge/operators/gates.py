"""Quality gates F4-F6 and gate reason P1.

Gate order matters and short-circuits: no_text -> short -> low_grade ->
(duplicate, decided by the dedup stage) -> kept.  The grade (the costly
gate) sits inside the CASE so it is only evaluated for texts that passed the
cheap length check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fk_grade, sql_grade, sql_str
from ..params import HarvestParams


def has_text(text: Column) -> Column:
    """extractable text present."""
    return text.isNotNull() & (text != "")


def min_length(text: Column, p: HarvestParams = HarvestParams()) -> Column:
    """len(text) >= min_length."""
    return F.length(text) >= F.lit(p.min_length)


def min_grade(text: Column, p: HarvestParams = HarvestParams()) -> Column:
    """grade >= min_grade (NULL grade, i.e. no words, rejects)."""
    grade = (p.grader or fk_grade)(text)
    return F.coalesce(grade >= F.lit(p.min_grade), F.lit(False))


def gate_reason(text: Column, p: HarvestParams = HarvestParams()) -> Column:
    """First failing gate, in gate order; 'pass' if all pass."""
    return (
        F.when(~has_text(text) | text.isNull(), F.lit("no_text"))
        .when(~min_length(text, p), F.lit("short"))
        .when(~min_grade(text, p), F.lit("low_grade"))
        .otherwise(F.lit("pass"))
    )


def apply_gates(df: DataFrame, text_col: str = "text",
                p: HarvestParams = HarvestParams()) -> DataFrame:
    """Keep rows passing F4, F5, F6 (cheap predicates first)."""
    t = F.col(text_col)
    return df.where(has_text(t)).where(min_length(t, p)).where(min_grade(t, p))


# --- SQL spellings ----------------------------------------------------------

def sql_gate_reason(expr: str, p: HarvestParams = HarvestParams()) -> str:
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN 'no_text' "
            f"WHEN length({expr}) < {p.min_length} THEN 'short' "
            f"WHEN coalesce(({sql_grade(expr)}) >= {float(p.min_grade)}::DOUBLE, false) = false "
            f"THEN 'low_grade' ELSE 'pass' END")


def sql_gates(expr: str, p: HarvestParams = HarvestParams()) -> str:
    return f"({sql_gate_reason(expr, p)}) = {sql_str('pass')}"
