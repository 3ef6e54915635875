"""Sample construction scalars.

X11 is deterministic: the template index is derived from md5 of
(key, chunk_no, seed), so retries and repartitioning give the same samples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sql_str


def hash31(parts: list[Column]) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(a#b#...)."""
    key = F.concat_ws("#", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def template_index(key: Column, chunk_no: Column, seed: int, n: int) -> Column:
    return (hash31([key, chunk_no, F.lit(seed)]) % F.lit(n)).cast("int")


def instruction(key: Column, chunk_no: Column, topic: Column, templates, seed: int) -> Column:
    """X11 + X12: pick a template, substitute {topic}."""
    arr = F.array(*[F.lit(t) for t in templates])
    idx = template_index(key, chunk_no, seed, len(templates))
    return F.replace(F.element_at(arr, idx + 1), F.lit("{topic}"), topic)


def source_tag(url: Column) -> Column:
    """X13: 'Source: ' + url."""
    return F.concat(F.lit("Source: "), url)


# --- SQL spellings ----------------------------------------------------------

def sql_hash31(parts: list[str]) -> str:
    key = " || '#' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def sql_instruction(key: str, chunk_no: str, topic: str, templates, seed: int) -> str:
    arr = "[" + ", ".join(sql_str(t) for t in templates) + "]"
    idx = f"({sql_hash31([key, chunk_no, str(seed)])} % {len(templates)})"
    return f"replace({arr}[{idx} + 1], '{{topic}}', {topic})"
