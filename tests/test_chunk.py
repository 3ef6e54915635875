"""C1 chunk fold: the length table of FIXTURES section 4, and invariants."""

import pytest
from pyspark.sql import functions as F

from docforge.operators.chunk import chunk_column
from docforge.params import HarvestParams
from tests.conftest import SF_SMALL

CASES = [
    ([1500], []),
    ([900, 900, 900], [1802]),
    ([900] * 6, [1802, 1800]),
    ([5000], []),
    ([5000, 100], [5000]),
    ([150, 1990, 10], [1990]),
    ([198, 1990, 300, 1990], [1990, 300]),
    ([999, 999, 999], [999]),
    ([1000, 999, 1], [1000]),
]


def paragraphs_of(lengths):
    return [chr(ord("a") + i % 26) * n for i, n in enumerate(lengths)]


def fold(spark, texts, p):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.c for r in df.select("i", chunk_column(F.col("t"), p).alias("c")).collect()}


def check_invariants(text, chunks, p):
    """What every result must satisfy, whatever the paragraphs are."""
    flat = "".join(text.split(p.sep))
    at = 0
    for c in chunks:
        body = "".join(c.split(p.sep))
        # chunks are disjoint stretches of the text, in its order, cut at paragraphs
        found = flat.find(body.strip(), at)
        assert found >= 0
        at = found + len(body.strip())
        assert c == c.strip() and len(c) <= max(p.chunk_max + len(p.sep), *map(len, text.split(p.sep)))
    if sum(len(x) + len(p.sep) for x in text.split(p.sep)) < p.chunk_max:
        assert chunks == []                          # what never overflows is a tail
    if chunks:
        assert len(text) >= p.chunk_max


@pytest.mark.parametrize("lengths,expected", CASES)
def test_fixture_lengths(spark, lengths, expected):
    text = "\n\n".join(paragraphs_of(lengths))
    got = fold(spark, [text], HarvestParams())[0]
    assert [len(c) for c in got] == expected
    check_invariants(text, got, HarvestParams())


@pytest.mark.parametrize("first,flushed", [(197, False), (198, False), (199, True), (200, True)])
def test_least_length_counts_the_separator(spark, first, flushed):
    """A flushed buffer of one paragraph and its separator must be over 200."""
    got = fold(spark, ["\n\n".join(paragraphs_of([first, 1990]))], HarvestParams())[0]
    assert [len(c) for c in got] == ([first] if flushed else [])


@pytest.mark.parametrize("second,flushed", [(1099, False), (1100, True)])
def test_flush_when_lengths_reach_the_maximum(spark, second, flushed):
    """898 + 2 + x reaches 2000 at x = 1100."""
    got = fold(spark, ["\n\n".join(paragraphs_of([898, second]))], HarvestParams())[0]
    assert [len(c) for c in got] == ([898] if flushed else [])


def test_options(spark):
    text = "\n\n".join(paragraphs_of([900] * 6))
    assert [len(c) for c in fold(spark, [text], HarvestParams(emit_tail=True))[0]] == [1802, 1800, 1800]
    assert [len(c) for c in fold(spark, [text], HarvestParams(glue_bug=False))[0]] == [1802, 1802]


def test_documents(spark):
    p = HarvestParams(sep="\n")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    rows = docs.select("text", chunk_column(F.col("text"), p).alias("c")).collect()
    for r in rows:
        check_invariants(r.text, r.c, p)
    assert sum(len(r.c) for r in rows) > 0
