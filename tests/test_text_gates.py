"""Quality gates and text scalars (FIXTURES section 3)."""

import re

import pytest
from pyspark.sql import functions as F

from docforge.functions.text import fk_grade, grade_parts, py_strip, ws_tokens
from docforge.operators.gates import gate_reason

SIMPLE = "See spot run. Run spot run. " * 50
TECH = ("The implementation of multi-factor authentication utilizing cryptographic "
        "protocols enhances security posture significantly. ") * 20
GOOD = ("Cloud security architecture requires comprehensive understanding of identity and "
        "access management, encryption mechanisms, network security, and compliance "
        "frameworks. ") * 30


def _one(spark, col_fn, text):
    return spark.createDataFrame([(text,)], "t string").select(col_fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,grade", [(SIMPLE, -2.62), (TECH, 29.41), (GOOD, 24.2)])
def test_grades(spark, text, grade):
    assert _one(spark, fk_grade, text) == pytest.approx(grade, abs=0.01)


def test_reasons_in_gate_order(spark):
    rows = [("",), (None,), ("Too short.",), ("x" * 499,), (SIMPLE,), (TECH,), (GOOD,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.r for r in df.select(gate_reason(F.col("t")).alias("r")).collect()]
    assert got == ["no_text", "no_text", "short", "short", "low_grade", "pass", "pass"]


def test_length_edge(spark):
    five_hundred = ("Word " * 100)[:500]
    assert _one(spark, gate_reason, five_hundred) != "short"
    assert _one(spark, gate_reason, five_hundred[:499]) == "short"


def test_unicode_whitespace(spark):
    text = "a b c\x1cd\ne "
    assert _one(spark, ws_tokens, text) == text.split()
    assert _one(spark, py_strip, "　\n x y  ") == "　\n x y  ".strip()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grade_is_one_pass_over_the_text(spark):
    """The text goes once to the count, and no fold over its tokens is left in the plan."""
    df = spark.createDataFrame([("a b",)], "t string")
    plan = _plan(df.select(gate_reason(F.col("t")).alias("r")))
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_grade_parts_equal_a_count_by_words(spark):
    odd = ["", "  ", "\n", "the", "bee.", "A.B. c!?  d.", "\u0130stanbul E\u0130 e. \u0130e", "x\u2003y.\u3000Z!\x85q?", "...",
           "!!! ?", "rhythm nth", "caf\xe9 \xe0\xc5 vol\xe0. \u0105\u0160 e", "\u212a e\xc9", "a\x1cb\x1de\x1ff", "\ufeffa b\u200bc\xa0d", "queue Eye E ",
           "word. " * 300_000, "last one"]     # longer than a block, and texts after it

    def by_words(text):
        words = text.split()
        groups = lambda w: len(re.findall("[aeiouy]+", w.lower()))
        return (len(words), max(1, sum(w[-1] in ".!?" for w in words)),
                sum(max(1, groups(w) - w.lower().endswith("e")) for w in words))

    df = spark.createDataFrame(list(enumerate([*odd, None])), "i int, t string").coalesce(1)
    got = {r.i: (r.words, r.sentences, r.syllables) for r in df.select(
        "i", *[c.alias(k) for k, c in grade_parts(F.col("t")).items()]).collect()}
    assert got == {i: by_words(t) for i, t in enumerate(odd)} | {len(odd): (None, 1, None)}
    assert _one(spark, fk_grade, None) is None and _one(spark, fk_grade, " \n") is None


def test_blanks_of_the_plan_are_those_of_python(spark):
    """One rule for split and strip over the whole basic plane; strip looks at the ends only, so no
    pattern is tried at each blank of a text, and split asks one predicate, not one per blank."""
    from docforge.functions.text import JAVA_WS_RUN
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = [(i, f"{c}a{c}{c}b{c}") for i, c in enumerate(chars)] + [(len(chars), "  \t"), (len(chars) + 1, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    out = df.select("t", py_strip(F.col("t")).alias("s"), ws_tokens(F.col("t")).alias("w"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "javaWhitespace" in plan and len(JAVA_WS_RUN) < 50
    for r in out.collect():
        assert (r.s, r.w) == (r.t.strip(), r.t.split()), ascii(r.t)
