"""Text scalars as Column -> Column functions (X6, X7, X10, X14; X5 is ``length``).

All patterns are written so that the same string means the same thing in
Java regex (Spark) and RE2 (the DuckDB oracle): explicit character classes,
no look-around, ``\\z`` for end of input.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PY_WHITESPACE

# Character class of Python whitespace (str.split / str.strip).
WS = "[" + PY_WHITESPACE + "]"
WS_RUN = WS + "+"
# The same run for Java regex only: one predicate and four characters instead of one each.
JAVA_WS_RUN = "[\\p{javaWhitespace}\\x85\\xa0\\u2007\\u202f]+"
# Leading or trailing whitespace run (one pass strips both ends).
STRIP_PATTERN = "^" + WS_RUN + "|" + WS_RUN + "\\z"
# A sentence end: a run of terminal punctuation followed by blank or end.
SENTENCE_END = "[.!?]+(" + WS + "|\\z)"
VOWEL_GROUP = "[aeiouy]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regex_quote(literal: str) -> str:
    """Quote a literal for use as a (Java) regex."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def py_strip(col) -> Column:
    """``str.strip()`` with Unicode whitespace (X14): looks at the ends, not at every blank inside."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def ws_tokens(col) -> Column:
    """``str.split()`` (X7): whitespace runs, no case folding, punctuation kept."""
    return F.filter(F.split(_c(col), JAVA_WS_RUN, -1), lambda t: t != "")


def paragraphs(col, sep: str = "\n\n") -> Column:
    """``text.split(sep)`` (X10), trailing empty strings kept."""
    return F.split(_c(col), regex_quote(sep), -1)


def _grade_counts_udf():
    # closes over arrays and constants only: shipped to the Python workers by value
    wide = re.compile("[" + "".join(c for c in PY_WHITESPACE if ord(c) > 127) + "]")
    white, vowel, silent, stop = (np.isin(np.arange(256), [ord(c) for c in chars])
                                  for chars in (PY_WHITESPACE.encode("ascii", "ignore").decode(), "aeiouyAEIOUY", "eE", ".!?"))
    block = 1 << 20

    def plain(text: str) -> bytes:
        """Without blanks beyond ASCII, and the only other letter whose lower case has a vowel of ours."""
        if not text.isascii():
            text = wide.sub(" ", text).replace("\u0130", "i\u0307")
        return text.encode()

    def counted(texts: list[bytes]) -> np.ndarray:
        """Words, sentence ends, syllables of each text.  Blanks between the texts end words,
        and no vowel group reaches over a blank."""
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        blank, sound = white[data], vowel[data]
        last = np.flatnonzero(blank[1:] > blank[:-1])       # last byte of each word
        groups = np.cumsum(sound[1:] > sound[:-1], dtype=np.int32)[last - 1]
        per_word = np.maximum(1, np.diff(groups, prepend=0) - silent[data[last]])
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate(([0], np.searchsorted(last, ends, side="left")))
        total = lambda n: np.diff(np.concatenate(([0], np.cumsum(n)))[cut])
        return np.stack([np.diff(cut), total(stop[data[last]]), total(per_word)], axis=1)

    @F.pandas_udf("struct<words:bigint,sentences:bigint,syllables:bigint>")
    def grade_counts(texts: pd.Series) -> pd.DataFrame:
        out, part, size = [np.zeros((0, 3), dtype=np.int64)], [], 0
        for text in texts:
            part.append(plain(text) if text else b"")
            size += len(part[-1])
            if size >= block:
                out.append(counted(part))
                part, size = [], 0
        if part:
            out.append(counted(part))
        return pd.DataFrame(np.concatenate(out), columns=["words", "sentences", "syllables"])

    return grade_counts


def grade_parts(col) -> dict[str, Column]:
    """Word, sentence and syllable counts used by the reading grade, in one pass over the
    bytes of a batch of texts.  A word's syllables are its vowel groups (a e i o u y) minus a
    silent final ``e``, at least 1; a sentence end is the end of a word that ends in ``.!?``."""
    text = _c(col)
    n = _grade_counts_udf()(text)
    return {"words": F.when(text.isNotNull(), n["words"]),
            "sentences": F.greatest(F.lit(1).cast("bigint"), n["sentences"]),
            "syllables": F.when(text.isNotNull(), n["syllables"])}


def fk_grade(col) -> Column:
    """Flesch-Kincaid grade (X6): 0.39 w/s + 11.8 syl/w - 15.59; NULL when no words."""
    p = grade_parts(col)
    w = p["words"].cast("double")
    s = p["sentences"].cast("double")
    syl = p["syllables"].cast("double")
    return F.when(
        p["words"] > 0,
        F.lit(0.39) * w / s + F.lit(11.8) * syl / w - F.lit(15.59),
    )


# --- SQL (DuckDB) spellings of the same rules, used by the oracles ----------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {sql_str(WS_RUN)}), lambda t: t <> '')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str(STRIP_PATTERN)}, '', 'g')"


def sql_grade(expr: str) -> str:
    toks = sql_tokens(expr)
    words = f"len({toks})"
    sents = f"greatest(1, len(regexp_extract_all({expr}, {sql_str(SENTENCE_END)})))"
    syl = (f"coalesce(list_sum(list_transform({toks}, lambda t: greatest(1, "
           f"len(regexp_extract_all(lower(t), '{VOWEL_GROUP}')) - "
           f"CASE WHEN ends_with(lower(t), 'e') THEN 1 ELSE 0 END))), 0)")
    return (f"CASE WHEN {words} > 0 THEN 0.39::DOUBLE * ({words})::DOUBLE / ({sents})::DOUBLE"
            f" + 11.8::DOUBLE * ({syl})::DOUBLE / ({words})::DOUBLE - 15.59::DOUBLE END")
