"""X4 main_text: boilerplate-free text from raw HTML, and F10 payloads in bytes.

Rules, in order:
1. drop comments and the blocks head, script, style, noscript, template,
   nav, header, footer, aside, form;
2. drop ad boxes, ``<div class="ad">`` up to the ``</div>`` that closes it: divs inside are
   counted.  From a box on that is never closed, nothing is dropped;
3. ``<br>`` -> newline; table cells -> tab; block-level tags -> blank line;
4. drop every remaining tag;
5. decode each character reference once: decimal, hexadecimal and the named ones of
   HTML 4 (``html.entities``); unknown ones stay;
6. tidy blanks: spaces around newlines, runs of spaces, 3+ newlines -> 2;
7. strip.
Blocks therefore come out separated by ``\\n\\n``, which the chunk fold needs.

Most steps are RE2-compatible ``regexp_replace`` patterns, the same in Spark and SQL.  Every
step names its input once, so that Catalyst has nothing to repeat; where a step has to, the
input is bound to a lambda's variable (``bound``).

A payload in bytes is decoded by its byte order mark, else by the charset that a meta element
of its first 1,024 bytes names, else as UTF-8.  Labels of Latin-1 and ASCII mean Windows-1252,
as browsers read them.  One that its charset can't decode, or whose charset isn't known, is
``undecodable``.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STRIP_PATTERN, sql_str

BLOCKS = ["head", "script", "style", "noscript", "template", "nav", "header", "footer",
          "aside", "form"]
BLOCK_TAGS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main",
              "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "thead", "tbody", "tfoot",
              "caption", "blockquote", "pre", "figure", "figcaption", "hr", "body", "html",
              "title"]

# (pattern, replacement) steps before ad boxes, and from there to entity decoding
DROP: list[tuple[str, str]] = (
    [("(?s)<!--.*?-->", "")]
    + [(f"(?is)<{t}\\b[^>]*>.*?</{t}\\s*>", "") for t in BLOCKS]
)
TAGS: list[tuple[str, str]] = [
    ("(?i)<br\\b[^>]*>", "\n"),
    ("(?i)</?(td|th)\\b[^>]*>", "\t"),
    ("(?i)</?(" + "|".join(BLOCK_TAGS) + ")\\b[^>]*>", "\n\n"),
    ("(?s)<[^>]*>", ""),
]
BOX = "(?i)<div\\b[^>]*class=[\"']?ad[\"' >]"
DIV_END = "(?i)^</div\\s*>"
# tidy-up steps after entity decoding
TIDY: list[tuple[str, str]] = [
    ("[ \\t\\r\\x0b\\x0c]*\\n[ \\t\\r\\x0b\\x0c]*", "\n"),
    ("[ \\r\\x0b\\x0c]{2,}", " "),
    ("\\n{3,}", "\n\n"),
]


REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
NAMED = {**name2codepoint, "apos": ord("'")}
MAX_CODE = 0x10FFFF


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with x evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _code_point(ref: Column) -> Column:
    """Code point of the inside of a reference, NULL if there is none."""
    named = F.create_map(*[F.lit(x) for kv in sorted(NAMED.items()) for x in kv])
    return F.when(F.startswith(F.lower(ref), F.lit("#x")), F.conv(F.substring(ref, 3, 6), 16, 10).cast("int")) \
        .when(F.startswith(ref, F.lit("#")), F.substring(ref, 2, 7).cast("int")) \
        .otherwise(F.element_at(named, ref))


def decode_references(text: Column) -> Column:
    """Every character reference decoded once: the text is cut before each ``&``, and a piece
    that begins with a reference gets its character instead."""
    pieces = F.transform(F.split(text, "&"), lambda p, k: F.struct(
        p.alias("text"), F.when(k > 0, F.regexp_extract(p, "^" + REFERENCE[1:], 1)).alias("ref")))
    coded = F.transform(pieces, lambda p: F.struct(
        p["text"].alias("text"), p["ref"].alias("ref"),
        F.when(p["ref"] != "", _code_point(p["ref"])).alias("cp")))
    good = lambda cp: (cp > 0) & (cp <= MAX_CODE) & ~cp.between(0xD800, 0xDFFF)
    char = lambda cp: F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return F.array_join(F.transform(coded, lambda p: F.when(p["ref"].isNull(), p["text"]).when(
        good(p["cp"]), F.concat(char(p["cp"]), F.substring(p["text"], F.length(p["ref"]) + 2, F.length(p["text"]))))
        .otherwise(F.concat(F.lit("&"), p["text"]))), "")


def drop_boxes(html: Column) -> Column:
    """Without its ad boxes: a fold over the pieces between div tags that carries the depth
    inside the open box and the stretches that closed boxes take."""
    pieces = F.transform(F.split(html, "(?i)(?=</?div\\b)"), lambda p: F.struct(
        F.when(F.rlike(p, F.lit("^" + BOX)), F.lit(2)).when(F.rlike(p, F.lit("(?i)^<div\\b")), F.lit(1))
        .when(F.rlike(p, F.lit(DIV_END)), F.lit(-1)).otherwise(F.lit(0)).alias("kind"),
        F.length(p).alias("len"), F.length(F.regexp_extract(p, DIV_END, 0)).alias("end")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("box"),
                     F.array().cast("array<struct<s:int,e:int>>").alias("cuts"))

    def step(acc, p):
        inside = acc["depth"] > 0
        opens = ~inside & (p["kind"] == 2)
        closes = inside & (acc["depth"] == 1) & (p["kind"] == -1)
        return F.struct(
            (acc["at"] + p["len"]).alias("at"),
            F.when(opens, F.lit(1)).when(inside, acc["depth"] + F.signum(p["kind"]).cast("int"))
            .otherwise(F.lit(0)).alias("depth"),
            F.when(opens, acc["at"]).otherwise(acc["box"]).alias("box"),
            F.when(closes, F.array_append(acc["cuts"], F.struct(
                acc["box"].alias("s"), (acc["at"] + p["end"]).alias("e")))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate(pieces, start, step, lambda acc: acc["cuts"])
    # what lies before each box, and after the last one
    return bound(cuts, lambda c: F.concat(
        F.array_join(F.transform(c, lambda x, k: F.substring(
            html, F.when(k > 0, F.get(c, k - 1)["e"]).otherwise(F.lit(0)) + 1,
            x["s"] - F.when(k > 0, F.get(c, k - 1)["e"]).otherwise(F.lit(0)))), ""),
        F.substring(html, F.coalesce(F.try_element_at(c, F.lit(-1))["e"], F.lit(0)) + 1, F.length(html))))


def main_text(html: Column) -> Column:
    """X4 over a raw-HTML column; '' when nothing is left."""
    x = html
    for pat, rep in DROP:
        x = F.regexp_replace(x, pat, rep)
    x = bound(x, lambda v: F.when(F.rlike(v, F.lit(BOX)), drop_boxes(v)).otherwise(v))
    for pat, rep in TAGS:
        x = F.regexp_replace(x, pat, rep)
    x = decode_references(x)
    for pat, rep in TIDY:
        x = F.regexp_replace(x, pat, rep)
    return F.regexp_replace(x, STRIP_PATTERN, "")


# --- F10: payloads in bytes --------------------------------------------------

#: labels by the charset that they mean
LABELS = {
    "utf-8": "UTF-8", "utf8": "UTF-8",
    "windows-1252": "windows-1252", "cp1252": "windows-1252", "iso-8859-1": "windows-1252",
    "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252",
    "utf-16le": "UTF-16LE", "utf-16": "UTF-16LE", "utf-16be": "UTF-16BE",
}
META = "(?i)<meta\\b[^>]*charset\\s*=\\s*[\"']?([A-Za-z0-9_.:-]+)"
#: UTF-16 as hexadecimal digits: no surrogate that stands alone
PAIRED = {"UTF-16BE": "^(?:[0-9A-CEF]...|D[0-7]..|D[89AB]..D[C-F]..)*+$",
          "UTF-16LE": "^(?:..[0-9A-CEF].|..D[0-7]|..D[89AB]..D[C-F])*+$"}


def _windows_1252(payload: Column) -> Column:
    """The bytes 80 to 9F are characters of their own, and five of them are none (as Python's codec)."""
    own = {chr(b): bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
    text = F.translate(F.decode(payload, "ISO-8859-1"), "".join(own), "".join(own.values()))
    return F.when(~F.contains(text, F.lit("\ufffd")), text)


def decode_payload(payload: Column) -> Column:
    """struct<charset, html>: html is NULL if the payload is NULL or can't be decoded."""
    head = F.hex(F.substring(payload, 1, 3))
    mark = F.when(head == "EFBBBF", F.struct(F.lit("UTF-8").alias("charset"), F.lit(3).alias("skip"))) \
        .when(F.startswith(head, F.lit("FEFF")), F.struct(F.lit("UTF-16BE").alias("charset"), F.lit(2).alias("skip"))) \
        .when(F.startswith(head, F.lit("FFFE")), F.struct(F.lit("UTF-16LE").alias("charset"), F.lit(2).alias("skip")))
    label = F.lower(F.regexp_extract(F.decode(F.substring(payload, 1, 1024), "ISO-8859-1"), META, 1))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    named = F.when(label == "", F.lit("UTF-8")).otherwise(F.coalesce(F.element_at(labels, label), label))
    found = bound(F.coalesce(mark, F.struct(named.alias("charset"), F.lit(0).alias("skip"))), lambda m: F.struct(
        m["charset"].alias("charset"), F.substring(payload, m["skip"] + 1, F.length(payload)).alias("bytes")))
    html = lambda m: (
        F.when(m["charset"] == "UTF-8", F.when(F.is_valid_utf8(m["bytes"].cast("string")), m["bytes"].cast("string")))
        .when(m["charset"] == "windows-1252", _windows_1252(m["bytes"]))
        .when(m["charset"] == "UTF-16LE", F.when(F.rlike(F.hex(m["bytes"]), F.lit(PAIRED["UTF-16LE"])),
                                                F.decode(m["bytes"], "UTF-16LE")))
        .when(m["charset"] == "UTF-16BE", F.when(F.rlike(F.hex(m["bytes"]), F.lit(PAIRED["UTF-16BE"])),
                                                F.decode(m["bytes"], "UTF-16BE"))))
    return F.when(payload.isNotNull(), bound(found, lambda m: F.struct(
        m["charset"].alias("charset"), html(m).alias("html"))))


# --- SQL spellings: boxes by running depth, references by what lies between them ------

def sql_decode_references(expr: str) -> str:
    """Text between references and the references, taken apart by one pattern each."""
    named = ", ".join(f"{sql_str(k)}: {v}" for k, v in sorted(NAMED.items()))
    cp = (f"CASE WHEN lower(r) LIKE '&#x%' THEN ('0x' || substr(r, 4, length(r) - 4))::INT "
          f"WHEN r LIKE '&#%' THEN substr(r, 3, length(r) - 3)::INT "
          f"ELSE (MAP {{{named}}})[substr(r, 2, length(r) - 2)] END")
    char = (f"list_transform(list_transform(regexp_extract_all({expr}, {sql_str(REFERENCE)}), "
            f"lambda r: {{'r': r, 'cp': {cp}}}), lambda x: CASE WHEN x.cp > 0 AND x.cp <= {MAX_CODE} "
            f"AND NOT x.cp BETWEEN 55296 AND 57343 THEN chr(x.cp) ELSE x.r END)")
    between = f"string_split_regex({expr}, {sql_str(REFERENCE)})"
    return f"array_to_string(list_transform(list_zip({between}, {char}), lambda z: z[1] || coalesce(z[2], '')), '')"


def sql_drop_boxes(expr: str) -> str:
    """Depth after each div tag by a running sum.  A box ends at its first later tag whose depth
    lies below the box; a tag and the text behind it stay unless a box before the first
    unclosed one covers them."""
    tag = "(?i)</?div\\b[^>]*>?"
    return f"""(SELECT CASE WHEN NOT regexp_matches(x, {sql_str(BOX)}) THEN x ELSE (
      WITH p AS (SELECT unnest(range(len(t))) AS k, unnest(t) AS tag, unnest(b[2:]) AS txt FROM (
          SELECT regexp_extract_all(x, {sql_str(tag)}) AS t, string_split_regex(x, {sql_str(tag)}) AS b)),
      d AS (SELECT *, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS s,
          sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (ORDER BY k) AS depth FROM p),
      boxes AS (SELECT o.k, (SELECT min(c.k) FROM d c WHERE c.k > o.k AND c.depth < o.depth) AS j
          FROM d o WHERE regexp_matches(o.tag, {sql_str('^' + BOX)})),
      cut AS (SELECT k, j FROM boxes
          WHERE j IS NOT NULL AND k < coalesce((SELECT min(k) FROM boxes WHERE j IS NULL), 1000000000))
      SELECT string_split_regex(x, {sql_str(tag)})[1] || coalesce(string_agg(
          CASE WHEN EXISTS (SELECT 1 FROM cut WHERE d.k >= cut.k AND d.k < cut.j) THEN ''
               WHEN EXISTS (SELECT 1 FROM cut WHERE d.k = cut.j) THEN txt ELSE tag || txt END, '' ORDER BY d.k), '')
      FROM d) END FROM (SELECT {expr} AS x))"""


def sql_main_text(expr: str) -> str:
    """One SELECT per step that names its input more than once."""
    x = expr
    for pat, rep in DROP:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    x = sql_drop_boxes(x)
    for pat, rep in TAGS:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    x = f"(SELECT {sql_decode_references('_s')} FROM (SELECT {x} AS _s))"
    for pat, rep in TIDY:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    return f"regexp_replace({x}, {sql_str(STRIP_PATTERN)}, '', 'g')"
