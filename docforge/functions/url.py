"""URL scalars (X1 netloc, X2 url_join, X3 href_extract) as native Columns.

X2 follows RFC 3986 section 5.2 the way Python's ``urljoin`` does for
hierarchical schemes: the link keeps its fragment, empty ``?``/``#`` parts
are dropped, a relative path is merged with the base directory (empty middle
segments collapse), dot segments are removed, and a link with another scheme
(``mailto:``, ``javascript:``, ``http:`` on an https page) is returned as is.
``;params`` are treated as part of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import HREF_RE
from .text import sql_str

SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_RE = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# after the scheme: (//netloc)? path (?query)? (#fragment)?
PARTS_RE = "^(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?"
DOT_SEGMENT_RE = "(^|/)\\.\\.?(/|$)"
UNSAFE_RE = "[\\t\\r\\n]"
LEADING_C0_RE = "^[\\x00-\\x20]+"

# schemes that resolve relative references and carry a netloc
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]


def netloc(url: Column) -> Column:
    """Authority part (port and userinfo included), '' when absent."""
    return F.regexp_extract(url, NETLOC_RE, 1)


def hrefs(html: Column) -> Column:
    """Every href target, in document order (case-sensitive, unquoted ok)."""
    return F.regexp_extract_all(html, F.lit(HREF_RE), F.lit(1))


def _clean(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(u, UNSAFE_RE, ""), LEADING_C0_RE, "")


def _unsplit(scheme: Column, net: Column, path: Column, query: Column, frag: Column) -> Column:
    p = F.when((net != "") & (path != "") & ~F.startswith(path, F.lit("/")),
               F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when(net != "", F.concat(F.lit("//"), net, p)).otherwise(p)
    out = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(frag != "", F.concat(out, F.lit("#"), frag)).otherwise(out)


def with_url_join(df: DataFrame, base_col: str, link_col: str, out_col: str) -> DataFrame:
    """Add ``out_col`` = ``link`` resolved against ``base`` (like Python's
    ``urljoin``).  Written as a few staged projections so that every part is
    computed once (a single nested expression would repeat sub-terms)."""
    c = F.col
    keep = [c(x) for x in df.columns]
    s1 = df.select(*keep, _clean(c(base_col)).alias("_ub"), _clean(c(link_col)).alias("_ul"))
    s2 = s1.select("*", F.lower(F.regexp_extract("_ub", SCHEME_RE, 1)).alias("_ubs"),
                   F.lower(F.regexp_extract("_ul", SCHEME_RE, 1)).alias("_uls0"))
    s3 = s2.select(
        "*",
        F.when(c("_ubs") != "", F.expr("substring(_ub, length(_ubs) + 2)"))
        .otherwise(c("_ub")).alias("_ubr"),
        F.when(c("_uls0") != "", F.expr("substring(_ul, length(_uls0) + 2)"))
        .otherwise(c("_ul")).alias("_ulr"),
        F.when(c("_uls0") != "", c("_uls0")).otherwise(c("_ubs")).alias("_uls"))
    s4 = s3.select(
        "*",
        F.regexp_extract("_ubr", PARTS_RE, 2).alias("_bn"),
        F.regexp_extract("_ubr", PARTS_RE, 3).alias("_bp"),
        F.regexp_extract("_ubr", PARTS_RE, 5).alias("_bq"),
        F.regexp_extract("_ulr", PARTS_RE, 2).alias("_ln"),
        F.regexp_extract("_ulr", PARTS_RE, 3).alias("_lp"),
        F.regexp_extract("_ulr", PARTS_RE, 5).alias("_lq"),
        F.regexp_extract("_ulr", PARTS_RE, 7).alias("_lf"))
    s5 = s4.select(
        "*",
        F.startswith(c("_lp"), F.lit("/")).alias("_abs"),
        F.split(c("_bp"), "/", -1).alias("_bd0"))
    s6 = s5.select(
        "*",
        F.concat(
            F.when(F.element_at(c("_bd0"), -1) != "",
                   F.slice(c("_bd0"), 1, F.size(c("_bd0")) - 1)).otherwise(c("_bd0")),
            F.split(c("_lp"), "/", -1)).alias("_m0"))
    n = F.size(c("_m0"))
    s7 = s6.select(
        "*",
        F.when(c("_abs"), F.split(c("_lp"), "/", -1)).when(
            n > 2,
            F.concat(F.slice(c("_m0"), 1, 1),
                     F.filter(F.slice(c("_m0"), 2, F.greatest(n - 2, F.lit(1))),
                              lambda x: x != ""),
                     F.slice(c("_m0"), -1, 1)),
        ).otherwise(c("_m0")).alias("_segs"))
    folded = F.aggregate(
        c("_segs"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == ".", acc)
        .otherwise(F.array_append(acc, x)))
    s8 = s7.select(
        "*",
        F.when(c("_abs") & ~c("_lp").rlike(DOT_SEGMENT_RE), c("_lp"))
        .otherwise(F.array_join(
            F.when(F.element_at(c("_segs"), -1).isin(".", ".."),
                   F.array_append(folded, F.lit(""))).otherwise(folded), "/"))
        .alias("_r0"))
    resolved = F.when(c("_r0") == "", F.lit("/")).otherwise(c("_r0"))
    relative_ok = (c("_uls") == c("_ubs")) & c("_uls").isin(*RELATIVE_SCHEMES)
    base, link = c(base_col), c(link_col)
    out = (
        F.when(base.isNull() | (base == ""), link)
        .when(link.isNull() | (link == ""), base)
        .when(~relative_ok, link)
        .when(c("_ln") != "", _unsplit(c("_uls"), c("_ln"), c("_lp"), c("_lq"), c("_lf")))
        .when(c("_lp") == "", _unsplit(c("_uls"), c("_bn"), c("_bp"),
                                       F.when(c("_lq") != "", c("_lq")).otherwise(c("_bq")),
                                       c("_lf")))
        .otherwise(_unsplit(c("_uls"), c("_bn"), resolved, c("_lq"), c("_lf")))
    )
    # non-nullable output: Catalyst then infers no IsNotNull(link) filters,
    # which it would otherwise push below the staged projections by inlining
    # the whole resolution expression (very large generated code)
    return s8.select(*keep, F.coalesce(out, F.lit("")).alias(out_col))


# --- SQL spellings ----------------------------------------------------------

def sql_netloc(expr: str) -> str:
    return f"regexp_extract({expr}, {sql_str(NETLOC_RE)}, 1)"


def sql_hrefs(expr: str) -> str:
    return f"regexp_extract_all({expr}, {sql_str(HREF_RE)}, 1)"


def _sql_parts(rest: str) -> dict[str, str]:
    return {k: f"regexp_extract({rest}, {sql_str(PARTS_RE)}, {g})"
            for k, g in (("netloc", 2), ("path", 3), ("query", 5), ("fragment", 7))}


def _sql_unsplit(scheme: str, net: str, path: str, query: str, frag: str) -> str:
    p = (f"(CASE WHEN {net} <> '' AND {path} <> '' AND NOT starts_with({path}, '/') "
         f"THEN '/' || {path} ELSE {path} END)")
    body = f"(CASE WHEN {net} <> '' THEN '//' || {net} || {p} ELSE {p} END)"
    out = f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' || {body} ELSE {body} END)"
    out = f"(CASE WHEN {query} <> '' THEN {out} || '?' || {query} ELSE {out} END)"
    return f"(CASE WHEN {frag} <> '' THEN {out} || '#' || {frag} ELSE {out} END)"


def sql_url_join(src: str, base: str, link: str, out: str) -> str:
    """DuckDB spelling of ``with_url_join``: SELECT over relation ``src``
    adding column ``out`` (staged subqueries, same steps)."""
    parts = sql_str(PARTS_RE)
    rel = "[" + ", ".join(sql_str(x) for x in RELATIVE_SCHEMES) + "]"
    q = f"""(SELECT *, regexp_replace(regexp_replace({base}, {sql_str(UNSAFE_RE)}, '', 'g'),
                    {sql_str(LEADING_C0_RE)}, '') AS _ub,
                 regexp_replace(regexp_replace({link}, {sql_str(UNSAFE_RE)}, '', 'g'),
                    {sql_str(LEADING_C0_RE)}, '') AS _ul FROM {src})"""
    q = f"""(SELECT *, lower(regexp_extract(_ub, {sql_str(SCHEME_RE)}, 1)) AS _ubs,
                 lower(regexp_extract(_ul, {sql_str(SCHEME_RE)}, 1)) AS _uls0 FROM {q})"""
    q = f"""(SELECT *, CASE WHEN _ubs <> '' THEN substr(_ub, length(_ubs) + 2) ELSE _ub END AS _ubr,
                 CASE WHEN _uls0 <> '' THEN substr(_ul, length(_uls0) + 2) ELSE _ul END AS _ulr,
                 CASE WHEN _uls0 <> '' THEN _uls0 ELSE _ubs END AS _uls FROM {q})"""
    q = f"""(SELECT *, regexp_extract(_ubr, {parts}, 2) AS _bn, regexp_extract(_ubr, {parts}, 3) AS _bp,
                 regexp_extract(_ubr, {parts}, 5) AS _bq, regexp_extract(_ulr, {parts}, 2) AS _ln,
                 regexp_extract(_ulr, {parts}, 3) AS _lp, regexp_extract(_ulr, {parts}, 5) AS _lq,
                 regexp_extract(_ulr, {parts}, 7) AS _lf FROM {q})"""
    q = f"""(SELECT *, starts_with(_lp, '/') AS _abs, string_split(_bp, '/') AS _bd0 FROM {q})"""
    q = f"""(SELECT *, list_concat(CASE WHEN _bd0[-1] <> '' THEN list_slice(_bd0, 1, len(_bd0) - 1)
                                        ELSE _bd0 END, string_split(_lp, '/')) AS _m0 FROM {q})"""
    q = f"""(SELECT *, CASE WHEN _abs THEN string_split(_lp, '/')
                           WHEN len(_m0) > 2 THEN list_concat(list_concat(list_slice(_m0, 1, 1),
                                list_filter(list_slice(_m0, 2, len(_m0) - 1), lambda x: x <> '')),
                                list_slice(_m0, len(_m0), len(_m0)))
                           ELSE _m0 END AS _segs FROM {q})"""
    q = f"""(SELECT *, list_reduce(_segs, lambda acc, x: CASE WHEN x = '..' THEN
                        list_slice(acc, 1, greatest(len(acc) - 1, 0)) WHEN x = '.' THEN acc
                        ELSE list_append(acc, x) END, []::VARCHAR[]) AS _fold FROM {q})"""
    q = f"""(SELECT *, CASE WHEN _abs AND NOT regexp_matches(_lp, {sql_str(DOT_SEGMENT_RE)}) THEN _lp
                           ELSE array_to_string(CASE WHEN list_contains(['.', '..'], _segs[-1])
                                THEN list_append(_fold, '') ELSE _fold END, '/') END AS _r0 FROM {q})"""
    resolved = "(CASE WHEN _r0 = '' THEN '/' ELSE _r0 END)"
    LQ_OR_BQ = "(CASE WHEN _lq <> '' THEN _lq ELSE _bq END)"
    outx = (f"CASE WHEN {base} IS NULL OR {base} = '' THEN {link} "
            f"WHEN {link} IS NULL OR {link} = '' THEN {base} "
            f"WHEN NOT (_uls = _ubs AND list_contains({rel}, _uls)) THEN {link} "
            f"WHEN _ln <> '' THEN {_sql_unsplit('_uls', '_ln', '_lp', '_lq', '_lf')} "
            f"WHEN _lp = '' THEN {_sql_unsplit('_uls', '_bn', '_bp', LQ_OR_BQ, '_lf')} "
            f"ELSE {_sql_unsplit('_uls', '_bn', resolved, '_lq', '_lf')} END")
    drop = "_ub, _ul, _ubs, _uls0, _ubr, _ulr, _uls, _bn, _bp, _bq, _ln, _lp, _lq, _lf, _abs, _bd0, _m0, _segs, _fold, _r0"
    return f"(SELECT * EXCLUDE ({drop}), {outx} AS {out} FROM {q})"
