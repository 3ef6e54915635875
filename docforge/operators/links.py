"""Link discovery L1 with its filters F2/F9 and joins J1 (visited anti) and
J2 (domain semi).

Everything up to the joins is map-side (regex extraction, posexplode, URL
resolution).  No side is hinted: AQE broadcasts by the bytes it has measured.
The allow-list and the visited set are written tables, so the link side of a
join is a plain shuffle, and AQE splits a link or a host that a third of all
pages have (tests/test_skew.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import hrefs, netloc, with_url_join
from ..session import materialise


def prepare_domains(domains: DataFrame) -> DataFrame:
    """Distinct allow-list as a written table (once per run)."""
    return materialise(domains.select(F.col("domain").alias("_netloc")).distinct(), "allow-list")


def domain_allowed(df: DataFrame, url_col: str, allowed: DataFrame) -> DataFrame:
    """Keep rows whose URL netloc is in the prepared allow-list (exact,
    case-sensitive; port and userinfo are part of the netloc)."""
    return (df.withColumn("_netloc", netloc(F.col(url_col)))
            .join(allowed, "_netloc", "left_semi").drop("_netloc"))


def not_visited(df: DataFrame, url_col: str, visited: DataFrame) -> DataFrame:
    """Anti join on the URL.  ``visited`` may repeat URLs."""
    return df.join(visited.select(F.col("url").alias(url_col)), url_col, "left_anti")


def resolved(links: DataFrame) -> DataFrame:
    """Resolved links as a written table.  Catalyst moves semi and anti joins below
    the projections that resolve a link, and would repeat all of them in the
    join's condition."""
    return materialise(links, "resolved-links")


def page_links(pages: DataFrame, id_cols: list[str], url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """X3 + X2: (id_cols..., link_pos, link) absolute links of each page, in
    document order (link_pos is 0-based, bigint)."""
    raw = pages.select(*id_cols, F.col(url_col).alias("_base"),
                       F.posexplode(hrefs(F.col(html_col))).alias("link_pos", "_href"))
    joined = with_url_join(raw, "_base", "_href", "link")
    return joined.select(*id_cols, F.col("link_pos").cast("bigint").alias("link_pos"), "link")


def discover_links(pages: DataFrame, id_cols: list[str], domains: DataFrame,
                   visited: DataFrame | None) -> DataFrame:
    """L1: allowed (F9/J2), unseen (J1) absolute links of ``pages``."""
    links = resolved(page_links(pages, id_cols))
    links = domain_allowed(links, "link", prepare_domains(domains))
    if visited is not None:
        links = not_visited(links, "link", materialise(visited.select("url").distinct(), "visited"))
    return links
