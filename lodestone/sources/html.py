"""HTML pages as columns: plain text, title, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
DROPPED = "script|style|nav|footer|header"


def plain_text(html) -> Column:
    """Text without scripts, styles, menus, headers and footers; one line a block, empty lines dropped."""
    h = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(h, rf"(?is)<({DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]+>", "\n")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(value))
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title(html, url) -> Column:
    """First heading, else the title element, else the address."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(pick(r"(?is)<h1[^>]*>(.*?)</h1>"), pick(r"(?is)<title[^>]*>(.*?)</title>"), F.col(url) if isinstance(url, str) else url)


def host(url) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def links(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, pos, link (absolute): the first place of each link of a page."""
    found = pages.select(page, url, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s+href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    absolute = F.when(F.col("href").rlike(r"^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0), "href")).otherwise(F.concat(F.regexp_extract(url, r"^[a-z]+://.*/", 0), "href"))
    return found.select(page, "pos", absolute.alias("link")).groupBy(page, "link").agg(F.min("pos").alias("pos"))
