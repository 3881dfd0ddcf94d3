"""Removal of boilerplate lines by their frequency within a site.

A line is boilerplate on a host when more than a given share of the host's pages contain it. Lines are counted once
per page by each task before anything is shuffled; what travels is the 128-bit digest of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import broadcast_below, stored, unused
from costproof.runtime import broadcast_if_small

RATIO = 0.1
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``host, lines``: the digests of each host's boilerplate lines.

    A page counts once for a line however often it repeats it. Empty lines are never boilerplate. A list
    holds fewer digests than the host's mean distinct lines per page divided by ``ratio``.
    """
    per_page = pages.select(F.col(host).alias("host"), _lines(F.col(text)).alias("lines"))
    digests = F.transform(F.array_distinct(F.filter("lines", lambda x: x != "")), lambda x: F.md5(x.cast("binary")))
    seen = per_page.select("host", F.explode(digests).alias("line")).groupBy("host", "line").count()
    totals = per_page.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "site")
    often = seen.where(F.col("count") >= min_pages)
    often = often.join(broadcast_if_small(totals), F.col("host").eqNullSafe(F.col("site")))
    often = stored(often.where(F.col("count") > F.col("pages") * ratio).select("host", "line"), "boilerplate")
    lists = often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return stored(lists, "boilerplate-lists")


def marked(
    pages: DataFrame,
    kept: str,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with the array ``kept`` of the lines that stay; null where the text is null.

    A null host is a host of its own. Repeated rows are pages like any other.
    """
    (site, drop) = unused(pages, "site", "drop")
    found = boilerplate(pages, host, text, ratio, min_pages).toDF(site, drop)
    found = broadcast_below(found, 64 + 40 * F.size(drop))
    joined = pages.join(found, pages[host].eqNullSafe(found[site]), "left")
    stays = F.filter(
        _lines(F.col(text)), lambda x: (x == "") | ~F.array_contains(F.col(drop), F.md5(x.cast("binary")))
    )
    whole = F.when(F.col(drop).isNull(), _lines(F.col(text))).otherwise(stays)
    return joined.withColumn(kept, whole).select(*pages.columns, kept)


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """``pages`` without boilerplate lines; every other column and line stays as it was."""
    (kept,) = unused(pages, "kept")
    out = marked(pages, kept, host, text, **limits)
    return out.withColumn(text, F.array_join(kept, "\n")).select(*pages.columns)
