"""Line dedup by site-relative frequency.

A line that stands on more than a given share of a site's pages is boilerplate of
that site (menus, notices, templates) and is dropped from all of them. The same line
may be content elsewhere, so each site is judged by its own pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh
from .storage import materialise

#: A line is boilerplate on more than this share of a site's pages ...
MAX_RATIO = 0.08
#: ... and on at least this many of them: on a site of few pages a share says nothing.
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    """Lines are compared without the white space around them."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def boilerplate(
    pages: DataFrame, *, site: str | Column = "source", text: str | Column = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False,
) -> DataFrame:
    """The boilerplate lines: site, ``line`` (a hash), ``n_pages`` with it and ``site_pages`` in all.

    A page counts once however often it repeats a line; repeated rows are pages of their
    own, or with ``copies_once`` all rows of one site and text (by its hash) are one page. Blank lines and pages without a site are left out. Counts are summed before
    the shuffle, so a site with a third of all pages, or a line on all of them, is
    a few rows per task.
    """
    site = F.col(site) if isinstance(site, str) else site
    text = F.col(text) if isinstance(text, str) else text
    pages = pages.select(site.alias("site"), text.alias("text")).where(F.col("site").isNotNull())
    keys = F.array_distinct(F.transform(_visible(F.split("text", "\n", -1)), line_key))
    if copies_once:
        # Copies are merged in each task before the shuffle, so a large group of them is a few rows; of a text only the
        # hashes of its lines are shuffled.
        pages = pages.select("site", F.xxhash64("text").alias("copy"), keys.alias("keys"))
        pages = pages.groupBy("site", "copy").agg(F.first("keys").alias("keys"))
    else:
        pages = pages.select("site", keys.alias("keys"))
    totals = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    lines = pages.select("site", F.explode("keys").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n_pages"))
    # A site of few pages is asked first: most lines stand on one page and need no join.
    often = lines.where(F.col("n_pages") >= min_pages)
    return often.join(totals, "site").where(F.col("n_pages") > F.lit(max_ratio) * F.col("site_pages"))


def _visible(lines: Column) -> Column:
    return F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(" \t\r\x0b\x0c"))) > 0)


def drop_boilerplate(
    pages: DataFrame, *, site: str = "source", text: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None,
    copies_once: bool = False, keep_emptied: bool = False,
) -> DataFrame:
    """The pages without their site's boilerplate lines; ``dropped`` names a column for how many went.

    Every row comes back. A page of nothing else gets an empty text, a null text stays
    null, and a page without a site stays as it is. Other columns are not touched; one
    with the name of ``dropped`` is replaced.

    ``copies_once`` counts pages of one site and text as one. With ``keep_emptied`` a page of
    boilerplate only keeps its text: such pages are mostly members of a group of copies, whose text
    would be lost with all of them; finding one page of each group is left to near-dedup.

    A site has at most (mean lines per page / max_ratio) boilerplate lines, as each takes
    up more than that share of its pages. So their list per site is short, whatever the
    site's size, and the texts meet it in one join on the site, where Spark broadcasts
    the lists if they measure small and splits large sites otherwise.
    """
    found = boilerplate(pages, site=site, text=text, max_ratio=max_ratio, min_pages=min_pages, copies_once=copies_once)
    lists = materialise(found.groupBy("site").agg(F.collect_list("line").alias("lines")), "boilerplate")
    of, lines, left = fresh(pages, "site_of_lines", "boilerplate_lines", "kept_lines")
    joined = pages.join(lists.select(F.col("site").alias(of), F.col("lines").alias(lines)), F.col(site) == F.col(of), "left")
    parts = F.split(text, "\n", -1)
    kept = F.filter(parts, lambda line: ~F.array_contains(lines, line_key(line)))
    hit = F.col(lines).isNotNull() & F.col(text).isNotNull()
    cleaned = joined.withColumn(left, F.when(hit, kept))
    if keep_emptied:
        cleaned = cleaned.withColumn(left, F.when(F.size(_visible(F.col(left))) > 0, F.col(left)).otherwise(F.when(hit, parts)))
    count = F.when(hit, F.size(F.split(text, "\n", -1)) - F.size(left)).otherwise(0).cast("bigint")
    if dropped:
        cleaned = cleaned.withColumn(dropped, count)
    cleaned = cleaned.withColumn(text, F.when(hit, F.array_join(left, "\n")).otherwise(F.col(text)))
    return cleaned.drop(of, lines, left)
