"""Main text without what a host repeats on its pages: navigation, notices and banners that markup alone doesn't give away.

A page's main text has one line per block element. A block that stands on at least `SHARE` of a host's pages, on hosts of at least
`MIN_PAGES` pages, belongs to the host's template and is taken out of all of them; single pages and small hosts stay as they are.

Scale: a block counts once per page, combined on the map side; blocks meet their counts by host and text, which spreads a host with
a third of all pages over all tasks. The counts of a host's blocks find its number of pages by a join that adaptive execution can
split, after blocks of a single page are gone. Texts move once more by url, to meet the positions to drop.

Defined results: rows without text have no blocks and stay. Blank lines are no blocks and go. Urls without :// share the empty host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.generate import exploded
from gleanery.functions.tokens import WHITESPACE

SHARE = 0.5
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def blocks_of(text: Column) -> Column:
    """The non-blank lines of a text, trimmed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(WHITESPACE)))
    return F.filter(lines, lambda line: line != "")


def template_blocks(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, block, n_pages of the blocks that most pages of a host have; pages: url and main_content, one row per url."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), blocks_of(F.col("main_content")).alias("blocks"))
    sizes = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    rows = exploded(hosted, F.array_distinct("blocks"), "block", ("host",))
    counts = rows.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") > 1)
    found = counts.join(sizes, "host").where(F.col("n_pages") >= share * F.col("pages"))
    return found.select("host", "block", "n_pages")


def without_templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """`pages` with `main_text`, the blocks that are no template's joined by line ends, and `n_dropped`; one row per url."""
    templates = template_blocks(pages, share, min_pages).select(F.col("host").alias("_host"), F.col("block").alias("_block"))
    blocks = pages.select("url", host_of(F.col("url")).alias("_host"), blocks_of(F.col("main_content")).alias("blocks"))
    rows = exploded(blocks, "blocks", "_block", ("url", "_host"), "_at")
    # The positions of one page are at most its own blocks.
    dropped = rows.join(templates, ["_host", "_block"]).groupBy("url").agg(F.collect_set("_at").alias("_dropped"))
    whole = pages.join(dropped, "url", "left").withColumn("_dropped", F.coalesce("_dropped", F.array().cast("array<int>")))
    kept = F.filter(
        F.transform(blocks_of(F.col("main_content")), lambda block, i: F.when(~F.array_contains("_dropped", i), block)), lambda b: b.isNotNull()
    )
    text = F.when(F.col("main_content").isNotNull(), F.array_join(kept, "\n"))
    return whole.withColumn("main_text", text).withColumn("n_dropped", F.size("_dropped")).drop("_dropped")
