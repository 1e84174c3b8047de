"""Pages, layout blocks, outlines and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.notation import BLANK, strip
from lectern.llm.store import broadcast_if_small, written
from lectern.operators.text import clean_pages


def page_range(pages: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Pages of a 0-based half-open range, clamped to those there are; None means all."""
    at = F.col("page_number") - 1
    return pages if start is None or end is None else pages.where((at >= max(0, start)) & (at < end))


def supported(pages: DataFrame) -> DataFrame:
    """(doc) of documents with text on some page."""
    return pages.groupBy("doc").agg(F.max((strip(F.col("text")) != "").cast("int")).alias("some")).where("some = 1").select("doc")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary pages of documents that they support, else fallback pages; the support test is one aggregate, joined twice."""
    good = supported(primary)
    return primary.join(good, "doc", "left_semi").unionByName(fallback.join(good, "doc", "left_anti"))


def confidence(words: DataFrame) -> DataFrame:
    """(doc, page, n_words, confidence, text) from OCR words: structural (-1) and blank words don't count; 0 where none do."""
    counts = (strip(F.col("text")) != "") & (F.col("conf") >= 0)
    pieces = F.array_sort(F.collect_list(F.when(counts, F.struct("word_no", "text"))))
    return words.groupBy("doc", "page").agg(
        F.count(F.when(counts, 1)).alias("n_words"),
        F.coalesce(F.avg(F.when(counts, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"),
        F.array_join(F.transform(pieces, lambda s: s.text), " ").alias("text"),
    )


def confidence_of_pages(pages: DataFrame) -> DataFrame:
    """confidence() of (doc, page, words): a row has all or some words of a page, array<struct<word_no, text, conf>> in order.

    A page of one row is done within it, so that no word is shuffled; the words of pages that have several rows are put together by
    confidence(). Only keys are counted over all rows. Rows without words don't count, as they have none in confidence() either.
    """
    several = pages.groupBy("doc", "page").count().where("count > 1").select(F.col("doc").alias("d"), F.col("page").alias("p"))
    several = broadcast_if_small(written(several, "pages-of-several-rows"))
    here = F.col("doc").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p"))
    counts = F.filter("words", lambda w: w.text.rlike(rf"(?U)(?!{BLANK})(?s:.)") & (w.conf >= 0))
    whole = pages.where(F.size("words") > 0).join(several, here, "left_anti").select("doc", "page", counts.alias("own"))
    n, total = F.size("own").cast("long"), F.aggregate("own", F.lit(0.0), lambda s, w: s + w.conf)
    whole = whole.select("doc", "page", n.alias("n_words"), F.coalesce(total / F.nullif(n, F.lit(0)) / 100, F.lit(0.0)).alias("confidence"), F.array_join(F.transform("own", lambda w: w.text), " ").alias("text"))
    return whole.unionByName(confidence(pages.join(several, here, "left_semi").select("doc", "page", F.inline("words"))))


def cascade(offers: DataFrame, least: float = 0.85) -> DataFrame:
    """Of (doc, page, tier, n_words, confidence) the first tier that has words and confidence enough, else the last tier."""
    good = (F.col("n_words") > 0) & (F.col("confidence") >= least)
    order = Window.partitionBy("doc", "page").orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col("tier")).otherwise(-F.col("tier")))
    return offers.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def body_sizes(spans: DataFrame) -> DataFrame:
    """(doc, body): the rounded font size with most characters in spans that aren't blank, the one seen first among equals."""
    sized = spans.where(strip(F.col("text")) != "").groupBy("doc", F.bround("size", 1).alias("body")).agg(F.sum(F.length("text")).alias("n"), F.min("position").alias("first"))
    return sized.groupBy("doc").agg(F.max_by("body", F.struct("n", (-F.col("first")).alias("first"))).alias("body"))


def layout_blocks(spans: DataFrame) -> DataFrame:
    """(doc, page, block, text, role): blocks of spans (doc, page, block, line, position, text, size, y0, page_height).

    role is body, heading (1.35 times the body size or more), small (0.85 times or less), header (first on its page, high up,
    short and no heading) or empty; narration keeps body and heading. Blank spans have no size and no part in a header's length; a
    page without height has no header. A block's y0 is that of its highest span, blank ones included.
    """
    said = strip(F.col("text")) != ""
    spans = spans.withColumn("size", F.when(said, F.col("size"))).withColumn("words", F.when(said, F.col("text")))
    lines = spans.groupBy("doc", "page", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s.text), "").alias("text"), _in_order("position", "words").alias("words"), F.max("size").alias("size"), F.min("y0").alias("y0"), F.max("page_height").alias("height"))
    blocks = lines.groupBy("doc", "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s.text), "\n").alias("text"), _in_order("line", "words").alias("words"), F.max("size").alias("size"), F.min("y0").alias("y0"), F.max("height").alias("height"))
    order = Window.partitionBy("doc", "page").orderBy("block")
    sized = blocks.withColumn("at", F.row_number().over(order) - 1).join(body_sizes(spans.where(F.col("size").isNotNull())), "doc", "left").withColumn("body", F.coalesce("body", F.lit(0.0)))
    heading, small = (F.col("body") > 0) & (F.col("size") >= 1.35 * F.col("body")), (F.col("body") > 0) & (F.col("size") <= 0.85 * F.col("body"))
    header = (F.col("at") == 0) & ~heading & (F.col("height") > 0) & (F.col("y0") <= 0.1 * F.col("height")) & (F.length(strip(F.col("words"))) <= 80)
    role = F.when(F.col("size").isNull(), "empty").when(header, "header").when(small, "small").when(heading, "heading").otherwise("body")
    return sized.select("doc", "page", "block", "text", role.alias("role"))


def _in_order(order: str, text: str) -> Column:
    """The texts of a group joined by blanks, without nulls."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")


def narratable_pages(blocks: DataFrame) -> DataFrame:
    """(doc, page, text): the body and heading blocks of each page, an empty line between; a page without them has an empty text."""
    kept = F.when(F.col("role").isin("body", "heading"), F.struct("block", strip(F.col("text")).alias("text")))
    whole = F.array_sort(F.collect_list(kept))
    return blocks.groupBy("doc", "page").agg(F.array_join(F.filter(F.transform(whole, lambda s: s.text), lambda t: t != ""), "\n\n").alias("text"))


#: Pages of a cell of the grid by which pages and chapters are joined.
GRID = 64


def descriptive(title: Column) -> Column:
    return ~strip(title).rlike(r"(?iU)^[\dIVXLCDM]+[.)]?$") & (strip(title) != "")


def level_statistics(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, level, n_pages, widest): distinct start pages of a level and its widest gap as a share of the document."""
    starts = toc.join(totals, "doc").select("doc", "level", "total", F.greatest(F.lit(1), F.least("page", "total")).alias("start")).distinct()
    after = F.coalesce(F.lead("start").over(Window.partitionBy("doc", "level").orderBy("start")), F.col("total") + 1)
    return starts.withColumn("gap", after - F.col("start")).groupBy("doc", "level").agg(F.count("*").alias("n_pages"), (F.max("gap") / F.max("total")).alias("widest"))


def chosen_levels(toc: DataFrame, totals: DataFrame, share: float = 0.25) -> DataFrame:
    """(doc, level): the shallowest level without a gap over share of the document, else that of the smallest gap."""
    good = F.col("widest") <= share
    rank = F.struct(F.when(good, 0).otherwise(1).alias("a"), F.when(good, F.lit(0.0)).otherwise(F.col("widest")).alias("b"), F.col("level").alias("c"))
    return level_statistics(toc, totals).groupBy("doc").agg(F.min_by("level", rank).alias("level"))


def chapters(toc: DataFrame, totals: DataFrame, block: int = 10, share: float = 0.25) -> DataFrame:
    """(doc, chapter, title, start_page, end_page): intervals that tile the pages 1..total of each document.

    Starts are the chosen level's pages, the first moved to page 1; a page's title is its first descriptive one of any level, else
    its first. Without an outline, and for intervals longer than max(block, share of the pages), there are numbered parts.
    """
    level = chosen_levels(toc, totals, share)
    placed = toc.join(totals, "doc").join(level.withColumnRenamed("level", "chosen"), "doc").withColumn("start", F.greatest(F.lit(1), F.least("page", "total")))
    rank = F.struct(F.when(descriptive(F.col("title")), 0).otherwise(1).alias("a"), F.col("entry_no").alias("b"))
    starts = placed.groupBy("doc", "start").agg(F.min_by("title", rank).alias("title"), F.max("total").alias("total"), F.max((F.col("level") == F.col("chosen")).cast("int")).alias("own")).where("own = 1")
    order = Window.partitionBy("doc").orderBy("start")
    number = F.row_number().over(order)
    closed = starts.select("doc", F.coalesce(F.when(strip(F.col("title")) != "", strip(F.col("title"))), F.concat(F.lit("Capítulo "), number)).alias("title"), F.when(number == 1, 1).otherwise(F.col("start")).alias("start"), (F.coalesce(F.lead("start").over(order), F.col("total") + 1) - 1).alias("end"), "total")
    bare = totals.where("total > 0").join(level, "doc", "left_anti")
    parts = bare.select("doc", F.posexplode(F.sequence(F.lit(1), F.col("total"), F.lit(block))).alias("k", "start"), "total")
    parts = parts.select("doc", F.concat(F.lit("Parte "), F.col("k") + 1).alias("title"), "start", F.least(F.col("start") + block - 1, "total").alias("end"), "total")
    longest = F.greatest(F.lit(block), F.floor(F.col("total") * share)).cast("int")
    long = F.col("end") - F.col("start") + 1 > longest
    cuts = F.sequence(F.col("start"), F.col("end"), F.when(long, longest).otherwise(F.greatest(F.col("end") - F.col("start") + 1, F.lit(1))))
    cut = closed.unionByName(parts).where("end >= start").select("doc", "title", "start", "end", long.alias("long"), longest.alias("longest"), F.posexplode(cuts).alias("part", "from"))
    title = F.when(F.col("long"), F.concat("title", F.lit(" (parte "), F.col("part") + 1, F.lit(")"))).otherwise(F.col("title"))
    until = F.when(F.col("long"), F.least(F.col("from") + F.col("longest") - 1, "end")).otherwise(F.col("end"))
    return cut.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("from")).alias("chapter"), title.alias("title"), F.col("from").alias("start_page"), until.alias("end_page"))


def chapter_texts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, chapter, title, text): each chapter's pages cleaned as one text, so that lines repeat, break and wrap within a chapter only."""
    own = pages_of_chapters(pages, found).select(F.struct("doc", "chapter", "title").alias("unit"), F.col("page_number").alias("page"), "text")
    return clean_pages(own).select("unit.*", "text")


def pages_of_chapters(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the chapters whose interval holds them: an equi-join on the document and a grid of GRID pages, the interval being its condition.

    A chapter has a row for each cell that it covers, so a page meets the chapters of its cell and not all of its document.
    """
    cell = lambda page: F.floor(F.col(page) / GRID)
    c = found.where("start_page <= end_page").select(F.col("doc").alias("c_doc"), "chapter", "title", "start_page", "end_page", F.explode(F.sequence(cell("start_page"), cell("end_page"))).alias("c_cell"))
    on = (F.col("doc") == F.col("c_doc")) & (cell("page_number") == F.col("c_cell")) & F.col("page_number").between(F.col("start_page"), F.col("end_page"))
    return pages.join(c, on).drop("c_doc", "c_cell")
