"""Headings: scores, thresholds, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .layout import body_fonts_by_counts, is_footer, left_margins, repeated_texts, with_measures, with_spacing
from .scans import PAGES, page_range, running

LOW, NUMBERED, PLAIN = 0.35, 0.45, 0.55


def score() -> Column:
    """X24, over columns of lines with spacing, body_font_size and left_margin. Terms are added as doubles in this order."""
    text = F.trim("text")
    n_words, n, size, body = X.word_count(text), F.length(text), F.col("font_size"), F.col("body_font_size")
    numbered = text.rlike(X.NUMBERED)
    when = lambda c, v: F.when(c, float(v)).otherwise(0.0)
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    terms = [
        when(X.is_heading_form(text), 0.22), when(numbered, 0.18), when(text.rlike(X.KEYWORD), 0.18),
        F.when(size >= body + 1.5, 0.18).when(size >= body + 0.6, 0.08).otherwise(0.0), when(F.col("is_bold"), 0.12),
        F.when(text.rlike(X.UPPERCASE) & (n >= 6), 0.12).when(X.is_title_case(text), 0.07).otherwise(0.0),
        F.when((n_words <= 12) & (n <= 100), 0.12).when((n_words <= 18) & (n <= 140), 0.05).otherwise(-0.12),
        when((F.abs(F.col("x0") - F.col("left_margin")) <= 12) | (F.col("x0") <= F.col("left_margin") + 24), 0.08),
        when(F.col("spacing_before") >= height * 0.85, 0.06), when(F.col("spacing_after") >= height * 0.35, 0.04),
        when(F.col("y0").between(35, F.col("page_height") - 72), 0.03),
        F.when((size >= body + 2.5) & F.col("is_bold"), 0.07).when((size >= body + 1.2) | F.col("is_bold"), 0.03).otherwise(0.0),
        when(text.endswith(".") & (n_words > 8) & ~numbered, -0.08), when(F.substring(text, 1, 1).isin("-", "•", "*"), -0.10),
        when(X.looks_like_sentence(text) & ~numbered, -0.08),
    ]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    reject = (n < 3) | (n_words == 0) | text.rlike(X.URL_OR_EMAIL) | text.rlike(X.FIGURE_OR_TABLE)
    return F.when(reject, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(total, F.lit(1.0))))


def scored(lines: DataFrame) -> DataFrame:
    """lines (with spacing) with body_font_size, left_margin, score; lines that are dealt by document need no exchange."""
    return with_measures(lines).withColumn("score", score())


def clamp_levels(rows: DataFrame, level: str, by: list[str], order: list[str], first: int | None = 1) -> DataFrame:
    """No level more than one below the one before; in closed form, i + min(l_j - j) over the rows so far. first: what the first level is forced to."""
    w = W.partitionBy(*by).orderBy(*order)
    i = F.row_number().over(w)
    start = F.col(level) if first is None else F.when(i == 1, F.lit(first)).otherwise(F.col(level))
    rows = rows.withColumn("_i", i).withColumn("_l", start)
    return rows.withColumn(level, (F.col("_i") + F.min(F.col("_l") - F.col("_i")).over(w.rowsBetween(W.unboundedPreceding, 0))).cast("int")).drop("_i", "_l")


def clamp_levels_in_ranges(rows: DataFrame, level: str, by: list[str], order: list[str], cut: Column, first: int | None = 1) -> DataFrame:
    """W3 for groups of any size: the same levels as clamp_levels gives, by two running values over ranges (scans.running)."""
    rows = running(rows, by, order, cut, {"_i": ("sum", F.lit(1).cast("long"))})
    start = F.col(level) if first is None else F.when(F.col("_i") == 1, F.lit(first)).otherwise(F.col(level))
    rows = running(rows, by, order, cut, {"_least": ("min", start - F.col("_i"))})
    return rows.withColumn(level, (F.col("_i") + F.col("_least")).cast("int")).drop("_i", "_least")


def detect_headings_in_ranges(lines: DataFrame, share: float = 0.3, pages: int = PAGES) -> DataFrame:
    """C1 for documents of any size: the rows of detect_headings over lines without boilerplate and with spacing, no document in one task.

    Texts on many pages, the body's size, the margin, styles and their ranks come from counts, which partial aggregates make; windows hold a
    page, or a range of pages whose levels go on from the range before. What lines need to know of their document and page comes to them in one
    join by page, by which the windows are dealt, too, so texts of lines that score low are dealt once. It costs more scans than detect_headings, so that is for usual documents.
    """
    y0, h = F.col("y0"), F.col("page_height")
    again = repeated_texts(lines, share).select("doc_id", "normalized_text")
    edge = (y0 <= F.greatest(F.lit(120.0), h * 0.12)) | is_footer(y0, h)
    own = ~F.trim("text").rlike(X.PAGE_NUMBER) & ~F.col("text").rlike(X.COPYRIGHT)
    page = ["doc_id", "page_number"]
    gone = lines.where(own & edge).select(*page, "normalized_text", "line_order").join(again, ["doc_id", "normalized_text"])
    gone = gone.groupBy(*page).agg(F.collect_set("line_order").alias("_gone"))
    left = F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("line_order"))
    narrow = lines.where(own).select(*page, "line_order", "x0", "y0", "font_size", "is_bold", F.length("text").alias("_length"))
    narrow = narrow.join(gone, page, "left").where(left).drop("_gone")
    of_document = body_fonts_by_counts(narrow, F.col("_length")).join(left_margins(narrow, F.col("_length")), "doc_id")
    of_page = narrow.select(*page).distinct().join(of_document, "doc_id").join(gone, page, "left")
    rows = with_spacing(lines.where(own).join(of_page, page).where(left).drop("_gone"))
    rows = rows.withColumn("score", score()).where(F.col("score") >= LOW)
    style = {"_s": F.bround(F.col("font_size") * 2) / 2, "_b": F.col("is_bold"), "_x": F.floor(F.col("x0") / 10) * 10}
    rows = rows.withColumns(style)
    rows = rows.join(rows.groupBy("doc_id", *style).agg((F.count("*") >= 2).alias("_often")), ["doc_id", *style])
    rows = rows.withColumn("confidence", F.least(F.lit(0.99), F.col("score") + F.when(F.col("_often"), 0.08).otherwise(0.0))).drop(*style, "_often")
    numbered = F.trim("text").rlike(X.NUMBERED)
    rows = rows.where(F.col("confidence") >= F.when(numbered, NUMBERED).otherwise(PLAIN)).withColumn("title", X.clean_title(F.col("text")))
    order = ["page_number", "y0", "x0", "line_order"]
    kept = ["line_order", "title", "confidence", "font_size", "is_bold", "x0", "y0"]
    first = F.min_by(F.struct(*kept), F.struct("y0", "x0", "line_order"))
    rows = rows.groupBy("doc_id", "normalized_text", "page_number").agg(first.alias("r")).select("doc_id", "page_number", "r.*")
    rows = rows.withColumns({"_numbered": F.col("title").rlike(X.NUMBERED), "_size": F.bround("font_size", 1)})
    rank = F.dense_rank().over(W.partitionBy("doc_id", "_numbered").orderBy(F.col("_size").desc(), F.col("is_bold").desc()))
    styles = rows.select("doc_id", "_numbered", "_size", "is_bold").distinct().withColumn("_rank", rank)
    rows = rows.join(styles, ["doc_id", "_numbered", "_size", "is_bold"])
    depth = F.size(F.split(F.regexp_extract("title", X.NUMBERED, 1), r"\."))
    level = F.when(F.col("_numbered"), F.least(F.lit(6), depth)).when(F.col("title").rlike(X.KEYWORD), 1).otherwise(F.least(F.lit(6), F.col("_rank")))
    rows = clamp_levels_in_ranges(rows.withColumn("level", level.cast("int")), "level", ["doc_id"], order, page_range("page_number", pages))
    return rows.select("doc_id", "page_number", "line_order", "title", "level", "confidence", "font_size", "is_bold", "x0", "y0")


def detect_headings(lines: DataFrame) -> DataFrame:
    """Score, style bonus, thresholds, first of equal titles on a page, level, clamp."""
    rows = scored(lines).where(F.col("score") >= LOW)
    style = [F.bround(F.col("font_size") * 2) / 2, F.col("is_bold"), F.floor(F.col("x0") / 10) * 10]
    again = F.count("*").over(W.partitionBy("doc_id", *style)) >= 2
    rows = rows.withColumn("confidence", F.least(F.lit(0.99), F.col("score") + F.when(again, 0.08).otherwise(0.0)))
    numbered = F.trim("text").rlike(X.NUMBERED)
    rows = rows.where(F.col("confidence") >= F.when(numbered, NUMBERED).otherwise(PLAIN)).withColumn("title", X.clean_title(F.col("text")))
    order = ["page_number", "y0", "x0", "line_order"]
    once = W.partitionBy("doc_id", "normalized_text", "page_number").orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    title_numbered = F.col("title").rlike(X.NUMBERED)
    size = F.bround("font_size", 1)
    rank = F.dense_rank().over(W.partitionBy("doc_id", title_numbered).orderBy(size.desc(), F.col("is_bold").desc()))
    depth = F.size(F.split(F.regexp_extract("title", X.NUMBERED, 1), r"\."))
    level = F.when(title_numbered, F.least(F.lit(6), depth)).when(F.col("title").rlike(X.KEYWORD), 1).otherwise(F.least(F.lit(6), rank))
    rows = clamp_levels(rows.withColumn("level", level.cast("int")), "level", ["doc_id"], order)
    return rows.select("doc_id", "page_number", "line_order", "title", "level", "confidence", "font_size", "is_bold", "x0", "y0")


def heading_stats(headings: DataFrame) -> DataFrame:
    """Number, distinct pages, and the first 25 pages with just one heading."""
    pages = headings.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    single = F.slice(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("page_number")))), 1, 25)
    return pages.groupBy("doc_id").agg(F.sum("n").alias("n_headings"), F.count("*").alias("n_pages"), F.array_join(single.cast("array<string>"), ", ").alias("single_pages"))


def contents_entries(headings: DataFrame) -> DataFrame:
    """what a listing of contents shows of headings."""
    return headings.select("doc_id", "title", "level", F.col("page_number").alias("page"), "confidence")
