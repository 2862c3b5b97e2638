"""Rows of contents pages: lines put together to entries with their place on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.layout import needs_ocr
from .layout import visual_lines
from .pages import HEIGHT, PAGE, columns, is_contents_header, is_linkable, is_local_header, reference_labels, row_rects, word_lines

WIDTH = 612.0
ORDER = ["y0", "y1", "x0", "block_number", "line_number"]
RECT = ["rect_x0", "rect_y0", "rect_x1", "rect_y1"]


def _numbered(lines: DataFrame, start: Column) -> DataFrame:
    """Lines with starts and row_number: which row of its page a line belongs to; lines before the first row are left out."""
    upto = W.partitionBy(*PAGE).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("starts", start)
    return lines.withColumn("row_number", F.sum(F.col("starts").cast("int")).over(upto)).where("row_number > 0")


def _of_start(column: str) -> Column:
    return F.max(F.when(F.col("starts"), F.col(column))).alias(column)


def _appended(column: str, when: Column) -> Column:
    """The texts of a row's lines for which when holds, in order, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.when(when & (F.col(column) != ""), F.struct(*ORDER, column))))
    return F.array_join(F.transform(parts, lambda p: p[column]), " ").alias(column)


def _rect(used: Column, left: float, width: float) -> list[Column]:
    """The least rectangle about the lines used, two above and three below, from left to 54 before the page's edge."""
    top = F.min(F.when(used, F.greatest(F.lit(0.0), F.col("y0") - 2)))
    return [F.lit(left).alias("rect_x0"), top.alias("rect_y0"), F.lit(width - 54).alias("rect_x1"), F.max(F.when(used, F.col("y1") + 3)).alias("rect_y1")]


def contents_rows(lines: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Entries of the document's contents. lines: PAGE, ORDER, chapter, description, reference (of pages.columns).

    Lines above 80 and below 45 from the end, heads and feet play no part. A line with a description, or with a chapter and a reference, starts
    an entry; one with a reference alone adds it. Entries whose title is no title are left out. An entry has title, chapter, reference_text,
    row_number on its page and its rectangle.
    """
    has = lambda c: F.col(c) != ""
    own = lines.withColumns({c: F.coalesce(c, F.lit("")) for c in ("chapter", "description", "reference")})
    whole = F.trim(F.array_join(F.filter(F.array("chapter", "description", "reference"), lambda x: x != ""), " "))
    own = own.where(F.col("y0").between(80, height - 45)).withColumn("whole", whole).where(has("whole") & ~is_contents_header(F.col("whole")))
    title = F.trim(F.array_join(F.filter(F.array("chapter", "description"), lambda x: x != ""), " "))
    own = own.withColumn("title", F.when(title != "", title).otherwise(F.col("whole")))
    own = _numbered(own, has("description") | (has("chapter") & has("reference")))
    used = F.col("starts") | has("reference")
    rows = own.groupBy(*PAGE, "row_number").agg(_of_start("title"), _of_start("chapter"), _appended("reference", used), *_rect(used, 96.0, width))
    return rows.where(is_linkable(F.col("title"))).withColumnRenamed("reference", "reference_text")


def local_rows(lines: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Entries of a chapter's contents. lines: of pages.word_lines.

    A line whose first word, at 170 or left of it, is an item's label starts an entry; others that begin right of 110 and are no head or foot add
    their text to its title. An entry has label, title, level, row_number and its rectangle.
    """
    own = lines.where(F.col("y0").between(90, height - 45) & (F.size("words") > 0)).withColumn("label", X.normalize_label(F.trim(F.col("words")[0]["text"])))
    rest = F.trim(F.array_join(F.transform(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w: w["text"]), " "))
    own = _numbered(own, (F.col("words")[0]["x0"] <= 170) & X.is_item_label(F.col("label")))
    used = F.col("starts") | ((F.col("words")[0]["x0"] > 110) & (F.col("text") != "") & ~is_local_header(F.col("text")))
    own = own.withColumn("title", F.when(F.col("starts"), F.trim(F.concat_ws(" ", F.col("label"), F.nullif(rest, F.lit(""))))).otherwise(F.col("text")))
    rows = own.groupBy(*PAGE, "row_number").agg(_of_start("label"), _appended("title", used), *_rect(used, 68.0, width))
    return rows.where(is_linkable(F.col("title"))).withColumn("level", X.local_row_level(F.col("label")))


def extracted(words: DataFrame, global_pages: DataFrame, local_pages: DataFrame) -> DataFrame:
    """H2: entries of both kinds of contents pages (PAGE): toc_type global or local, title, level, chapter, reference_text, label."""
    lines = word_lines(words)
    a = contents_rows(columns(lines.join(global_pages.select(*PAGE).distinct(), PAGE, "left_semi")))
    b = local_rows(lines.join(local_pages.select(*PAGE).distinct(), PAGE, "left_semi"))
    a = a.withColumns({"toc_type": F.lit("global"), "level": F.lit(1), "label": F.lit(None).cast("string")})
    b = b.withColumns({"toc_type": F.lit("local"), "chapter": F.lit(None).cast("string"), "reference_text": F.col("label")})
    kept = [*PAGE, "toc_type", "row_number", "title", "level", "chapter", "reference_text", "label", *RECT]
    return a.select(*kept).unionByName(b.select(*kept))


def _reference_rows(words: DataFrame, title: str, width: float, height: float) -> DataFrame:
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_number", "line_number", "word_number"))
    own = words.where(F.trim("text") != "").withColumn("word_number", number)
    of = visual_lines(own.select(*PAGE, "word_number", "text", "x0", "y0", "y1")).select(*PAGE, "word_number", "visual_line")
    one = F.array_sort(F.collect_list(F.struct("x0", "word_number", "text", "y0", "x1", "y1")))
    lines = own.join(of, [*PAGE, "word_number"]).groupBy(*PAGE, F.col("visual_line").alias("target")).agg(F.min("y0").alias("y0"), one.alias("words"))
    found = reference_labels(lines.where(F.col("y0").between(90, height - 45)))
    rects = row_rects(found, own, width, height).select(*PAGE, "target", *[F.col(c).alias(f"rect_{c}") for c in ("x0", "y0", "x1", "y1")])
    same = W.partitionBy(*PAGE, "label", *[F.bround(c) for c in RECT]).orderBy("target")
    rows = found.select(*PAGE, "target", "label").join(rects, [*PAGE, "target"]).withColumn("n", F.row_number().over(same)).where("n = 1")
    row_number = F.row_number().over(W.partitionBy(*PAGE).orderBy("target"))
    return rows.select(*PAGE, F.lit("reference").alias("toc_type"), row_number.alias("row_number"), F.concat(F.lit(title), "label").alias("title"), F.lit(1).alias("level"), F.col("label").alias("reference_text"), "label", *RECT)


def reference_rows(words: DataFrame, reference_pages: DataFrame, ocr_words: DataFrame | None = None, coverage: DataFrame | None = None, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """H2: items that reference pages (PAGE) name, a row for each visual line, of equal labels and rounded rectangles one.

    A page whose words give no row takes its words read from images (ocr_words, as words), if by its words and coverage (PAGE, coverage) it needs to.
    """
    pages = reference_pages.select(*PAGE).distinct()
    rows = _reference_rows(words.join(pages, PAGE, "left_semi"), "EICAS reference ", width, height)
    if ocr_words is None or coverage is None:
        return rows
    sizes = words.where(F.trim("text") != "").groupBy(*PAGE).agg(F.count("*").alias("n"))
    poor = pages.join(coverage.select(*PAGE, "coverage"), PAGE).join(sizes, PAGE, "left").where(needs_ocr(F.coalesce("n", F.lit(0)), F.col("coverage")))
    poor = poor.select(*PAGE).distinct().join(rows, PAGE, "left_anti")
    return rows.unionByName(_reference_rows(ocr_words.join(poor, PAGE, "left_semi"), "EICAS OCR reference ", width, height))
