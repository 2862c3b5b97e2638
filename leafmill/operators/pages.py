"""Pages by what stands on them: regions, contents pages, reference pages, lists of effective pages; labels on them and their lines.

Words have doc_id, page_number, block_number, line_number, word_number, text, x0, y0, x1, y1. What is collected is a page or a line at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.layout import HEIGHT, WIDTH, needs_ocr
from . import contents

PAGE = ["doc_id", "page_number"]
# The forms of page names, item labels and revisions.
SECTION_ZERO = r"(?i)\bSECTION\s*-\s*0\b"
GLOBAL_PAGE = r"(?i)\bTOC-\d+\b"
LOCAL_PAGE = r"(?i)\bTOC\s+\d{2}-\d+\b"
EM_PAGE = r"(?i)\bEM\s*[-–]\s*(\d+)\b"
ITEM_IN_TEXT = r"\b\d{2}\s*-\s*\d{2}\s*-\s*\d{2}(?:\s*-\s*\d{2}){0,4}[A-Z]?\b"
PAGE_LABEL = r"(?i)^(?:TOC-\d+|LEP-\d+|[A-Z]{2,6}-\d+[A-Z]?|\d{1,3}-\d+[A-Z]?|\d{2}(?:-\d{2}){1,6}[A-Z]?)$"
REVISION_TOKEN = r"(?i)^(?:\d{1,2}[A-Z]?|R\d+[A-Z]?|[A-Z]\d+)$"
HEADER_REVISION = r"(?i)^REV[-\s:]*(\d{1,3}[A-Z]?)?$"
# Words of a table's head, below which a page's body begins.
BODY_WORDS = ("CATEGORY", "ITEM", "DESCRIPTION", "REMARKS")
# Titles at the head or foot of contents pages, and of tables that end the items.
GLOBAL_HEADERS = ("CHAPTER", "DESCRIPTION", "PAGE", "CHAPTER DESCRIPTION PAGE", "DESCRIPTION PAGE", "TABLE OF CONTENTS")
LOCAL_HEADERS = ("BOEING", "MINIMUM EQUIPMENT LIST", "DISPATCH DEVIATION GUIDE", "TABLE OF CONTENTS", "AIR CONDITIONING")
UNLINKED_TITLES = ("CHAPTER DESCRIPTION", "DESCRIPTION PAGE")
REFERENCE_TABLES = ("MEL ITEM", "ASSOCIATED STATUS MESSAGE")


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(words)), lambda w: w["text"]), " ")


def page_texts(words: DataFrame, height: float = HEIGHT) -> DataFrame:
    """per page its text, the texts of its top and bottom regions, n_words, and whether an item label stands at the right (names_item)."""
    place = F.struct("y0", "x0", "word_number", "text")
    top = F.when(F.col("y0") <= min(180.0, 0.28 * height), place)
    bottom = F.when(F.col("y0") >= max(height - 130.0, 0.78 * height), place)
    return words.groupBy(*PAGE).agg(
        _joined(F.struct("block_number", "line_number", "word_number", "text")).alias("text"), _joined(top).alias("top_text"), _joined(bottom).alias("bottom_text"),
        F.count("*").alias("n_words"), F.coalesce(F.bool_or((F.col("x0") >= 330) & X.is_item_label(F.col("text"))), F.lit(False)).alias("names_item"),
    )


def _has(*terms: str) -> Column:
    out = F.lit(True)
    for term in terms:
        out = out & F.upper("text").contains(term)
    return out


def _regions() -> Column:
    return F.concat_ws(" ", "top_text", "bottom_text")


def contents_pages(pages: DataFrame) -> DataFrame:
    """the longest run of pages of the whole document's contents."""
    named = F.col("text").rlike(SECTION_ZERO) | F.col("text").rlike(GLOBAL_PAGE) | _has("CHAPTER", "DESCRIPTION", "PAGE")
    run = contents.longest_run(pages.where(_has("TABLE OF CONTENTS") & ~_has("ATA -") & named), ["doc_id"], "page_number")
    return run.select("doc_id", F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("length") - 1).cast(run.schema["start"].dataType))).alias("page_number"))


def local_contents_pages(pages: DataFrame) -> DataFrame:
    """pages of a chapter's contents."""
    return pages.where(_regions().rlike(LOCAL_PAGE) & X.ata_chapter(F.col("text")).isNotNull()).select(*PAGE)


def reference_pages(pages: DataFrame, coverage: DataFrame) -> DataFrame:
    """Pages of messages that refer to items, and within the range of such pages those that are images (coverage: PAGE, coverage)."""
    found = pages.where(_has("EICAS MESSAGES", "MEL ITEM") & F.col("names_item")).select(*PAGE)
    em, plain = (F.when(x, F.col("page_number")) for x in (_regions().rlike(EM_PAGE), _has("SECTION", "EICAS MESSAGES")))
    span = pages.groupBy("doc_id").agg(F.coalesce(F.min(em), F.min(plain)).alias("lo"), F.coalesce(F.max(em), F.max(plain)).alias("hi")).where("lo is not null")
    images = coverage.join(span, "doc_id").where("page_number between lo and hi").join(pages.select(*PAGE, "n_words"), PAGE, "left")
    return found.unionByName(images.where(needs_ocr(F.coalesce("n_words", F.lit(0)), F.col("coverage"))).select(*PAGE)).distinct()


def coverage_of(words: DataFrame) -> DataFrame:
    """Pages' coverage by images (PAGE, coverage) where none is known: no rows."""
    return words.select(*PAGE, F.lit(0.0).alias("coverage")).where(F.lit(False))


def effective_pages(pages: DataFrame, report: bool = False) -> DataFrame:
    """lists of effective pages, as revisions look for them or (report) as the report on them does."""
    loose = _has("REV") | _has("DATE") if report else _has("PAGE", "REV")
    return pages.where(_has("LIST OF EFFECTIVE PAGES") | (_has("EFFECTIVE PAGES") & loose)).select(*PAGE)


def blank_effective_pages(pages: DataFrame) -> DataFrame:
    """F12."""
    return pages.join(effective_pages(pages), PAGE, "left_semi").where(_has("INTENTIONALLY LEFT BLANK")).select(*PAGE)


def is_contents_header(text: Column) -> Column:
    """F13 on the document's contents pages."""
    return X.bound(X.normalize_title(text), lambda t: t.isin(*GLOBAL_HEADERS) | t.rlike(r"^TOC\s*\d+$"))


def is_local_header(text: Column) -> Column:
    """F13 on a chapter's contents pages."""
    return X.bound(X.normalize_title(text), lambda t: t.isin(*LOCAL_HEADERS) | t.rlike(r"^(?:AI ENGG|ATA|ISSUE|REV)") | t.rlike(r"^TOC\s+\d+\s+\d+$"))


def is_linkable(title: Column) -> Column:
    """F14."""
    return X.bound(X.normalize_title(title), lambda t: (t != "") & ~t.isin(*UNLINKED_TITLES))


def word_lines(words: DataFrame) -> DataFrame:
    """S4 with the words kept: per line x0, y0, y1, words (array in order of x) and text."""
    one = F.array_sort(F.collect_list(F.struct("x0", "word_number", "text", "y0", "x1", "y1")))
    lines = words.where(F.trim("text") != "").groupBy(*PAGE, "block_number", "line_number").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), one.alias("words"))
    return lines.withColumn("text", words_text(F.col("words")))


def words_text(words: Column) -> Column:
    return X.normalize_text(F.array_join(F.transform(words, lambda w: w["text"]), " "))


def columns(lines: DataFrame) -> DataFrame:
    """F16: a contents line's words by place: chapter (x below 180), description (below 390), reference."""
    between = lambda lo, hi: words_text(F.filter("words", lambda w: (w["x0"] >= lo) & (w["x0"] < hi)))
    return lines.withColumns({"chapter": between(float("-inf"), 180), "description": between(180, 390), "reference": between(390, float("inf"))})


def page_labels(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Label and the first page that bears it at its top or bottom, but for excluded pages and lists of effective pages."""
    rows = pages.join(excluded, PAGE, "left_anti").where(~_has("LIST OF EFFECTIVE PAGES"))
    return rows.select("doc_id", F.explode(X.reference_labels(_regions())).alias("label"), "page_number").groupBy("doc_id", "label").agg(F.min("page_number").alias("page_number"))


def item_labels(lines: DataFrame, pages: DataFrame, excluded: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Per item label the first page and y (24 above its line); a label may begin at the end of the line before."""
    named = pages.join(excluded, PAGE, "left_anti").where(~_has("LIST OF EFFECTIVE PAGES")).select(*PAGE, X.ata_chapter(F.col("text")).alias("chapter")).where("chapter is not null")
    rows = lines.join(named, PAGE)
    order = W.partitionBy(*PAGE).orderBy("y0", "y1", "x0", "block_number", "line_number")
    table = F.min(F.when(X.normalize_title(F.col("text")).isin(*REFERENCE_TABLES), F.col("y0"))).over(W.partitionBy(*PAGE))
    rows = rows.withColumns({"before": F.lag("text").over(order), "table_y": table, "first": X.normalize_label(F.col("words")[0]["text"])})
    split = F.concat("chapter", F.lit("-"), "first")
    ended = F.regexp_extract("before", r"\b(\d{2})\s*-\s*$", 1) == F.col("chapter")
    label = F.when(X.is_item_label(F.col("first")) & F.col("first").startswith(F.concat("chapter", F.lit("-"))), F.col("first")).when(ended & X.is_item_label(split), split)
    inside = (F.col("y0") >= 90) & (F.col("y0") <= height - 45) & (F.col("x0") <= 170) & (F.col("table_y").isNull() | (F.col("y0") <= F.col("table_y")))
    rows = rows.where(inside).select("doc_id", label.alias("label"), "page_number", "y0", "y1", "x0").where("label is not null")
    return contents.first_wins(rows, ["doc_id", "label"], ["page_number", "y0", "y1", "x0"]).select("doc_id", "label", "page_number", F.greatest(F.lit(0.0), F.col("y0") - 24).alias("y"))


def reference_labels(lines: DataFrame) -> DataFrame:
    """The item that a line's right part (x from 300) names, as a word or over several, and the word it is anchored to."""
    rows = lines.withColumn("right", F.filter("words", lambda w: w["x0"] >= 300)).where(F.size("right") > 0)
    rows = rows.withColumn("word", F.get(F.filter("right", lambda w: X.is_item_label(w["text"])), F.lit(0)))
    found = F.nullif(F.regexp_extract(X.normalize_reference(words_text(F.col("right"))), ITEM_IN_TEXT, 0), F.lit(""))
    anchor = F.coalesce(F.get(F.filter("right", lambda w: w["text"].rlike(r"\d")), F.lit(0)), F.get("right", F.lit(0)))
    rows = rows.withColumns({"label": F.coalesce(X.normalize_label(F.col("word")["text"]), X.normalize_label(F.regexp_replace(found, " ", ""))), "anchor": F.coalesce("word", anchor)})
    return rows.where("label is not null").drop("right", "word")


def row_rects(targets: DataFrame, words: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """The rectangle of the row that each target (PAGE, target, anchor with x0, y0, y1) stands in, from the words within 3 points of it or across it."""
    a, b = targets.select(*PAGE, "target", F.col("anchor.x0").alias("_x"), F.col("anchor.y0").alias("_y0"), F.col("anchor.y1").alias("_y1")), words.select(*PAGE, "x0", "y0", "x1", "y1")
    level = (F.abs(F.col("y0") - F.col("_y0")) <= 3) | (F.abs(F.col("y1") - F.col("_y1")) <= 3) | ((F.col("y0") <= F.col("_y1")) & (F.col("y1") >= F.col("_y0")))
    rows = a.join(b, PAGE).where(level).groupBy(*PAGE, "target").agg(
        F.coalesce(F.min(F.when(F.col("x0") >= 45, F.col("x0"))), F.min("_x")).alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return rows.select(*PAGE, "target", F.greatest(F.lit(0.0), F.col("x0") - 4).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - 2).alias("y0"), F.least(F.lit(width), F.col("x1") + 6).alias("x1"), F.least(F.lit(height), F.col("y1") + 3).alias("y1"))


def effective_entries(words: DataFrame) -> DataFrame:
    """Entries of lists of effective pages: a label (a word, or TOC and a word) opens a segment of its line; its rightmost revision token is the revision, the words before that the date.

    Segments without a revision token are left out.
    """
    line = [*PAGE, "block_number", "line_number"]
    order = W.partitionBy(*line).orderBy("x0", "word_number")
    rows = words.withColumns({"text": F.trim("text"), "_toc": F.upper(F.trim("text")) == "TOC", "_label": F.trim("text").rlike(PAGE_LABEL)})
    rows = rows.withColumns({"_opens": F.col("_toc") & F.coalesce(F.lead("_label").over(order), F.lit(False)), "_second": F.col("_label") & F.coalesce(F.lag("_toc").over(order), F.lit(False)), "pos": F.row_number().over(order)})
    rows = rows.withColumn("_start", F.col("_opens") | (F.col("_label") & ~F.col("_second")))
    rows = rows.withColumn("segment", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("segment > 0")
    value = ~(F.col("_opens") | F.col("_label"))
    named = F.when(F.col("_label"), F.concat(F.when(F.col("_second"), "TOC ").otherwise(""), "text"))
    sums = rows.groupBy(*line, "segment").agg(
        F.max(named).alias("label"), F.max(F.when(value & F.col("text").rlike(REVISION_TOKEN), F.struct("pos", "text"))).alias("rev"),
        F.array_sort(F.collect_list(F.when(value, F.struct("pos", "text")))).alias("values"), F.min("y0").alias("y0"),
    ).where("rev is not null")
    date = F.array_join(F.transform(F.filter("values", lambda v: v["pos"] < F.col("rev.pos")), lambda v: v["text"]), " ")
    return sums.select(*line, "segment", "label", date.alias("date_value"), X.normalize_revision(F.col("rev.text")).alias("revision_value"), "y0")


def bodies(words: DataFrame, height: float = HEIGHT) -> DataFrame:
    """body_y (above the first words of a table's head in the page's upper 35 %, else a default) and footer_y and footer_baseline (top of the words in the last 80 points, and their end less 1, else defaults)."""
    head = F.upper(F.trim("text")).isin(*BODY_WORDS) & F.col("y0").between(80, height * 0.35)
    below = F.col("y0") >= height - 80
    starts, footer, end = F.min(F.when(head, F.col("y0"))), F.min(F.when(below, F.col("y0"))), F.max(F.when(below, F.col("y1")))
    # greatest passes over null
    body = F.when(starts.isNotNull(), F.greatest(F.lit(86.0), starts - 4)).otherwise(min(112.0, height * 0.18))
    return words.groupBy(*PAGE).agg(body.alias("body_y"), F.coalesce(footer, F.lit(height - 50.0)).alias("footer_y"), F.coalesce(end - 1, F.lit(height - 39.0)).alias("footer_baseline"))


def current_revisions(words: DataFrame, height: float = HEIGHT) -> DataFrame:
    """The revision in each page's header: in the word REV or the one after it, the first that has one."""
    order = W.partitionBy(*PAGE).orderBy("y0", "x0", "word_number")
    top = words.where(F.col("y0") <= min(145.0, height * 0.2)).withColumn("text", F.trim("text"))
    after = F.lead("text").over(order)
    value = F.coalesce(F.nullif(F.regexp_extract("text", HEADER_REVISION, 1), F.lit("")), F.when(after.rlike(r"(?i)^\d{1,3}[A-Z]?$"), after))
    found = top.withColumns({"place": F.row_number().over(order), "value": F.when(F.col("text").rlike(HEADER_REVISION), F.upper(value))})
    return found.where("value is not null").groupBy(*PAGE).agg(F.min_by("value", "place").alias("current"))
