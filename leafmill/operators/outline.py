"""Outlines: targets of front matter, and outlines made from roots, rows and new contents pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .contents import assign_sections, first_wins
from .headings import clamp_levels

# Front matter as contents name it, and a term of its outline title, in the order they are tried.
FRONT_MATTER = (
    ("DGCA APPROVAL LETTER", "APPROVAL LETTER"),
    ("LOG OF REVISIONS", "LOG OF REV"),
    ("LOG OF TEMPORARY REVISIONS", "LOG OF TEMP REV"),
    ("LIST OF EFFECTIVE PAGES", "LEP"),
    ("TABLE OF CONTENTS", "TOC"),
)

# The chapter after an aircraft type in an outline title.
CHAPTER_IN_TITLE = r"(?i)\b(?:787|777|737|A\s*320|A\s*321|A\s*330|A\s*350|A\s*380)[\s_-]+(\d{2})\b"


def title_index(outline: DataFrame) -> DataFrame:
    """doc_id, key (normalised title), ord, page: the first of each title. outline: doc_id, ord, level, title, page_number (from 1); page counts from 0."""
    rows = outline.where("page_number >= 1").select("doc_id", X.normalize_title(F.col("title")).alias("key"), "ord", (F.col("page_number") - 1).alias("page"))
    return first_wins(rows, ["doc_id", "key"], ["ord"])


def front_matter(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (doc_id, title, ...) with front_page: the first outline title with the term of the first kind of front matter that has one.

    The outline is cut to its first page for each term before the join, so the join is by document and term.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(name).alias("name"), F.lit(term).alias("term")) for i, (name, term) in enumerate(FRONT_MATTER)])
    having = titles.select("doc_id", "ord", "page", F.explode(F.filter(kinds, lambda k: F.col("key").contains(k["term"]))).alias("k"))
    firsts = having.groupBy("doc_id", F.col("k.kind").alias("kind")).agg(F.min_by("page", "ord").alias("page"))
    wanted = rows.select("doc_id", "title").distinct().withColumn("key", X.normalize_title(F.col("title")))
    asked = wanted.select("doc_id", "title", F.explode(F.filter(kinds, lambda k: F.col("key").contains(k["name"]))).alias("k")).select("doc_id", "title", F.col("k.kind").alias("kind"))
    found = asked.join(firsts, ["doc_id", "kind"]).groupBy("doc_id", "title").agg(F.min_by("page", "kind").alias("_page"))
    cover = X.normalize_title(F.col("title")).contains("COVER PAGE")
    return rows.join(found, ["doc_id", "title"], "left").withColumn("front_page", F.when(cover, F.lit(0)).otherwise(F.col("_page"))).drop("_page")


def section_roots(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, page, chapter, title: the first level's entries whose chapter is known from title or page, one a page. pages as of pages.page_texts."""
    tops = outline.where("level = 1 and page_number >= 1").join(pages.select("doc_id", "page_number", "top_text"), ["doc_id", "page_number"], "left")
    named = F.nullif(F.regexp_extract("title", CHAPTER_IN_TITLE, 1), F.lit(""))
    title = section_title(X.header_bookmark(F.col("top_text")), X.bookmark(F.col("title")), F.col("title"))
    rows = tops.select("doc_id", "ord", F.col("page_number").alias("page"), F.coalesce(named, X.ata_chapter(F.col("top_text"))).alias("chapter"), title.alias("title"))
    return first_wins(rows.where("chapter is not null"), ["doc_id", "page"], ["ord"])


def roots(outline: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, page, title: one root a page, of the outline's first level or else of the global rows (doc_id, ord, toc_type, title, target_page)."""
    own = outline.where("level = 1 and page_number >= 1").select("doc_id", F.col("page_number").alias("page"), F.lit(0).alias("kind"), "ord", "title")
    more = rows.where("toc_type = 'global' and target_page is not null").select("doc_id", F.col("target_page").alias("page"), F.lit(1).alias("kind"), "ord", "title")
    return first_wins(own.unionByName(more), ["doc_id", "page"], ["kind", "ord"]).select("doc_id", "page", "title")


def nested_levels(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """W3 below a root: levels of 2 to 6, each at most one above the one before, which first is the root's 1."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_l", F.greatest(F.lit(2), F.least(F.lit(6), F.col("level"))) - F.col("_i"))
    level = F.col("_i") + F.least(F.lit(1), F.min("_l").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("level", level.cast("int")).drop("_i", "_l")


def from_roots(tops: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, root_page, level, title, page, y: roots, each followed by the local rows up to the next one; rows before the first root are left out."""
    local = rows.where("toc_type = 'local' and target_page is not null").select("doc_id", F.col("target_page").alias("page"), F.col("target_y").alias("y"), "level", "title")
    starts = tops.select("doc_id", "page", F.col("page").alias("section"))
    placed = assign_sections(local, starts, ["doc_id"], "page").where("section is not null").withColumnRenamed("section", "root_page")
    under = nested_levels(placed, ["doc_id", "root_page"], ["page", "y", "title"])
    heads = tops.select("doc_id", F.col("page").alias("root_page"), F.lit(1).alias("level"), "title", "page", F.lit(None).cast("double").alias("y"))
    return heads.unionByName(under.select(*heads.columns))


def from_rows(rows: DataFrame) -> DataFrame:
    """An outline without roots, from the rows with targets but for references."""
    kept = rows.where("toc_type != 'reference' and target_page is not null").select("doc_id", F.col("target_page").alias("page"), F.col("target_y").alias("y"), "level", "title").withColumn("sort_level", F.col("level"))
    return clamp_levels(kept, "level", ["doc_id"], ["page", "y", "sort_level", "title"]).drop("sort_level")


def with_sections(outline: DataFrame, plans: DataFrame, headings: DataFrame) -> DataFrame:
    """The outline with the roots at which a section's new contents begin replaced by the section and its headings.

    outline: doc_id, ord, level, title, page_number. plans: doc_id, start_page, title. headings: doc_id, start_page, ord, level, title, page.
    Items below a replaced root are left out. Rows have ord, sub (place below a replaced root), level, title, page (in the source), is_contents
    (a section's root, which leads to its contents page). A document whose outline has no rows gets its sections.
    """
    rows = outline.where("page_number >= 1").join(plans.select("doc_id", F.col("start_page").alias("page_number"), F.col("title").alias("plan")), ["doc_id", "page_number"], "left")
    so_far = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    replaced = F.coalesce(F.last(F.when(F.col("level") == 1, F.col("plan").isNotNull()), ignorenulls=True).over(so_far), F.lit(False))
    rows = rows.withColumn("_replaced", replaced).where("level = 1 or not _replaced")
    new = (F.col("level") == 1) & F.col("plan").isNotNull()
    own = rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("sub"), F.col("level").cast("int").alias("level"), F.when(new, F.col("plan")).otherwise(F.col("title")).alias("title"), F.col("page_number").alias("page"), new.alias("is_contents"))
    none = plans.join(outline.where("page_number >= 1").select("doc_id").distinct(), "doc_id", "left_anti")
    alone = none.select("doc_id", F.col("start_page").cast("long").alias("ord"), F.lit(0).cast("long").alias("sub"), F.lit(1).alias("level"), "title", F.col("start_page").alias("page"), F.lit(True).alias("is_contents"))
    tops = own.unionByName(alone)
    under = nested_levels(headings.withColumn("level", F.col("level") + 1), ["doc_id", "start_page"], ["ord"])
    at = tops.where("is_contents").select("doc_id", F.col("page").alias("start_page"), F.col("ord").alias("_ord"))
    added = under.join(at, ["doc_id", "start_page"]).select("doc_id", F.col("_ord").alias("ord"), F.col("ord").cast("long").alias("sub"), "level", "title", "page", F.lit(False).alias("is_contents"))
    return tops.unionByName(added.withColumn("sub", F.col("sub") + 1))


def section_title(page_title: Column, own: Column, fallback: Column) -> Column:
    """The page's bookmark, or the outline's if that extends it; else the outline's title."""
    return F.when(own.startswith(F.concat(page_title, F.lit("_"))), own).otherwise(F.coalesce(page_title, own, fallback))
