"""Tables of contents: pagination, indexes, links, sections, page shifts, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scans import running


def paginate(rows: DataFrame, by: list[str], order: list[str], height: float = 792.0) -> DataFrame:
    """toc_page and toc_y of entries; the first page begins at 110, others at 90, lines are 16 apart and end 54 above the page's end."""
    return _placed(rows, by, order, F.lit(110), F.lit(90), F.lit(height - 54)).withColumn("toc_y", F.col("toc_y").cast("int"))


def paginate_sections(rows: DataFrame, by: list[str], order: list[str], height: float = 792.0) -> DataFrame:
    """The same for a section, below its first page's body (body_y) by 43, then 15, and to 12 above its footer (footer_y) at most; one entry a page at least."""
    body = F.col("body_y")
    return _placed(rows, by, order, body + 43, body + 15, F.least(F.lit(height - 54), F.col("footer_y") - 12))


def _placed(rows: DataFrame, by: list[str], order: list[str], top: Column, later: Column, bottom: Column) -> DataFrame:
    return _on_pages(rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1), top, later, bottom)


def _on_pages(rows: DataFrame, top: Column, later: Column, bottom: Column) -> DataFrame:
    """The page and place of entry _i (from 0)."""
    fits = lambda y: F.greatest(F.lit(1), F.floor((bottom - y) / 16))
    rows = rows.withColumns({"_first": fits(top), "_others": fits(later)})
    rest, is_first = F.col("_i") - F.col("_first"), F.col("_i") < F.col("_first")
    page = F.when(is_first, 1).otherwise(F.floor(rest / F.col("_others")) + 2)
    y = F.when(is_first, top + 16 * F.col("_i")).otherwise(later + 16 * F.pmod(rest, F.col("_others")))
    return rows.withColumns({"toc_page": page.cast("int"), "toc_y": y}).drop("_i", "_first", "_others")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as a partial-aggregated minimum."""
    rest = [c for c in rows.columns if c not in key]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*key).agg(F.min(ordered).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def resolve(rows: DataFrame, index: DataFrame, key: list[str], missing: str) -> DataFrame:
    """Rows with the index's columns, and unresolved_reason where the index has no such key."""
    found = rows.join(index.withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn("unresolved_reason", F.when(F.col("_found").isNull(), missing)).drop("_found")


def resolve_global(label: Column, by_label: Column, by_title: Column, front: Column) -> Column:
    """By label, title, then front matter; a missed TOC label stays unresolved."""
    return F.when(by_label.isNotNull(), by_label).when(label.rlike(r"^TOC \d{2}-"), F.lit(None)).otherwise(F.coalesce(by_title, front))


def runs(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive numbers, as start and length."""
    once = rows.select(*by, value).distinct()
    group = F.col(value) - F.row_number().over(W.partitionBy(*by).orderBy(value))
    return once.withColumn("_g", group).groupBy(*by, "_g").agg(F.min(value).alias("start"), F.count("*").alias("length")).drop("_g")


def longest_run(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The longest, the earliest of equals."""
    best = F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start")))
    return runs(rows, by, value).groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def sections(roots: DataFrame, by: list[str], start: str, last_page: str) -> DataFrame:
    """The first root of each page; a section ends before the next one begins."""
    own = first_wins(roots, [*by, start], ["ord"])
    return own.withColumn("end_page", F.coalesce(F.lead(start).over(W.partitionBy(*by).orderBy(start)) - 1, F.col(last_page)))


def assign_sections(rows: DataFrame, starts: DataFrame, by: list[str], page: str) -> DataFrame:
    """The last section that begins at or before each row's page, by one sort instead of a range join. starts: by, page, section."""
    both = rows.withColumn("_kind", F.lit(1)).unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(page, "_kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("section", F.last("section", ignorenulls=True).over(order)).where("_kind = 1").drop("_kind")


def shift_pages(rows: DataFrame, insertions: DataFrame, by: list[str], page: str, own: bool = False) -> DataFrame:
    """Pages after insertions (by, start_page, n) before or at them (own: strictly before), by a running sum."""
    both = rows.withColumn("_kind", F.lit(0 if own else 1)).unionByName(insertions.select(*by, F.col("start_page").alias(page), F.col("n").alias("_n"), F.lit(1 if own else 0).alias("_kind"), F.lit(True).alias("_ins")), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(page, "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("shifted_page", F.col(page) + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return both.where("_ins is null").drop("_n", "_kind", "_ins")


def source_pages(rows: DataFrame, insertions: DataFrame, by: list[str], page: str) -> DataFrame:
    """J7 backwards: source_page of pages behind insertions (by, start_page, n), and is_new: whether the page was inserted, when source_page is the page it stands before."""
    w = W.partitionBy(*by).orderBy("start_page")
    placed = insertions.groupBy(*by, "start_page").agg(F.sum("n").alias("_n")).withColumn("_upto", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = placed.select(*by, (F.col("start_page") + F.col("_upto") - F.col("_n")).alias(page), F.struct("start_page", "_n", "_upto").alias("section"))
    rows = assign_sections(rows, starts, by, page)
    first = F.col("section.start_page") + F.col("section._upto") - F.col("section._n")
    new = F.coalesce(F.col(page) < first + F.col("section._n"), F.lit(False))
    source = F.when(new, F.col("section.start_page")).otherwise(F.col(page) - F.coalesce("section._upto", F.lit(0)))
    return rows.withColumns({"source_page": source, "is_new": new}).drop("section")


def shifted_through(rows: DataFrame, steps: list[DataFrame], by: list[str], page: str) -> DataFrame:
    """J7 over several insertions one after another, each in page numbers of the one before: the pages at the end as shifted_page."""
    rows = rows.withColumn("shifted_page", F.col(page))
    for insertions in steps:
        moved = shift_pages(rows.withColumnRenamed("shifted_page", "_at"), insertions, by, "_at")
        rows = moved.drop("_at")
    return rows


def retargeted(rows: DataFrame, plans: DataFrame, insertions: DataFrame, by: list[str], target: str) -> DataFrame:
    """H3 (J6, J7): new_target: the first contents page of the section that a target lies in, else the target behind all insertions. plans: by, start_page, end_page, first_toc_page."""
    starts = plans.select(*by, F.col("start_page").alias(target), F.struct("end_page", "first_toc_page").alias("section"))
    moved = assign_sections(shift_pages(rows, insertions, by, target), starts, by, target)
    within = F.col("section").isNotNull() & (F.col(target) <= F.col("section.end_page"))
    return moved.withColumn("new_target", F.when(within, F.col("section.first_toc_page")).otherwise(F.col("shifted_page"))).drop("section", "shifted_page")


def shift_pages_in_ranges(rows: DataFrame, insertions: DataFrame, by: list[str], page: str, cut: Column, own: bool = False) -> DataFrame:
    """J7 for documents of any size: the same pages as shift_pages gives, by a running sum over ranges of pages. cut: a range, told by the column page."""
    ahead = insertions.select(*by, F.col("start_page").alias(page), F.col("n").alias("_n"), F.lit(1 if own else 0).alias("_kind"), F.lit(True).alias("_ins"))
    both = rows.withColumn("_kind", F.lit(0 if own else 1)).unionByName(ahead, allowMissingColumns=True)
    both = running(both, by, [page, "_kind"], cut, {"_added": ("sum", F.col("_n"))})
    return both.withColumn("shifted_page", F.col(page) + F.col("_added")).where("_ins is null").drop("_n", "_kind", "_ins", "_added")


def assign_sections_in_ranges(rows: DataFrame, starts: DataFrame, by: list[str], page: str, cut: Column) -> DataFrame:
    """J5, J6, W15 for documents of any size: the same sections as assign_sections gives."""
    both = rows.withColumn("_kind", F.lit(1)).unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True).withColumnRenamed("section", "_own")
    both = running(both, by, [page, "_kind"], cut, {"section": ("last", F.col("_own"))})
    return both.where("_kind = 1").drop("_kind", "_own")


def paginate_in_ranges(rows: DataFrame, by: list[str], order: list[str], cut: Column, height: float = 792.0) -> DataFrame:
    """W12 for documents of any size: the same places as paginate gives."""
    rows = running(rows, by, order, cut, {"_n": ("sum", F.lit(1).cast("long"))})
    return _on_pages(rows.withColumn("_i", F.col("_n") - 1).drop("_n"), F.lit(110), F.lit(90), F.lit(height - 54)).withColumn("toc_y", F.col("toc_y").cast("int"))


def assemble_in_ranges(rows: DataFrame, by: list[str], order: list[str], start: Column, text: str, cut: Column) -> DataFrame:
    """W7 for documents of any size: the same rows as assemble gives. A row's own lines are still put together in one task."""
    rows = running(rows, by, order, cut, {"row_number": ("sum", start.cast("int"))})
    return _joined(rows, by, order, text)


def assemble(rows: DataFrame, by: list[str], order: list[str], start: Column, text: str) -> DataFrame:
    """A row starts where start holds; later rows add their text to it; those before the first start are left out."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("row_number", F.sum(start.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return _joined(rows, by, order, text)


def _joined(rows: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.where("row_number > 0").groupBy(*by, "row_number").agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("joined"), F.count("*").alias("n_parts"))


def chapter_labels(plans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """first_label of each plan: TOC cc-n, with n counted on over a chapter's plans. plans: chapter, n_pages."""
    w = W.partitionBy(*by, "chapter").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return plans.withColumn("first_label", F.concat(F.lit("TOC "), F.col("chapter"), F.lit("-"), (F.coalesce(F.sum("n_pages").over(w), F.lit(0)) + 1).cast("string")))


def overlapping(rects: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Rects that some other on the same page overlaps."""
    a, b = rects.alias("a"), others.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    near = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, [*same, near], "left_semi")


# Sides of the cells of the grid's levels in points; the last one's outer cells have no end.
CELLS = (32.0, 128.0, 512.0, 2048.0, 8192.0)


def _cells(rects: DataFrame, kind: str) -> DataFrame:
    """Rects by the cells they lie in. kind: home (the first level whose cells are as large as the rect), coarser (the levels above), or all of those."""
    size = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    home = F.lit(len(CELLS) - 1)
    for level in reversed(range(len(CELLS) - 1)):
        home = F.when(size <= CELLS[level], level).otherwise(home)
    levels = F.sequence(F.lit(0), F.lit(len(CELLS) - 1))
    wanted = {"home": lambda i: i == home, "coarser": lambda i: i > home, "all": lambda i: i >= home}[kind]
    rects = rects.withColumn("_level", F.explode(F.filter(levels, wanted)))
    side = F.element_at(F.array(*map(F.lit, CELLS)), F.col("_level") + 1)
    # greatest and least pass over null
    place = lambda c: F.when(F.col(c).isNotNull(), F.floor(F.greatest(F.lit(-16384.0), F.least(F.lit(16384.0), F.col(c))) / side).cast("int"))
    for axis in "xy":
        one, other = place(f"{axis}0"), place(f"{axis}1")
        rects = rects.withColumn(f"_{axis}", F.explode(F.sequence(F.least(one, other), F.greatest(one, other))))
    return rects


def overlapping_on_grid(rects: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """J12 for crowded pages: the same rows as overlapping gives, by equal cells of a grid.

    Each rectangle lies in four cells at most of the level of its size, and meets larger ones in cells of theirs; two that overlap share a cell of
    the larger one's level. Places beyond 16384 points are those cells' last, which keeps all overlaps. Repeated rects stay as they are; those
    with a null side or page overlap nothing.
    """
    rect = ["x0", "y0", "x1", "y1"]
    a, b = (r.select(*by, *[F.col(c).cast("double").alias(c) for c in rect]).distinct() for r in (rects, others))
    near = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))

    def met(one: str, other: str) -> DataFrame:
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "_level", "_x", "_y")]
        return _cells(a, one).alias("a").join(_cells(b, other).alias("b"), [*same, near], "left_semi").select(*by, *rect)

    hit = met("all", "home").unionByName(met("home", "coarser")).distinct()
    return rects.join(hit, [*by, *rect], "left_semi")


def row_records(rows: DataFrame) -> DataFrame:
    """what a report shows of rows of contents."""
    return rows.select("doc_id", "title", F.col("page_number").alias("toc_page"), "reference_text", "toc_type", "target_label", F.col("target_page_number").alias("target_page"), "unresolved_reason")
