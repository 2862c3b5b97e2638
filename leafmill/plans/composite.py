"""Whole plans: contents of a document's front, links of contents that exist, choice of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import cells, contents, outline, pages, revision, rows
from ..operators.headings import clamp_levels

# Margin and indent of entries in new contents, and the size of a first level's entry.
MARGIN, INDENT, ENTRY_SIZE = 54.0, 18.0, 10.5


def front_contents(headings: DataFrame) -> DataFrame:
    """Headings (doc_id, page_number, line_order, title, level) with clamped levels, their place in the new contents, and page_out behind those pages."""
    order = ["page_number", "line_order"]
    rows = contents.paginate(clamp_levels(headings, "level", ["doc_id"], order), ["doc_id"], order)
    rows = rows.withColumn("n_toc_pages", F.max("toc_page").over(W.partitionBy("doc_id")))
    return rows.withColumn("page_out", F.col("page_number") + F.col("n_toc_pages"))


def linked_global_rows(rows: DataFrame, labels: DataFrame, titles: DataFrame) -> DataFrame:
    """C3 for the document's contents (J2, X7, J3): rows (doc_id, ord, title, chapter, reference_text) with target_label, target (page index) and unresolved_reason."""
    rows = rows.where(pages.is_linkable(F.col("title"))).withColumn("target_label", X.target_label(F.col("reference_text"), F.col("chapter")))
    rows = rows.withColumns({"_label": X.normalize_link_label(F.col("target_label")), "_key": X.normalize_title(F.col("title"))})
    rows = rows.join(labels.select("doc_id", F.col("label").alias("_label"), F.col("page_number").alias("_by_label")), ["doc_id", "_label"], "left")
    rows = rows.join(titles.select("doc_id", F.col("key").alias("_key"), F.col("page").alias("_by_title")), ["doc_id", "_key"], "left")
    rows = outline.front_matter(rows, titles)
    target = contents.resolve_global(F.coalesce("_label", F.lit("")), F.col("_by_label"), F.col("_by_title"), F.col("front_page"))
    return rows.withColumn("target", target).withColumn("unresolved_reason", F.when(F.col("target").isNull(), "page_label_or_outline_not_resolved")).drop("_label", "_key", "_by_label", "_by_title", "front_page")


def linked_item_rows(rows: DataFrame, items: DataFrame, missing: str) -> DataFrame:
    """C3 and J4 for rows that name items (doc_id, label): target page and y of the item's first place."""
    index = items.select("doc_id", "label", F.col("page_number").alias("target"), F.col("y").alias("target_y"))
    return contents.resolve(rows, index, ["doc_id", "label"], missing)


def link_plan(words: DataFrame, titles: DataFrame, coverage: DataFrame | None = None, ocr_words: DataFrame | None = None) -> DataFrame:
    """C3 from words to links: contents and reference pages, their entries, the indexes of page labels and items, and each entry's target.

    words: of pages, from 1. titles: of outline.title_index. An entry has its rectangle, and target_page (counted from 0) and target_y, or
    unresolved_reason. A chapter's entries and references are found by their item's first place in the body, the document's by label, title and
    front matter. coverage (doc_id, page_number, coverage) says how much of a page images cover, ocr_words are the words read from them: where
    both are given, reference pages that are images have rows, too.
    """
    texts = pages.page_texts(words)
    first, local = pages.contents_pages(texts), pages.local_contents_pages(texts)
    found = rows.extracted(words, first, local)
    labels = pages.page_labels(texts, first).withColumn("page_number", F.col("page_number") - 1)
    both = first.unionByName(local.select(*first.columns)).distinct()
    items = pages.item_labels(pages.word_lines(words), texts, both).withColumn("page_number", F.col("page_number") - 1)
    by_item = linked_item_rows(found.where("toc_type = 'local'"), items, "item_label_not_found_in_body")
    by_item = by_item.withColumn("target_label", F.col("label")).withColumnRenamed("target", "target_page")
    area = pages.coverage_of(words) if coverage is None else coverage
    named = rows.reference_rows(words, pages.reference_pages(texts, area), ocr_words, coverage)
    by_reference = linked_item_rows(named, items, "eicas_item_not_found_in_body").withColumn("chapter", F.lit(None).cast("string"))
    by_reference = by_reference.withColumn("target_label", F.col("label")).withColumnRenamed("target", "target_page")
    by_label = linked_global_rows(found.where("toc_type = 'global'"), labels, titles).withColumnRenamed("target", "target_page").withColumn("target_y", F.lit(0.0))
    kept = ["doc_id", "page_number", "toc_type", "row_number", "title", "level", "chapter", "reference_text", "target_label", *rows.RECT, "target_page", "target_y", "unresolved_reason"]
    return by_label.select(*kept).unionByName(by_item.select(*kept)).unionByName(by_reference.select(*kept))


def link_edits(plan: DataFrame, links: DataFrame) -> DataFrame:
    """K9: what link_plan changes in the documents: doc_id, page_number, operation, rectangle (x0, y0, x1, y1), target_page, target_y.

    links (doc_id, page_number, x0, y0, x1, y1) are those that exist. All links of contents pages go (delete_link), on other pages those that a
    new one overlaps; each resolved entry adds one (insert_link).
    """
    new = plan.where("target_page is not null").select("doc_id", "page_number", "toc_type", *[F.col(f"rect_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "target_page", "target_y")
    on_contents = plan.where("toc_type != 'reference'").select("doc_id", "page_number").distinct()
    all_gone = links.join(on_contents, ["doc_id", "page_number"], "left_semi")
    some_gone = contents.overlapping(links.join(on_contents, ["doc_id", "page_number"], "left_anti"), new.drop("toc_type"), ["doc_id", "page_number"])
    gone = all_gone.unionByName(some_gone).select("doc_id", "page_number", F.lit("delete_link").alias("operation"), "x0", "y0", "x1", "y1", F.lit(None).cast(new.schema["target_page"].dataType).alias("target_page"), F.lit(None).cast("double").alias("target_y"))
    return gone.unionByName(new.select("doc_id", "page_number", F.lit("insert_link").alias("operation"), "x0", "y0", "x1", "y1", "target_page", F.col("target_y").cast("double").alias("target_y")))


def contents_edits(headings: DataFrame, height: float = 792.0) -> DataFrame:
    """K7: pages to put at a document's front (insert_page) and the entries written on them (insert_text, insert_link), in order of place.

    headings: of front_contents. Columns: doc_id, place, operation, page (of the new document, from 1), x, y, text, target_page.
    """
    entries = headings.select("doc_id", "toc_page", "toc_y", "level", "title", "page_out", "line_order")
    made = entries.groupBy("doc_id").agg(F.max("toc_page").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    none = lambda kind: F.lit(None).cast(kind)
    new_pages = made.select("doc_id", F.lit("insert_page").alias("operation"), "page", none("double").alias("x"), none("double").alias("y"), none("string").alias("text"), none("long").alias("target_page"), none("int").alias("line_order"))
    x = (MARGIN + INDENT * F.greatest(F.lit(0), F.col("level") - 1)).alias("x")
    y, target = F.col("toc_y").cast("double").alias("y"), F.col("page_out").cast("long").alias("target_page")
    text = entries.select("doc_id", F.lit("insert_text").alias("operation"), F.col("toc_page").alias("page"), x, y, F.col("title").alias("text"), none("long").alias("target_page"), F.col("line_order").cast("int"))
    link = entries.select("doc_id", F.lit("insert_link").alias("operation"), F.col("toc_page").alias("page"), x, y, none("string").alias("text"), target, F.col("line_order").cast("int"))
    every = new_pages.unionByName(text).unionByName(link)
    kind = F.when(F.col("operation") == "insert_page", 0).otherwise(1)
    order = W.partitionBy("doc_id").orderBy(kind, "page", F.col("y").asc_nulls_first(), "line_order", F.col("operation").desc())
    return every.withColumn("place", F.row_number().over(order)).drop("line_order")


def cell_overwrites(placed: DataFrame) -> DataFrame:
    """Cells of lists of effective pages to write over, from effective_rows: doc_id, page_number, y, column (label, revision), value."""
    cells = F.array(F.struct(F.lit("label").alias("column"), F.col("label").alias("value")), F.struct(F.lit("revision").alias("column"), F.col("new_revision").alias("value")))
    return placed.where("lep_page is not null").select("doc_id", F.col("lep_page").alias("page_number"), F.col("lep_y").alias("y"), F.explode(cells).alias("c")).select("doc_id", "page_number", "y", "c.*")


def chosen_headings(items: DataFrame, layout: DataFrame) -> DataFrame:
    """A document's headings from its item tables, or from its layout if it has none."""
    columns = [c for c in items.columns if c in layout.columns]
    return items.select(*columns).unionByName(layout.join(items.select("doc_id").distinct(), "doc_id", "left_anti").select(*columns))


def headings_of_links(rows: DataFrame) -> DataFrame:
    """Rows with targets, but for references, as headings."""
    return rows.where("toc_type != 'reference' and target_page is not null").select("doc_id", "title", "level", F.col("target_page").alias("page"), F.lit(1.0).alias("confidence"), F.concat(F.lit("existing_"), "toc_type", F.lit("_toc")).alias("source"), F.col("target_y").alias("y0"))


def section_contents(roots: DataFrame, headings: DataFrame, documents: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: contents pages to put before each section: the sections, and their entries.

    roots: doc_id, ord, page, chapter, title (outline.section_roots). headings: doc_id, page, y0, title, level. documents: doc_id,
    last_page. bodies: of pages.bodies. A section takes the headings within its pages that are of its chapter (J5); sections without any
    are left out. Sections have n_pages, first_toc_page and first_label; entries toc_page, toc_y, and final_page after all insertions (J7).
    """
    spans = contents.sections(roots.join(documents, "doc_id"), ["doc_id"], "page", "last_page").select("doc_id", F.col("page").alias("start_page"), "end_page", "chapter", "title")
    starts = spans.select("doc_id", F.col("start_page").alias("page"), F.col("start_page").alias("section"))
    within = contents.assign_sections(headings, starts, ["doc_id"], "page").withColumnRenamed("section", "start_page")
    own = within.join(spans.select("doc_id", "start_page", "end_page", "chapter"), ["doc_id", "start_page"]).where("page <= end_page and chapter = regexp_extract(title, '^([0-9]{2})-', 1)")
    placed = own.join(bodies.withColumnRenamed("page_number", "start_page"), ["doc_id", "start_page"], "left").fillna({"body_y": 112.0, "footer_y": 742.0})
    entries = contents.paginate_sections(placed, ["doc_id", "start_page"], ["page", "y0", "title"]).drop("body_y", "footer_y", "footer_baseline", "end_page")
    sizes = entries.groupBy("doc_id", "start_page").agg(F.max("toc_page").cast("long").alias("n_pages"), F.count("*").alias("n_entries"))
    plans = contents.chapter_labels(spans.join(sizes, ["doc_id", "start_page"]), ["doc_id"], ["start_page"])
    insertions = plans.select("doc_id", "start_page", F.col("n_pages").alias("n"))
    plans = contents.shift_pages(plans, insertions, ["doc_id"], "start_page", own=True).withColumnRenamed("shifted_page", "first_toc_page")
    return plans, contents.shift_pages(entries, insertions, ["doc_id"], "page").withColumnRenamed("shifted_page", "final_page")


def section_edits(plans: DataFrame, entries: DataFrame, rows: DataFrame, links: DataFrame, bodies: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """K8 and H3: what contents pages before sections change in the documents, to be applied by step, turn, page, y0 and operation.

    plans, entries: of section_contents. rows (doc_id, page_number, rectangle, target_page): resolved rows of the document's contents, of link_plan
    with toc_type global, but with targets from 1. links (doc_id, page_number, rectangle): those that exist. bodies: of pages.bodies.
    Step 0 copies a section's first page before it (insert_page at page, in source numbers: later sections first, so they hold). All other steps
    are in final page numbers: 1 empties the copies (delete_link of the whole page, delete_text of body and footer), 2 writes them
    (insert_text, insert_link), 3 leads the document's contents to the new pages: links beneath a row go (delete_link) before its own comes
    (insert_link). x0 is null for text in the line's middle. A document without sections has no edits.
    """
    types = {"turn": "long", "page": "long", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "text": "string", "target_page": "long", "target_y": "double"}
    col, lit = F.col, F.lit

    def edit(step: int, operation: str, **values: Column) -> Column:
        return F.struct(lit(step).alias("step"), lit(operation).alias("operation"), *[values.get(c, lit(None)).cast(t).alias(c) for c, t in types.items()])

    def edits(made: DataFrame, *each: Column) -> DataFrame:
        return made.select("doc_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("doc_id", "e.*")

    insertions = plans.select("doc_id", "start_page", col("n_pages").alias("n"))
    at = bodies.withColumnRenamed("page_number", "start_page")
    copies = plans.join(at, ["doc_id", "start_page"], "left").fillna({"body_y": 112.0, "footer_y": height - 50.0, "footer_baseline": height - 39.0})
    copies = copies.select("*", F.explode(F.sequence(lit(0), (col("n_pages") - 1).cast("int"))).alias("i"))
    new, body, footer = col("first_toc_page") + col("i"), col("body_y"), col("footer_y")
    across = {"x0": lit(36.0), "x1": lit(width - 36)}
    label = F.concat(F.regexp_extract("first_label", "^(.*-)", 1), (F.regexp_extract("first_label", "([0-9]+)$", 1).cast("long") + col("i")).cast("string"))
    of_copies = edits(
        copies,
        edit(0, "insert_page", turn=-col("start_page"), page=col("start_page")),
        edit(1, "delete_link", page=new),
        edit(1, "delete_text", page=new, y0=F.greatest(lit(0.0), body - 2), y1=F.greatest(body + 20, footer - 4), **across),
        edit(1, "delete_text", page=new, y0=F.greatest(lit(0.0), footer - 3), y1=lit(height - 20), **across),
        edit(2, "insert_text", page=new, y0=col("footer_baseline"), text=label),
        F.when(col("i") == 0, edit(2, "insert_text", page=new, y0=body + 18, text=lit("Table of Contents"))),
    )
    written = entries.join(plans.select("doc_id", "start_page", "first_toc_page"), ["doc_id", "start_page"])
    x, y, page = MARGIN + INDENT * F.greatest(lit(0), col("level") - 1), col("toc_y").cast("double"), col("first_toc_page") + col("toc_page") - 1
    size = F.greatest(lit(8.5), lit(ENTRY_SIZE) - (col("level") - 1) * 0.25)
    of_entries = edits(
        written,
        edit(2, "insert_text", page=page, x0=x, y0=y, text=col("title")),
        edit(2, "insert_link", page=page, x0=lit(MARGIN), y0=y - size, x1=lit(width - MARGIN), y1=y + 3, target_page=col("final_page"), target_y=F.greatest(lit(0.0), F.coalesce("y0", lit(0.0)))),
    )
    # a row of contents and a link beneath it move together, so they are compared where they were
    rect = {c: col(c) for c in ("x0", "y0", "x1", "y1")}
    own = rows.join(plans.select("doc_id").distinct(), "doc_id", "left_semi")
    beneath = contents.overlapping_on_grid(links, own, ["doc_id", "page_number"])
    told = ["doc_id", "page_number", *rect, "operation", "new_target"]
    led = contents.retargeted(own, plans, insertions, ["doc_id"], "target_page").withColumn("operation", lit("insert_link")).select(told)
    changed = led.unionByName(beneath.withColumn("operation", lit("delete_link")), allowMissingColumns=True)
    changed = contents.shift_pages(changed.select(told), insertions, ["doc_id"], "page_number")
    target_y = F.when(col("operation") == "insert_link", 0.0)
    placed = edit(3, "", page=col("shifted_page"), **rect, target_page=col("new_target"), target_y=target_y).withField("operation", col("operation"))
    return of_copies.unionByName(of_entries).unionByName(edits(changed, placed))


def stamped_changes(changes: DataFrame, entries: DataFrame, current: DataFrame, revision_value: str | None = None) -> DataFrame:
    """C6 up to the pages' drawing (W20, A7, X18, J8): changes (doc_id, page_index, page_label, change_type) once a page and label, with new_revision and the row of the list of effective pages that it goes to.

    The new revision is the one given, or follows the one in the page's header (current: of pages.current_revisions, pages from 1), or else
    the chapter's highest in the list. entries: of pages.effective_entries; of equal labels the last counts. lep_page is null where the list lacks the label.
    """
    rows = revision.one_change_a_page(changes).withColumn("chapter", X.chapter_of_label(F.col("page_label"))).withColumn("page_number", F.col("page_index") + 1)
    rows = rows.join(current, ["doc_id", "page_number"], "left").join(revision.chapter_revisions(entries, ("doc_id",)).withColumnRenamed("revision", "_chapter"), ["doc_id", "chapter"], "left")
    after = X.normalize_revision(F.lit(revision_value)) if revision_value else X.next_revision(F.col("current"), F.col("_chapter"))
    listed = entries.select("doc_id", X.normalize_revision_label(F.col("label")).alias("label"), F.col("page_number").alias("lep_page"), "y0", "block_number", "line_number", "segment")
    last = contents.last_wins(listed, ["doc_id", "label"], ["lep_page", "y0", "block_number", "line_number", "segment"]).select("doc_id", "label", "lep_page", F.col("y0").alias("lep_y"))
    return rows.withColumn("new_revision", after).drop("current", "_chapter", "page_number").join(last, ["doc_id", "label"], "left")


def effective_rows(stamped: DataFrame, entries: DataFrame) -> DataFrame:
    """C6, rows of lists of effective pages (J8, J9): doc_id, label, new_revision, is_new, lep_page, lep_y, outcome.

    Changes whose label the list has update its row. In chapters that lack some, the missing labels (as labels of contents pages) and
    then the chapter's old rows fill the chapter's rows in natural order. What goes beyond them, and changes without such a chapter,
    overflow: revision.pack_blank_pages gives them places on blank pages.
    """
    columns = ["doc_id", "label", "new_revision", "is_new", "lep_page", "lep_y", "outcome"]
    updated = stamped.where("lep_page is not null").select("doc_id", "label", "new_revision", F.lit(True).alias("is_new"), "lep_page", "lep_y", F.lit("updated").alias("outcome"))
    label = X.normalize_revision_label(F.col("label"))
    old = entries.select("doc_id", X.chapter_of_label(F.col("label")).alias("chapter"), label.alias("label"), F.col("revision_value").alias("new_revision"), F.col("page_number").alias("lep_page"), F.col("y0").alias("lep_y"))
    old = old.where("chapter is not null and label not like 'TOC %'")
    missing = stamped.where("lep_page is null").select("doc_id", "chapter", "label", "new_revision")
    has_rows = old.select("doc_id", "chapter").distinct()
    new = missing.join(has_rows, ["doc_id", "chapter"], "left_semi").withColumn("natural", X.natural_key(F.col("label"))).withColumn("label", X.toc_label(F.col("label"))).withColumn("is_new", F.lit(True))
    touched = old.join(new.select("doc_id", "chapter").distinct(), ["doc_id", "chapter"], "left_semi").withColumn("natural", X.natural_key(F.col("label"))).withColumn("is_new", F.lit(False))
    place = F.struct("natural", "label").alias("place")
    rows = new.select("doc_id", "chapter", "label", "new_revision", "is_new", place).unionByName(touched.select("doc_id", "chapter", "label", "new_revision", "is_new", place))
    slots = touched.select("doc_id", "chapter", F.struct("natural", "label", "lep_page", "lep_y").alias("slot"))
    filled = revision.fill_slots(slots, rows, ["doc_id", "chapter"]).select("doc_id", "label", "new_revision", "is_new", F.col("slot.lep_page").alias("lep_page"), F.col("slot.lep_y").alias("lep_y"), F.when(F.col("overflow"), "overflow").otherwise("placed").alias("outcome"))
    alone = missing.join(has_rows, ["doc_id", "chapter"], "left_anti").select("doc_id", "label", "new_revision", F.lit(True).alias("is_new"), F.lit(None).cast("int").alias("lep_page"), F.lit(None).cast("double").alias("lep_y"), F.lit("overflow").alias("outcome"))
    return updated.select(*columns).unionByName(filled.select(*columns)).unionByName(alone.select(*columns))


def placed_on_blank_pages(overflow: DataFrame, blank: DataFrame) -> DataFrame:
    """C6 to its end (J10, X29, F12): overflow rows (of effective_rows) to places of the document's blank pages, in natural order of labels.

    blank: doc_id, page_number, page_width, page_height of pages.blank_effective_pages. Pages may hold unlike numbers of rows: a row's place
    among a document's overflow meets the page whose running sum of rows covers it, by one sort. Rows have lep_page, lep_y, label_x, date_x,
    rev_x and outcome `continued`; rows beyond all pages, and of documents without a blank page, stay `overflow` and have no place.
    """
    fits = cells.blank_page_rows(F.col("page_height"))
    slots = blank.select("doc_id", "page_number", fits.alias("in_column"), cells.blank_page_columns(F.col("page_width")).alias("columns"))
    slots = slots.withColumn("_fits", F.col("in_column") * F.size("columns"))
    before = W.partitionBy("doc_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("_i", F.coalesce(F.sum("_fits").over(before), F.lit(0)))
    page = F.struct("page_number", "in_column", "columns", F.col("_i").alias("first"), "_fits")
    natural = W.partitionBy("doc_id").orderBy(X.natural_key(F.col("label")), "label", "new_revision")
    numbered = overflow.withColumn("_i", F.row_number().over(natural) - 1)
    both = numbered.withColumn("_kind", F.lit(1)).unionByName(slots.select("doc_id", "_i", F.lit(0).alias("_kind"), page.alias("_page")), allowMissingColumns=True)
    upto = W.partitionBy("doc_id").orderBy("_i", "_kind").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_p", F.last("_page", ignorenulls=True).over(upto)).where("_kind = 1")
    at = F.col("_i") - F.col("_p.first")
    inside = at < F.col("_p._fits")
    column = F.get("_p.columns", F.floor(at / F.col("_p.in_column")).cast("int"))
    there = lambda c: F.when(inside, c)
    out = met.withColumns({
        "lep_page": there(F.col("_p.page_number")).cast("int"), "lep_y": there(F.lit(cells.BLANK_FIRST_Y) + cells.BLANK_LINE * (at % F.col("_p.in_column"))),
        "label_x": there(column["label_x"]), "date_x": there(column["date_x"]), "rev_x": there(column["rev_x"]),
        "outcome": F.when(inside, "continued").otherwise(F.col("outcome"))})
    return out.drop("_i", "_kind", "_page", "_p")


def revised_lists(changes: DataFrame, words: DataFrame, sizes: DataFrame, revision_value: str | None = None) -> DataFrame:
    """C6 from words to rows of lists of effective pages: stamped changes, rows in their slots, and what overflows on blank pages of the lists.

    changes: doc_id, page_index, page_label, change_type. words: of pages, from 1. sizes: doc_id, page_number, page_width, page_height.
    Columns: of effective_rows, with label_x, date_x and rev_x of rows on blank pages. cell_overwrites makes the edits of it.
    """
    texts = pages.page_texts(words)
    entries = pages.effective_entries(words.join(pages.effective_pages(texts), pages.PAGE, "left_semi"))
    stamped = stamped_changes(changes, entries, pages.current_revisions(words), revision_value)
    placed = effective_rows(stamped, entries)
    blank = pages.blank_effective_pages(texts).join(sizes, ["doc_id", "page_number"])
    rest = placed_on_blank_pages(placed.where("outcome = 'overflow'"), blank)
    return placed.where("outcome != 'overflow'").unionByName(rest, allowMissingColumns=True)


def modes(documents: DataFrame, global_pages: DataFrame, local_pages: DataFrame, items: DataFrame) -> DataFrame:
    """How each document (doc_id) is processed, by the contents pages it has and whether it has item tables."""
    rows = documents.select("doc_id")
    for name, found in (("_global", global_pages), ("_local", local_pages), ("_items", items)):
        rows = rows.join(found.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left")
    both = F.when(F.col("_global") & F.col("_local"), "linked_existing_toc").when(F.col("_global"), "inserted_missing_section_tocs").when(F.col("_local"), "generated_missing_global_toc")
    return rows.select("doc_id", both.when(F.col("_items"), "generated_chapterwise_mel_table_toc").otherwise("generated_layout_toc").alias("mode"))
