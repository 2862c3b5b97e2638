"""What making, inserting or repairing contents would change, without a change to any document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pages
from ..operators.cells import page_label
from ..operators.revision import overflow_risk
from .composite import front_contents

PAGE = ["doc_id", "page_number"]
INSERT, REPAIR, NONE = "insert_missing_section_tocs", "repair_existing_toc_links", "no_reliable_toc_source"
ITEMS, LAYOUT = "mel_table", "layout_detection"


def _flag(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return rows.join(found.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").fillna(False, [name])


def _flags(documents: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """documents (doc_id) with a flag for each table that has rows of it, by one aggregate."""
    every = None
    for name, rows in found.items():
        own = rows.select("doc_id", F.lit(name).alias("_name"))
        every = own if every is None else every.unionByName(own)
    flags = every.groupBy("doc_id").agg(*[F.bool_or(F.col("_name") == name).alias(name) for name in found])
    return documents.join(flags, "doc_id", "left").fillna(False, list(found))


def _page_lists(found: dict[str, DataFrame]) -> DataFrame:
    """Sorted distinct pages of each document in each table, by one aggregate."""
    every = None
    for name, rows in found.items():
        own = rows.select("doc_id", F.lit(name).alias("_name"), "page_number")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("_name") == name, F.col("page_number")))).alias(name) for name in found])


def simulated_links(rows: DataFrame, plans: DataFrame, modes: DataFrame) -> DataFrame:
    """rows (doc_id, page_number, toc_type, target_label, target) of documents that are repaired or get sections, with linked.

    Where sections are inserted, rows of the document's contents that name a planned section's pages are linked, too.
    """
    planned = plans.select("doc_id", F.col("chapter").alias("_chapter"), F.lit(True).alias("_planned")).distinct()
    own = rows.join(modes.where(F.col("mode").isin(INSERT, REPAIR)).select("doc_id", "mode"), "doc_id")
    named = F.when((F.col("mode") == INSERT) & (F.col("toc_type") == "global"), F.nullif(F.regexp_extract("target_label", r"(?i)^TOC ([^-]*)", 1), F.lit("")))
    own = own.withColumn("_chapter", named).join(planned, ["doc_id", "_chapter"], "left")
    return own.withColumn("linked", F.col("target").isNotNull() | F.coalesce("_planned", F.lit(False))).drop("_chapter", "_planned", "mode")


def dry_run(documents: DataFrame, contents_pages: tuple[DataFrame, DataFrame, DataFrame], items: DataFrame, layout: DataFrame, plans: DataFrame, rows: DataFrame, words: DataFrame, track_links: bool = False, fixed_revision: bool = False) -> tuple[DataFrame, DataFrame]:
    """The report of each document (doc_id) and its changed pages.

    contents_pages: the document's contents, chapters' contents and reference pages (PAGE). items, layout: headings (doc_id, page_number,
    line_order, title, level) from item tables and from the layout. plans: sections of composite.section_contents. rows: rows of contents that
    exist, with targets (doc_id, page_number, toc_type, target_label, target). words: of all pages, for page labels and the lists of effective
    pages. track_links: whether pages whose links alone change count as changed. fixed_revision: whether revision and date are given.

    A document without words, headings and contents has a report (mode no_reliable_toc_source) and no changed pages.
    """
    whole, local, reference = contents_pages
    texts = pages.page_texts(words)
    state = _flags(documents.select("doc_id"), {"_global": whole, "_local": local, "_reference": reference, "_items": items, "_layout": layout, "_plans": plans})
    looked = F.col("_global") & ~F.col("_local")
    unknown = ~(F.col("_global") | F.col("_local") | F.col("_reference"))
    mode = F.when(looked & F.col("_plans"), INSERT).when(~unknown, REPAIR).when(F.col("_items"), f"generate_{ITEMS}_toc").when(F.col("_layout"), f"generate_{LAYOUT}_toc").otherwise(NONE)
    source = F.when(looked | (unknown & F.col("_items")), ITEMS).when(unknown, LAYOUT).otherwise("none")
    state = state.withColumns({"mode": mode, "heading_source": source, "unplanned": looked & ~F.col("_plans")})

    links = simulated_links(rows, plans, state)
    counts = links.groupBy("doc_id").agg(F.count_if("linked").alias("linkable_rows"), F.count_if(~F.col("linked")).alias("unresolved_rows"))
    annotated = links.where("linked").select(*PAGE).distinct()

    headings = items.select("doc_id", "page_number", "line_order", "title", "level", F.lit(ITEMS).alias("heading_source")).unionByName(layout.select("doc_id", "page_number", "line_order", "title", "level", F.lit(LAYOUT).alias("heading_source")))
    headings = headings.join(state.select("doc_id", "heading_source", "mode"), ["doc_id", "heading_source"])
    n_headings = headings.groupBy("doc_id").agg(F.count("*").alias("heading_count"))
    front = front_contents(headings.where("startswith(mode, 'generate_')").drop("heading_source", "mode")).groupBy("doc_id").agg(F.max("n_toc_pages").cast("long").alias("n_pages"))

    null = F.lit(None).cast("long")
    numbered = lambda df: df.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pages") - 1)))
    inserted = numbered(plans.join(state.where(F.col("mode") == INSERT).select("doc_id"), "doc_id")).select(
        "doc_id", F.lit("insert_page").alias("change_type"), F.concat(F.lit("TOC "), "chapter", F.lit("-"), (F.col("_i") + 1).cast("string")).alias("page_label"), F.lit("missing_chapter_toc").alias("reason"),
        null.alias("page_number"), (F.col("first_toc_page") + F.col("_i")).cast("long").alias("final_page_number"), F.col("start_page").cast("long").alias("insert_before_page"),
    )
    made = numbered(front).select(
        "doc_id", F.lit("insert_page").alias("change_type"), F.concat(F.lit("TOC-"), (F.col("_i") + 1).cast("string")).alias("page_label"), F.lit("new_front_toc").alias("reason"),
        null.alias("page_number"), (F.col("_i") + 1).alias("final_page_number"), F.lit(1).cast("long").alias("insert_before_page"),
    )
    changes = inserted.unionByName(made)
    if track_links:
        named = annotated.join(texts.select(*PAGE, F.concat_ws(" ", "top_text", "bottom_text").alias("_regions")), PAGE, "left")
        page = F.col("page_number").cast("long")
        changes = changes.unionByName(named.select(
            "doc_id", F.lit("repair_links").alias("change_type"), page_label(F.coalesce("_regions", F.lit("")), F.col("page_number")).alias("page_label"), F.lit("annotation_only_link_repair").alias("reason"),
            page.alias("page_number"), page.alias("final_page_number"), null.alias("insert_before_page"),
        ))

    listed_pages = pages.effective_pages(texts, report=True)
    lines = pages.word_lines(words.join(listed_pages, PAGE, "left_semi"))
    labels = lines.select("doc_id", F.explode(X.reference_labels(F.array_join(F.transform("words", lambda w: w["text"]), " "))).alias("label")).select("doc_id", X.normalize_label(F.col("label")).alias("_label")).distinct()
    n_labels = labels.groupBy("doc_id").agg(F.count("*").alias("lep_labels"))
    listed = changes.withColumn("_label", X.normalize_label(F.col("page_label"))).join(labels.withColumn("_in", F.lit(True)), ["doc_id", "_label"], "left")
    listed = _flag(listed, listed_pages, "_lep").withColumn("lep_action", F.when(~F.col("_lep"), "manual_review_no_lep").when(F.col("_in"), "update_row").otherwise("insert_row"))
    action = "set_revision_and_date" if fixed_revision else "auto_next_chapter_revision_current_month"
    changed = listed.withColumn("revision_action", F.lit(action)).drop("_label", "_in", "_lep")
    sums = changed.groupBy("doc_id").agg(F.count("*").alias("n_changes"), F.count_if(F.col("lep_action") == "update_row").alias("matched_changes"), F.count_if(F.col("lep_action") == "insert_row").alias("missing_changes"), F.count_if(F.col("change_type") == "insert_page").alias("inserted_page_count"))

    report = state.select("doc_id", "mode", "heading_source", "unplanned")
    for part in (n_headings, counts, sums, n_labels):
        report = report.join(part, "doc_id", "left")
    numbers = ["heading_count", "linkable_rows", "unresolved_rows", "n_changes", "matched_changes", "missing_changes", "inserted_page_count", "lep_labels"]
    report = report.fillna(0, numbers)
    lists = {"global_pages": whole, "local_pages": local, "reference_pages": reference, "lep_pages": listed_pages, "annotation_only_pages": annotated}
    report = report.join(_page_lists(lists), "doc_id", "left")
    report = report.withColumns({name: F.coalesce(name, F.expr("cast(array() as array<int>)")) for name in lists})
    has_list, repaired = F.size("lep_pages") > 0, F.col("mode") == REPAIR
    # without a list and without changes nothing needs a review
    risk = overflow_risk(has_list | (F.col("n_changes") == 0), F.col("missing_changes"))
    warnings = {
        "no_section_plan": F.col("unplanned"), "link_changes_not_tracked": repaired & F.lit(not track_links), "unresolved_rows": repaired & (F.col("unresolved_rows") > 0),
        NONE: F.col("mode") == NONE, "no_list_of_effective_pages": ~has_list & (F.col("n_changes") > 0), "many_new_list_rows": has_list & (F.col("missing_changes") > 12),
    }
    report = report.withColumns({
        "safe_to_apply": (F.col("mode") != NONE) & (~repaired | (F.col("linkable_rows") > 0)), "lep_detected": has_list, "overflow_risk": risk,
        "warnings": F.filter(F.array(*[F.when(v, k) for k, v in warnings.items()]), lambda w: w.isNotNull()),
    })
    return report.drop("unplanned"), changed


def rows_or_warnings(rows: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of reference pages of documents all of whose pages could be read, and a warning for each other document.

    failures: doc_id, page_number, error. A document with one such page has no rows; its warning names the first page's error.
    """
    first = failures.groupBy("doc_id").agg(F.min_by("error", F.struct("page_number", "error")).alias("error"))
    says = F.concat(F.lit("EICAS reference dry run skipped because OCR is unavailable or failed: "), F.coalesce("error", F.lit("")))
    return rows.join(first.select("doc_id"), "doc_id", "left_anti"), first.select("doc_id", says.alias("warning"))
