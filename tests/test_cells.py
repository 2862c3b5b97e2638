"""Cells of ruled tables, the dry run of contents, and reports, on literal rows."""

from leafmill.operators import cells
from leafmill.plans import dry_run
from leafmill.sources.layout import segments
from pyspark.sql import functions as F
from test_documents import got, words

DRAWINGS = "doc_id int, page_number int, kind string, x0 double, y0 double, x1 double, y1 double"


def grid(spark, xs, y0, y1, page=1):
    rows = [(1, page, "l", float(x), float(y0), float(x), float(y1)) for x in xs] + [(1, page, "l", float(xs[0]), float(y), float(xs[-1]), float(y)) for y in (y0, y1)]
    return segments(spark.createDataFrame(rows, DRAWINGS))


def test_segments(spark):
    rows = spark.createDataFrame([(1, 1, "l", 10.0, 0.0, 10.4, 20.0), (1, 1, "re", 10.0, 5.0, 10.4, 20.0), (1, 1, "l", 0.0, 7.0, 9.0, 7.0), (1, 1, "re", 0.0, 0.0, 50.0, 50.0), (1, 1, None, 1.0, 2.0, 30.0, 5.0)], DRAWINGS)
    assert got(segments(rows), "segment", "x0", "y0", "x1", "y1") == [("horizontal", 0.0, 6.5, 9.0, 7.5), ("horizontal", 1.0, 2.0, 30.0, 5.0), ("vertical", 9.5, 0.0, 10.9, 20.0), ("vertical", 10.0, 5.0, 10.4, 20.0)]


def test_ruled_header(spark):
    w = words(spark, (1, 42, (105, "ISSUE"), (205, "REV"), (230, "3"), (305, "APR"), (330, "2026")), (1, 300, (10, "REV")))
    row = cells.header_cells(w, grid(spark, [100, 200, 300, 400], 38, 56)).first()
    assert row.ruled and tuple(row.issue) == (100.0, 37.5, 200.0, 56.5) and tuple(row.rev) == (200.0, 37.5, 300.0, 56.5) and tuple(row.date) == (300.0, 37.5, 400.0, 56.5)
    assert abs(row.font_size - 19 * 0.48) < 1e-9
    # without a date, the next cell; without ISSUE, the cell before
    w = words(spark, (1, 42, (205, "REV-3A")))
    row = cells.header_cells(w, grid(spark, [150, 200, 230, 300], 38, 56)).first()
    assert row.ruled and row.date.x0 == 230 and row.date.x1 == 300 and row.issue.x0 == 150


def test_loose_header(spark):
    none = grid(spark, [0, 9], 600, 620)
    row = cells.header_cells(words(spark, (1, 42, (205, "Rev"), (240, "x"), (305, "APR"), (330, "2026."), (360, "2027"))), none).first()
    assert not row.ruled and row.issue is None and tuple(row.rev) == (203.5, 40.5, 239.5, 52.5) and tuple(row.date) == (303.5, 40.5, 352.5, 52.5)
    row = cells.header_cells(words(spark, (1, 42, (205, "REV"))), none).first()
    assert tuple(row.rev) == (203.5, 40.5, 241.5, 52.5) and tuple(row.date) == (245.5, 40.5, 319.5, 52.5) and row.font_size == 7.0
    assert cells.header_cells(words(spark, (1, 42, (205, "REF")), (1, 300, (5, "REV"))), none).isEmpty()


def test_date_words(spark):
    texts = [["x", "APR", "2026", "MAY"], ["2026", "APR", "JUN", "JUL"], ["APR", "x", "2026"], ["x"], []]
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    found = rows.select(F.array_join(F.transform(cells.date_words(F.transform("t", lambda x: F.struct(x.alias("text")))), lambda w: w["text"]), " ").alias("d")).collect()
    assert [r.d for r in found] == ["APR 2026", "2026 APR JUN", "APR", "", ""]


def test_effective_cells(spark):
    rows = spark.createDataFrame([(1, 1, (62.0, 102.0, 90.0, 110.0), None, (205.0, 102.0, 212.0, 110.0)), (1, 2, (62.0, 102.0, 90.0, 110.0), None, (205.0, 102.0, 212.0, 110.0))], f"doc_id int, page_number int, label_text {cells._BOX}, date_text {cells._BOX}, rev_text {cells._BOX}")
    found = cells.effective_cells(rows, grid(spark, [60, 98, 200, 230], 100, 114)).orderBy("page_number").collect()
    assert tuple(found[0].label_cell) == (60.0, 99.5, 98.0, 114.5) and tuple(found[0].date_cell) == (98.0, 99.5, 200.0, 114.5) and tuple(found[0].rev_cell) == (200.0, 99.5, 230.0, 114.5)
    assert found[1].label_cell is None and found[1].rev_cell is None


def test_blank_pages(spark):
    rows = spark.createDataFrame([(612.0, 792.0), (420.0, 300.0)], "w double, h double")
    found = rows.select(cells.blank_page_rows(F.col("h")).alias("n"), cells.blank_page_columns(F.col("w")).alias("c")).collect()
    assert [r.n for r in found] == [37, 1] and [tuple(c) for c in found[0].c] == [(80.0, 142.0, 202.0), (230.0, 292.0, 352.0), (380.0, 442.0, 502.0)]
    assert [tuple(c) for c in found[1].c] == [(60.0, 102.0, 160.0), (180.0, 222.0, 280.0), (300.0, 342.0, 400.0)]


def test_dry_run(spark):
    page = lambda *p: spark.createDataFrame(list(p), "doc_id int, page_number int")
    heads = lambda *d: spark.createDataFrame([(x, 3, i, f"21-00-0{i} x", 1) for x in d for i in range(2)], "doc_id int, page_number int, line_order int, title string, level int")
    documents = spark.createDataFrame([(x,) for x in range(1, 7)], "doc_id int")
    plans = spark.createDataFrame([(1, "21", 5, 2, 5), (1, "22", 9, 1, 11), (4, "21", 5, 1, 5)], "doc_id int, chapter string, start_page int, n_pages long, first_toc_page long")
    rows = spark.createDataFrame([(1, 1, "global", "TOC 21-1", None), (1, 2, "global", "TOC 23-1", None), (1, 2, "reference", "21-00-01", 4), (2, 1, "global", "TOC 21-1", 7), (2, 3, "local", "21-00-09", None), (4, 1, "local", "x", None), (6, 1, "global", "x", 3)], "doc_id int, page_number int, toc_type string, target_label string, target int")
    w = words(spark, (2, 30, (50, "TOC 22-1")), (8, 60, (50, "LIST OF EFFECTIVE PAGES")), (8, 80, (50, "TOC 21-1"), (150, "EM-2"))).unionByName(words(spark, (1, 60, (50, "21-3")), doc=2))
    run = lambda **o: dry_run.dry_run(documents, (page((1, 1), (1, 2), (2, 1), (4, 1)), page((2, 3), (4, 1)), page()), heads(1, 3), heads(3, 5), plans, rows, w, **o)
    report, changes = run(track_links=True)
    assert got(report, "doc_id", "mode", "safe_to_apply") == [(1, dry_run.INSERT, True), (2, dry_run.REPAIR, True), (3, "generate_mel_table_toc", True), (4, dry_run.REPAIR, False), (5, "generate_layout_detection_toc", True), (6, dry_run.NONE, False)]
    assert got(report, "doc_id", "linkable_rows", "unresolved_rows", "inserted_page_count", "heading_source") == [(1, 2, 1, 3, "mel_table"), (2, 1, 1, 0, "none"), (3, 0, 0, 1, "mel_table"), (4, 0, 1, 0, "none"), (5, 0, 0, 1, "layout_detection"), (6, 0, 0, 0, "layout_detection")]
    assert got(changes.where("doc_id = 1"), "page_label", "final_page_number", "lep_action") == [("PDF page 1", 1, "insert_row"), ("TOC 21-1", 5, "update_row"), ("TOC 21-2", 6, "insert_row"), ("TOC 22-1", 2, "insert_row"), ("TOC 22-1", 11, "insert_row")]
    assert got(changes.where("doc_id > 1"), "doc_id", "page_label", "insert_before_page", "lep_action") == [(2, "21-3", None, "manual_review_no_lep"), (3, "TOC-1", 1, "manual_review_no_lep"), (5, "TOC-1", 1, "manual_review_no_lep")]
    first = {r.doc_id: r for r in report.collect()}
    assert first[1].annotation_only_pages == [1, 2] and first[1].overflow_risk == "medium" and first[1].lep_labels == 3 and first[2].overflow_risk == "manual_review" and first[6].overflow_risk == "low"
    assert first[2].warnings == ["unresolved_rows", "no_list_of_effective_pages"] and first[6].warnings == [dry_run.NONE]
    report, changes = run()
    assert changes.where("change_type = 'repair_links'").isEmpty() and report.where("doc_id = 2").first().overflow_risk == "low"


def test_xml_links_and_metadata(spark, tmp_path):
    from leafmill.sources import xml_pages

    spans = spark.createDataFrame([(1, 1, 0, 0, 0, "a", "Arial", 10.0, 0, 0, 1.0, 1.0, 5.0, 2.0)], "doc_id int, page_number int, block_number int, line_number int, span_number int, text string, font string, size double, flags int, color int, x0 double, y0 double, x1 double, y1 double")
    info = spark.createDataFrame([(1, 1, 612.0, 792.0, 0), (1, 2, 612.0, 792.0, 0)], "doc_id int, page_number int, width double, height double, rotation int")
    links = spark.createDataFrame([(1, 1, 5, 2, None, "http://x.y/?a&b", 1.0, 2.0, 3.0, 4.5), (1, 1, 3, 1, 7, None, 1.0, 2.0, 3.0, 4.0)], "doc_id int, page_number int, ord int, kind int, target_page int, uri string, x0 double, y0 double, x1 double, y1 double")
    notes = spark.createDataFrame([(1, 2, 0, "Text", None, 1.0, 2.0, 3.0, 4.0)], "doc_id int, page_number int, ord int, type string, content string, x0 double, y0 double, x1 double, y1 double")
    trees = xml_pages.page_trees(spans, info, links, notes)
    xml_pages.write_pages(trees, f"{tmp_path}/pages")
    back = spark.read.format("xml").option("rowTag", "page").schema(trees.schema).load(f"{tmp_path}/pages").orderBy("_number").collect()
    assert [(x["_index"], x["_kind"], x["_target_page"], x["_uri"], x["_y1"]) for x in back[0].links.link] == [("0", "1", "7", None, "4"), ("1", "2", None, "http://x.y/?a&b", "4.5")]
    assert back[0].annotations is None and back[1].links is None and back[1].annotations.annotation[0]["_type"] == "Text"
    metadata = xml_pages.metadata_trees(spark.createDataFrame([(1, "title", "A & B"), (1, "author", ""), (1, "other", "x"), (2, "format", "PDF 1.7")], "doc_id int, key string, value string"))
    xml_pages.write_metadata(metadata, f"{tmp_path}/metadata")
    back = spark.read.format("xml").option("rowTag", "metadata").schema(metadata.schema).load(f"{tmp_path}/metadata").orderBy("_doc_id").collect()
    assert [(r.title, r.author, r.format) for r in back] == [("A & B", None, None), (None, None, "PDF 1.7")]


def test_process_report(spark):
    from leafmill.operators import catalog

    reports = spark.createDataFrame([("d", "a.pdf", "m", 3)], "document_id string, source_filename string, mode string, linked int")
    assert got(catalog.process_summary(reports, ["linked"]).where("place > 0"), "place", "field", "value") == [(1, "document_id", "d"), (2, "source_filename", "a.pdf"), (3, "mode", "m"), (4, "linked", "3")]
    rows = spark.createDataFrame([("d", 2, "global", None, None, "T", "r", "21", None), ("d", 2, "local", "x", "why", "T", "r", "21", None), ("d", 3, "local", "x", None, "T", "r", "21", 4)], "document_id string, page_number int, toc_type string, target_label string, unresolved_reason string, title string, reference_text string, chapter string, target_page int")
    assert got(catalog.unresolved_links(rows), "toc_page", "target_label", "unresolved_reason") == [(2, "", "target_not_found"), (2, "x", "why")]
