"""Pages, item tables, outlines and whole plans on literal rows."""

from leafmill.operators import items, outline, pages
from leafmill.operators import rows as rows_of_contents
from leafmill.plans import composite

WORDS = "doc_id int, page_number int, block_number int, line_number int, word_number int, text string, x0 double, y0 double, x1 double, y1 double"


def words(spark, *lines, doc=1, height=8.0):
    """lines: page, y, then (x, text) pairs."""
    rows = []
    for i, (page, y, *parts) in enumerate(lines):
        rows += [(doc, page, 0, i, j, t, float(x), float(y), x + 20.0, y + height) for j, (x, t) in enumerate(parts)]
    return spark.createDataFrame(rows, WORDS)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contents_pages(spark):
    head = lambda p, *more: [(p, 60, (50, "TABLE"), (80, "OF"), (90, "CONTENTS"), *more)]
    w = words(spark, *head(2, (200, "TOC-1")), *head(3, (200, "SECTION"), (240, "-"), (250, "0")), *head(5, (200, "TOC-3")), *head(6), (6, 700, (50, "TOC"), (70, "21-1"), (99, "ATA-21")), (7, 60, (9, "ATA"), (20, "-"), (30, "TOC-9")))
    texts = pages.page_texts(w)
    assert got(pages.contents_pages(texts), "page_number") == [(2,), (3,)]
    assert got(pages.local_contents_pages(texts), "page_number") == [(6,)]
    assert got(pages.page_labels(texts, texts.where("page_number = 5").select("doc_id", "page_number")), "label", "page_number")[0] == ("21-1", 6)


def test_reference_pages(spark):
    w = words(spark, (1, 60, (50, "EM-1")), (3, 60, (50, "EM - 3")), (3, 300, (10, "EICAS MESSAGES"), (100, "MEL ITEM"), (340, "21-52-05")))
    coverage = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9)], "doc_id int, page_number int, coverage double")
    assert got(pages.reference_pages(pages.page_texts(w), coverage), "page_number") == [(2,), (3,)]
    lines = pages.word_lines(w)
    assert got(pages.reference_labels(lines), "label") == [("21-52-05",)]
    split = pages.word_lines(words(spark, (1, 100, (310, "see"), (330, "21-"), (350, "52"), (370, "-05")), (1, 200, (10, "21-52-06"))))
    assert got(pages.reference_labels(split), "label", "anchor.text") == [("21-52-05", "21-")]


def test_effective_pages(spark):
    w = words(spark, (1, 60, (50, "EFFECTIVE PAGES DATE")), (2, 60, (50, "List of Effective Pages intentionally left blank")), (3, 60, (50, "effective pages rev")))
    texts = pages.page_texts(w)
    assert got(pages.effective_pages(texts), "page_number") == [(2,), (3,)] and got(pages.effective_pages(texts, report=True), "page_number") == [(1,), (2,), (3,)]
    assert got(pages.blank_effective_pages(texts), "page_number") == [(2,)]
    line = words(spark, (1, 60, *[(40 * i, t) for i, t in enumerate("x TOC 21-1 JAN 2 2020 3A 21-2 4 FEB 5 21-3 none EM-1 R2".split())]))
    assert got(pages.effective_entries(line), "label", "date_value", "revision_value") == [("21-2", "4 FEB", "5"), ("EM-1", "", "R2"), ("TOC 21-1", "JAN 2 2020", "3A")]


def test_rejects_and_columns(spark):
    rows = spark.createDataFrame([("Table of Contents",), ("TOC 3",), ("Rev 4",), ("TOC 21-1",), ("Wings",)], "v string")
    assert [tuple(r) for r in rows.select(pages.is_contents_header(rows.v), pages.is_local_header(rows.v), pages.is_linkable(rows.v)).collect()] == [(True, True, True), (True, False, True), (False, True, True), (False, True, True), (False, False, True)]
    line = pages.columns(pages.word_lines(words(spark, (1, 100, (50, "21"), (200, "AIR"), (250, "COND"), (400, "TOC 21-1")))))
    assert got(line, "chapter", "description", "reference") == [("21", "AIR COND", "TOC 21-1")]


def test_item_labels(spark):
    w = words(spark, (4, 60, (50, "ATA-21")), (4, 100, (50, "21-00-01"), (200, "Pack")), (4, 120, (50, "21"), (70, "-")), (4, 130, (50, "52-05"), (200, "Duct")), (4, 140, (50, "22-00-01")), (4, 150, (50, "ASSOCIATED"), (70, "STATUS MESSAGE")), (4, 160, (50, "21-00-09")), (5, 60, (50, "ATA 21")), (5, 200, (50, "21-00-01")))
    texts = pages.page_texts(w)
    none = texts.where("false").select("doc_id", "page_number")
    assert got(pages.item_labels(pages.word_lines(w), texts, none), "label", "page_number", "y") == [("21-00-01", 4, 76.0), ("21-52-05", 4, 106.0)]
    anchors = pages.reference_labels(pages.word_lines(words(spark, (1, 100, (50, "a"), (320, "21-00-01"))))).withColumnRenamed("label", "target")
    assert got(pages.row_rects(anchors, words(spark, (1, 100, (50, "a"), (320, "21-00-01")))), "target", "x0", "y0", "x1", "y1") == [("21-00-01", 46.0, 98.0, 346.0, 111.0)]


def test_items(spark):
    w = words(
        spark, (1, 60, (50, "ATA"), (70, "21")), (1, 90, (50, "ITEM"), (150, "DESCRIPTION"), (400, "REMARKS")),
        (1, 110, (50, "21-52-05"), (150, "Condenser Inlet"), (240, "C"), (300, "2")), (1, 125, (150, "Temperature Control")), (1, 140, (150, "systems")), (1, 155, (150, "(Cont'd)")), (1, 165, (50, "22-00-01")),
        (1, 400, (300, "late")), (1, 410, (150, "lost")), (1, 420, (50, "21-52-05-02"), (150, "Sensor")), (1, 450, (50, "NOTE")), (1, 470, (50, "21-52-09"), (150, "Gone")),
        (2, 90, (60, "ATA 21")), (2, 110, (50, "21-52-05"), (150, "Again")), (2, 130, (50, "21-60-01"), (150, "Fan")),
    )
    found = items.headings(pages.word_lines(w), pages.page_texts(w))
    assert got(found, "page_number", "title", "level", "y0") == [(1, "21-52-05 Condenser Inlet Temperature Control systems (Cont'd)", 1, 86.0), (1, "21-52-05-02 Sensor", 2, 396.0), (2, "21-60-01 Fan", 1, 106.0)]
    assert items.headings(pages.word_lines(w.where("false")), pages.page_texts(w.where("false"))).count() == 0


def test_outlines(spark):
    source = spark.createDataFrame([(1, 0, 1, "A", 3), (1, 1, 2, "a", 4), (1, 2, 1, "A again", 3), (1, 3, 1, "B", 9), (1, 4, 2, "b", 9), (1, 5, 1, "bad", 0)], "doc_id int, ord int, level int, title string, page_number int")
    rows = spark.createDataFrame([(1, 0, "global", "G", 5, 0.0, 1), (1, 1, "local", "x", 1, 0.0, 2), (1, 2, "local", "y", 4, 0.0, 5), (1, 3, "local", "z", 6, 0.0, 3), (1, 4, "reference", "r", 7, 0.0, 3), (1, 5, "local", "w", None, 0.0, 3)], "doc_id int, ord int, toc_type string, title string, target_page int, target_y double, level int")
    tops = outline.roots(source, rows)
    assert got(tops, "page", "title") == [(3, "A"), (5, "G"), (9, "B")]
    assert got(outline.from_roots(tops, rows), "root_page", "level", "title", "page") == [(3, 1, "A", 3), (3, 2, "y", 4), (5, 1, "G", 5), (5, 2, "z", 6), (9, 1, "B", 9)]
    assert got(outline.from_rows(rows), "page", "level", "title") == [(1, 1, "x"), (4, 2, "y"), (5, 1, "G"), (6, 2, "z")]
    plans = spark.createDataFrame([(1, 9, "787_21"), (2, 4, "787_22")], "doc_id int, start_page int, title string")
    own = spark.createDataFrame([(1, 9, 0, 3, "h", 10), (1, 9, 1, 3, "i", 11)], "doc_id int, start_page int, ord int, level int, title string, page int")
    found = outline.with_sections(source, plans, own)
    assert [r[-2:] for r in got(found, "doc_id", "ord", "sub", "level", "title")] == [(1, "A"), (2, "a"), (1, "A again"), (1, "787_21"), (2, "h"), (3, "i"), (1, "787_22")]
    titles = spark.createDataFrame([("787_21", "787_21_air", "t"), ("787_21", None, "t"), (None, None, "t")], "p string, o string, f string")
    assert [r[0] for r in titles.select(outline.section_title(titles.p, titles.o, titles.f)).collect()] == ["787_21_air", "787_21", "t"]


def test_links(spark):
    source = spark.createDataFrame([(1, 0, 1, "MEL Approval Letter", 2), (1, 1, 1, "LEP 1", 4), (1, 2, 1, "787 Wings", 8)], "doc_id int, ord int, level int, title string, page_number int")
    labels = spark.createDataFrame([(1, "TOC 21-1", 20)], "doc_id int, label string, page_number int")
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate([("Air", "21", ""), ("Wings", "57", "TOC 57-1"), ("Wings", "5", ""), ("DGCA Approval Letter", "", ""), ("List of Effective Pages", "", ""), ("Cover page", "", ""), ("Other", "", ""), ("Description Page", "", "")])], "doc_id int, ord int, title string, chapter string, reference_text string")
    found = composite.linked_global_rows(rows, labels, outline.title_index(source))
    assert got(found, "ord", "target") == [(0, 20), (1, None), (2, 7), (3, 1), (4, 3), (5, 0), (6, None)]
    assert found.where("unresolved_reason is not null").count() == 2


def test_chosen_headings(spark):
    a = spark.createDataFrame([(1, "item")], "doc_id int, title string")
    b = spark.createDataFrame([(1, "layout"), (2, "layout")], "doc_id int, title string")
    assert got(composite.chosen_headings(a, b), "doc_id", "title") == [(1, "item"), (2, "layout")]


def test_section_contents(spark):
    source = spark.createDataFrame([(1, 0, 1, "787 21 Air", 3), (1, 1, 1, "787 22 Flight", 10), (1, 2, 1, "Other", 12), (1, 3, 1, "787 23 None", 20)], "doc_id int, ord int, level int, title string, page_number int")
    w = words(spark, (3, 100, (50, "ITEM")), (3, 760, (50, "foot")), (12, 100, (50, "x")))
    roots = outline.section_roots(source, pages.page_texts(w))
    assert got(roots, "page", "chapter", "title") == [(3, "21", "787_21_air"), (10, "22", "787_22_flight"), (20, "23", "787_23_none")]
    heads = spark.createDataFrame([(1, 4 + i // 20, float(i), f"21-{i:02}-01", 1) for i in range(60)] + [(1, 5, 99.0, "22-00-01", 1), (1, 15, 1.0, "22-00-02", 1), (1, 1, 0.0, "21-99-01", 1)], "doc_id int, page int, y0 double, title string, level int")
    plans, entries = composite.section_contents(roots, heads, spark.createDataFrame([(1, 30)], "doc_id int, last_page int"), pages.bodies(w))
    # the first page holds 37 entries from 139 on, to 738 at most
    assert got(plans, "start_page", "end_page", "n_pages", "n_entries", "first_toc_page", "first_label") == [(3, 9, 2, 60, 3, "TOC 21-1"), (10, 19, 1, 1, 12, "TOC 22-1")]
    found = {r[0]: r[1:] for r in got(entries, "title", "toc_page", "toc_y", "final_page")}
    assert found["21-00-01"] == (1, 139.0, 6) and found["21-36-01"] == (1, 715.0, 7) and found["21-37-01"] == (2, 111.0, 7) and found["22-00-02"] == (1, 155.0, 18)


def test_stamped_changes(spark):
    w = words(spark, (1, 60, (50, "REV"), (80, "x"), (90, "Rev-4a")), (2, 60, (50, "REV:"), (80, "7")), (3, 300, (50, "REV"), (80, "9")))
    assert got(pages.current_revisions(w), "page_number", "current") == [(1, "4A"), (2, "7")]
    listed = pages.effective_entries(words(spark, (8, 60, (50, "21-1"), (90, "JAN"), (120, "3")), (9, 60, (50, "21-1"), (90, "FEB"), (120, "5"))))
    changes = spark.createDataFrame([(1, 0, "21-9", "a"), (1, 0, "21 - 9", "b"), (1, 4, "21-1", "a"), (1, 5, "30-1", "a")], "doc_id int, page_index int, page_label string, change_type string")
    found = composite.stamped_changes(changes, listed, pages.current_revisions(w))
    assert got(found, "page_index", "label", "new_revision", "lep_page") == [(0, "21-9", "5A", None), (4, "21-1", "6", 9), (5, "30-1", "1", None)]
    assert {r.new_revision for r in composite.stamped_changes(changes, listed, pages.current_revisions(w), "Rev-8").collect()} == {"8"}


def test_effective_rows(spark):
    entries = spark.createDataFrame([(1, "21-2", "3", 8, 60.0), (1, "21-10", "3", 8, 70.0), (1, "TOC 21-1", "1", 8, 50.0), (1, "22-1", "5", 9, 60.0)], "doc_id int, label string, revision_value string, page_number int, y0 double")
    stamped = spark.createDataFrame([(1, "21", "21-30", "4", None, None), (1, "22", "22-1", "6", 9, 60.0), (1, "33", "33-1", "1", None, None), (1, None, "X", "1", None, None)], "doc_id int, chapter string, label string, new_revision string, lep_page int, lep_y double")
    found = composite.effective_rows(stamped, entries)
    assert sorted(map(str, got(found, "label", "new_revision", "is_new", "lep_y", "outcome"))) == sorted(map(str, [
        ("22-1", "6", True, 60.0, "updated"), ("TOC 21-30", "4", True, 60.0, "placed"), ("21-2", "3", False, 70.0, "placed"), ("21-10", "3", False, None, "overflow"), ("33-1", "1", True, None, "overflow"), ("X", "1", True, None, "overflow"),
    ]))


def test_modes(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc_id int")
    assert [m for _, m in got(composite.modes(ids(1, 2, 3, 4, 5), ids(1, 2, 1), ids(1, 3), ids(4, 1)), "doc_id", "mode")] == ["linked_existing_toc", "inserted_missing_section_tocs", "generated_missing_global_toc", "generated_chapterwise_mel_table_toc", "generated_layout_toc"]


def test_xml_pages(spark, tmp_path):
    from leafmill.sources import xml_pages

    spans = spark.createDataFrame([(1, 1, 0, 0, 1, "b & c", "Arial-Bold", 10.5, 16, 255, 5.0, 1.0, 9.0, 2.0), (1, 1, 0, 0, 0, "a <x>", "Arial", 10.0, 0, 0, 1.0, 1.0, 5.0, 2.0), (1, 1, 0, 1, 0, "d", "Arial", 10.0, 0, 0, 1.0, 3.0, 5.0, 4.25)], "doc_id int, page_number int, block_number int, line_number int, span_number int, text string, font string, size double, flags int, color int, x0 double, y0 double, x1 double, y1 double")
    info = spark.createDataFrame([(1, 1, 612.0, 792.0, 0), (1, 2, 612.0, 792.0, 90)], "doc_id int, page_number int, width double, height double, rotation int")
    trees = xml_pages.page_trees(spans, info)
    xml_pages.write_pages(trees, f"{tmp_path}/pages")
    back = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False).schema(trees.schema).load(f"{tmp_path}/pages").orderBy("_number").collect()
    assert [s["_VALUE"] for line in back[0].block[0].line for s in line.span] == ["a <x>", "b & c", "d"]
    assert back[0].block[0]["_y1"] == "4.25" and back[0].block[0].line[0].span[1]["_color"] == "#0000ff" and back[0].block[0].line[0].span[1]["_bold"] == "true" and back[1]["_rotation"] == 90


def test_reference_rows(spark):
    # page 3: a row over two of the extractor's lines and one above the zone; page 4: no row and eight words at most, read from its image; page 5: no image
    w = words(spark, (3, 80, (310, "21-00-09")), (3, 300, (10, "LEAK"), (60, "L")), (3, 302, (340, "21-52-05")), (3, 400, (310, "see"), (330, "21-"), (350, "52"), (370, "-06")), (4, 300, (10, "none")), (5, 300, (10, "none")))
    only = spark.createDataFrame([(1, 3), (1, 4), (1, 5)], "doc_id int, page_number int")
    rows = rows_of_contents.reference_rows(w, only)
    assert got(rows, "page_number", "row_number", "title", "label", "rect_x0", "rect_y0", "rect_x1", "rect_y1") == [
        (3, 1, "EICAS reference 21-52-05", "21-52-05", 56.0, 298.0, 366.0, 313.0), (3, 2, "EICAS reference 21-52-06", "21-52-06", 306.0, 398.0, 396.0, 411.0),
    ]
    ocr = words(spark, (3, 500, (340, "21-52-07")), (4, 300, (340, "21-52-08")), (5, 300, (340, "21-52-09")))
    coverage = spark.createDataFrame([(1, 3, 0.9), (1, 4, 0.9), (1, 5, 0.1)], "doc_id int, page_number int, coverage double")
    more = rows_of_contents.reference_rows(w, only, ocr, coverage)
    assert got(more, "page_number", "title") == [(3, "EICAS reference 21-52-05"), (3, "EICAS reference 21-52-06"), (4, "EICAS OCR reference 21-52-08")]
