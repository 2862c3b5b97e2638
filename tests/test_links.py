"""Contents pages to links, their edits, and the activity stream, on literal rows."""

import json

from leafmill.operators import contents, outline, rows
from leafmill.plans import composite
from leafmill.streaming import activity

WORDS = "doc_id long, page_number int, block_number int, line_number int, word_number int, text string, x0 double, y0 double, x1 double, y1 double"


def words_of(spark, pages):
    """pages: per page (y, [(x, text), ...]) lines."""
    out = []
    for p, lines in enumerate(pages, 1):
        for i, (y, words) in enumerate(lines):
            for x, text in words:
                for w in text.split(" "):
                    out.append((1, p, i, 0, len(out), w, float(x), float(y), x + 5.0, y + 10.0))
                    x += 6
    return spark.createDataFrame(out, WORDS)


PAGES = [
    [(60, [(72, "TABLE OF CONTENTS SECTION - 0")]), (95, [(100, "CHAPTER"), (200, "DESCRIPTION"), (400, "PAGE")]),
     (120, [(100, "21"), (200, "AIR CONDITIONING"), (400, "21-3")]), (140, [(400, "and more")]), (160, [(200, "COVER PAGE")]), (180, [(100, "99")]), (200, [(200, "NOWHERE"), (400, "ZZ-9")]), (770, [(200, "below")])],
    [(50, [(72, "TOC 21-1 ATA 21")]), (100, [(80, "21-52-01"), (150, "Pack valves")]), (115, [(150, "in flight")]), (130, [(80, "left of all")]), (150, [(80, "21-52-02"), (150, "Fans")]), (170, [(150, "TABLE OF CONTENTS")])],
    [(40, [(72, "BOEING 787 ATA 21")]), (200, [(72, "21-52-01 Pack valves")]), (760, [(500, "21-3")])],
]


def test_contents_rows(spark):
    from leafmill.operators.pages import columns, word_lines

    lines = columns(word_lines(words_of(spark, PAGES)).where("page_number = 1"))
    found = [(r.row_number, r.title, r.chapter, r.reference_text, r.rect_x0, r.rect_y0, r.rect_x1, r.rect_y1) for r in rows.contents_rows(lines).orderBy("row_number").collect()]
    assert found == [
        (1, "21 AIR CONDITIONING", "21", "21-3 and more", 96.0, 118.0, 558.0, 153.0),
        (2, "COVER PAGE", "", "", 96.0, 158.0, 558.0, 173.0),
        (3, "NOWHERE", "", "ZZ-9", 96.0, 198.0, 558.0, 213.0),
    ]
    lines = word_lines(words_of(spark, PAGES)).where("page_number = 2")
    found = [(r.label, r.title, r.level, r.rect_y0, r.rect_y1) for r in rows.local_rows(lines).orderBy("row_number").collect()]
    assert found == [("21-52-01", "21-52-01 Pack valves in flight", 2, 98.0, 128.0), ("21-52-02", "21-52-02 Fans", 2, 148.0, 163.0)]


def test_link_plan(spark):
    titles = outline.title_index(spark.createDataFrame([(1, 0, 1, "Something", 2)], "doc_id long, ord int, level int, title string, page_number int"))
    plan = composite.link_plan(words_of(spark, PAGES), titles).cache()
    found = {(r.toc_type, r.title): (r.target_label, r.target_page, r.unresolved_reason) for r in plan.collect()}
    assert found == {
        ("global", "21 AIR CONDITIONING"): ("21-3", 2, None),
        ("global", "COVER PAGE"): (None, 0, None),
        ("global", "NOWHERE"): ("ZZ-9", None, "page_label_or_outline_not_resolved"),
        ("local", "21-52-01 Pack valves in flight"): ("21-52-01", 2, None),
        ("local", "21-52-02 Fans"): ("21-52-02", None, "item_label_not_found_in_body"),
    }
    links = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 3, 0.0, 0.0, 9.0, 9.0), (2, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    edits = composite.link_edits(plan, links).groupBy("doc_id", "page_number", "operation").count().collect()
    assert {tuple(r) for r in edits} == {(1, 1, "delete_link", 1), (1, 1, "insert_link", 2), (1, 2, "insert_link", 1)}
    headings = composite.headings_of_links(plan).collect()
    assert sorted((r.title, r.page, r.source) for r in headings) == [("21 AIR CONDITIONING", 2, "existing_global_toc"), ("21-52-01 Pack valves in flight", 2, "existing_local_toc"), ("COVER PAGE", 0, "existing_global_toc")]


def test_link_plan_with_references(spark):
    """C3 takes reference pages, too: a page of messages names one item of the body and one that isn't there; an image page names one."""
    messages = [(50, [(72, "EICAS MESSAGES MEL ITEM EM-1")]), (300, [(72, "PACK L"), (340, "21-52-01")]), (330, [(72, "FAN"), (340, "21-52-09")])]
    last = [(50, [(72, "EM-3")])]
    words = words_of(spark, [*PAGES, messages, [(300, [(72, "scan")])], last])
    titles = outline.title_index(spark.createDataFrame([(1, 0, 1, "Something", 2)], "doc_id long, ord int, level int, title string, page_number int"))
    kept = lambda plan: {(r.page_number, r.title): (r.target_label, r.target_page, r.unresolved_reason) for r in plan.where("toc_type = 'reference'").collect()}
    of_words = {
        (4, "EICAS reference 21-52-01"): ("21-52-01", 2, None),
        (4, "EICAS reference 21-52-09"): ("21-52-09", None, "eicas_item_not_found_in_body"),
    }
    plan = composite.link_plan(words, titles)
    assert kept(plan) == of_words and plan.where("toc_type != 'reference'").count() == 5
    ocr = spark.createDataFrame([(1, 5, 0, 0, 900, "21-52-01", 340.0, 300.0, 380.0, 310.0)], WORDS)
    coverage = spark.createDataFrame([(1, 5, 0.8), (1, 6, 0.1)], "doc_id long, page_number int, coverage double")
    assert kept(composite.link_plan(words, titles, coverage, ocr)) == of_words | {(5, "EICAS OCR reference 21-52-01"): ("21-52-01", 2, None)}
    # of the links on a reference page, only those beneath a new one go
    links = spark.createDataFrame([(1, 4, 340.0, 300.0, 350.0, 305.0), (1, 4, 0.0, 700.0, 9.0, 709.0), (1, 4, 340.0, 330.0, 350.0, 335.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    edits = composite.link_edits(plan, links).where("page_number = 4").collect()
    assert sorted((r.operation, r.target_page) for r in edits) == [("delete_link", None), ("insert_link", 2)]


def test_rows_on_blank_pages(spark):
    """Two blank pages of 21 and 111 rows, then none; a document without one."""
    rows = [(1, f"33-{i}", "2", i % 2 == 0, None, None, "overflow") for i in range(140)] + [(2, "33-1", "2", True, None, None, "overflow")]
    overflow = spark.createDataFrame(rows, "doc_id long, label string, new_revision string, is_new boolean, lep_page int, lep_y double, outcome string").repartition(5)
    blank = spark.createDataFrame([(1, 9, 612.0, 792.0), (1, 4, 500.0, 400.0)], "doc_id long, page_number int, page_width double, page_height double")
    found = {(r.doc_id, int(r.label[3:])): (r.lep_page, r.lep_y, r.label_x, r.outcome) for r in composite.placed_on_blank_pages(overflow, blank).collect()}
    assert len(found) == 141 and found[2, 1] == (None, None, None, "overflow")
    for i in range(140):
        if i < 21:
            want = (4, 140.0 + 12 * (i % 7), 60.0 + 380 / 3 * (i // 7), "continued")
        elif i < 132:
            want = (9, 140.0 + 12 * ((i - 21) % 37), (80.0, 230.0, 380.0)[(i - 21) // 37], "continued")
        else:
            want = (None, None, None, "overflow")
        assert found[1, i] == want


def test_overlaps(spark):
    of = lambda *x: spark.createDataFrame(x, "page int, x0 double, y0 double, x1 double, y1 double")
    rects = of((1, 0.0, 0.0, 5.0, 5.0), (1, 5.0, 0.0, 6.0, 5.0), (2, 0.0, 0.0, 5.0, 5.0))
    assert [r.x0 for r in contents.overlapping(rects, of((1, 4.0, 4.0, 5.0, 9.0)), ["page"]).collect()] == [0.0]


def test_edits(spark):
    headings = spark.createDataFrame([(1, 1, 0, "A", 1), (1, 2, 3, "B", 2)], "doc_id long, page_number int, line_order int, title string, level int")
    found = composite.contents_edits(composite.front_contents(headings)).orderBy("place").collect()
    assert [(r.operation, r.page, r.x, r.y, r.text, r.target_page) for r in found] == [
        ("insert_page", 1, None, None, None, None),
        ("insert_text", 1, 54.0, 110.0, "A", None), ("insert_link", 1, 54.0, 110.0, None, 2),
        ("insert_text", 1, 72.0, 126.0, "B", None), ("insert_link", 1, 72.0, 126.0, None, 3),
    ]
    placed = spark.createDataFrame([(1, "21-1", "3", 4, 90.0), (1, "21-2", "3", None, None)], "doc_id long, label string, new_revision string, lep_page int, lep_y double")
    assert [tuple(r) for r in composite.cell_overwrites(placed).collect()] == [(1, 4, 90.0, "label", "21-1"), (1, 4, 90.0, "revision", "3")]


def test_activity_stream(spark, tmp_path):
    """Lines that arrive in files, some twice and some late, as a stream that runs to its end."""
    folder = tmp_path / "in"
    folder.mkdir()
    events = [{"id": i, "kind": "ab"[i % 2], "at": f"2024-01-0{1 + i // 4}T00:00:{i:02d}Z"} for i in range(8)]
    for n, some in enumerate((events[:5], events[3:])):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, some)))
    stream = activity.read_activity(spark, str(folder), "id int, kind string, at timestamp", files_at_once=1)

    def ran(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.id for r in ran(activity.unseen(stream, ["id"], "at", "2 days"), "append", "once")) == list(range(8))
    counted = ran(activity.counts(stream, "at", "kind"), "update", "days")
    # the last figure of each window; two events came twice
    assert sum(r.n for r in {(r.start, r.kind): r for r in sorted(counted, key=lambda r: r.n)}.values()) == 10
