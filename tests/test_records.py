"""Stored records, process reports, sorting, lists of pages: literal rows and round trips."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import contents, layout
from leafmill.plans import dry_run
from leafmill.queries import QUERIES
from leafmill.sources import records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sort_key(spark):
    names = ["b2", "B10", "b 1", "Ä", "a0", "b02", "", None, "az", "É9", "e10", "e" + "9" * 30, "e1" + "0" * 30]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.sort_key(F.col("n")), "n").collect()
    assert [r.n for r in got] == [None, "", "Ä", "a0", "az", "b 1", "b02", "b2", "B10", "É9", "e10", "e" + "9" * 30, "e1" + "0" * 30]


def test_json(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string").select(X.dumped("a", "b").alias("j"))
    assert df.collect()[0].j == '{"a":1,"b":null}'
    back = df.select(X.loaded(F.col("j"), "a int, b string").alias("r"), X.json_field(F.col("j"), "a").alias("a"), X.json_field(F.col("j"), "c").alias("c"))
    assert [(r.r.a, r.r.b, r.a, r.c) for r in back.collect()] == [(1, None, "1", None)]
    bad = spark.createDataFrame([("[1]",), ("{",), (None,)], "j string")
    assert all(r.r is None or r.r.a is None for r in bad.select(X.loaded(F.col("j"), "a int").alias("r")).collect())


def test_stored(spark, tmp_path):
    (tmp_path / "d 1_toc.json").write_text('[{"title": "A", "page": 1}, {"title": "B", "page": 2}]')
    (tmp_path / "e_xml_stats.json").write_text('{"page_count": 3}')
    got = records.read_stored(spark, str(tmp_path), "_toc", "array<struct<title: string, page: int>>").select("document_id", F.explode("data").alias("h")).select("document_id", "h.*")
    assert rows(got) == [("d 1", "A", 1), ("d 1", "B", 2)]
    assert rows(records.read_stored(spark, str(tmp_path), "_xml_stats", "struct<page_count: int>").select("document_id", "data.page_count")) == [("e", 3)]
    (tmp_path / "f_xml_stats.json").write_text("[1]")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.read_stored(spark, str(tmp_path), "_xml_stats", "struct<page_count: int>").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_stored(spark, str(tmp_path / "none"), "_toc", "array<struct<title: string>>")


def test_appended(spark, tmp_path):
    schema = "event_id string, message string"
    for i in (1, 2):
        records.append_activity(spark.createDataFrame([(str(i), None)], schema), str(tmp_path / "log"))
    assert rows(records.read_activity(spark, str(tmp_path / "log"), schema)) == [("1", None), ("2", None)]
    for i in (1, 2):
        records.save_records(spark.createDataFrame([(str(i), "x")], schema), str(tmp_path / "index"))
    assert rows(records.read_index(spark, str(tmp_path / "index"), schema).select("event_id")) == [("2",)]


def test_saved(spark):
    known = spark.createDataFrame([("a", "a.pdf", "processing", "old", None, None, None), ("b", "b.pdf", "queued", "bad", "l0", None, None)], "document_id string, original_filename string, status string, error string, process_log_path string, xml_path string, xml_stats_path string")
    new = spark.createDataFrame([("a", "xml", "x", "s"), ("b", "process_log", "l", None), ("a", "toc", "t", None), ("c", "toc", "t", None), ("c", "xml", "x", "s"), ("c", "xml_stats", "s", None)], "document_id string, kind string, path string, stats_path string")
    after, activity = records.saved(known, new)
    assert rows(after) == [("a", "a.pdf", "ready", None, None, "x", "s"), ("b", "b.pdf", "queued", "bad", "l", None, None)]
    assert rows(activity.select("document_id", "action", "status", "message")) == [
        ("a", "toc_saved", "success", "Saved TOC data for a.pdf."), ("a", "xml_conversion_ready", "success", "XML conversion ready for a.pdf."),
        ("b", "process_log_saved", "info", "Saved process diagnostics log for b.pdf."), ("c", "toc_saved", "warning", "Saved TOC data for missing document c."),
        ("c", "xml_stats_saved", "success", "Saved XML statistics for document c."),
    ]


def test_reports(spark, tmp_path):
    fields = spark.createDataFrame([("a", 0, "mode", "toc"), ("a", 1, None, None), ("a", 2, "n", None), ("a", 30, "late", "x"), ("b", 0, "mode", "xml")], "document_id string, place int, field string, value string")
    texts = spark.createDataFrame([("b", "kept"), ("c", "")], "document_id string, text string")
    assert rows(records.report_previews(texts, fields)) == [("a", "mode: toc\nn: None"), ("b", "kept"), ("c", "")]
    lost = spark.createDataFrame([("b", 0, 7, "global", "", None), ("b", 1, None, "local", "21-1", "why")], "document_id string, place long, toc_page int, toc_type string, target_label string, unresolved_reason string")
    lines = records.report_lines(fields.where("document_id = 'b' or place = 0"), lost)
    records.write_reports(lines, str(tmp_path / "r"))
    text = lambda d: "".join(p.read_text() for p in (tmp_path / "r" / f"document_id={d}").glob("*.txt"))
    assert text("a") == "mode: toc\n\nUnresolved rows:\nNone\n"
    assert text("b") == "mode: xml\n\nUnresolved rows:\n- toc_page=7, toc_type=global, label=-, reason=target_not_found\n- toc_page=None, toc_type=local, label=21-1, reason=why\n"
    started = records.started_lines(spark.createDataFrame([("a", "a.pdf", None)], "document_id string, source_filename string, mode string")).orderBy("place").collect()
    assert [r.line for r in started][1:] == ["document_id: a", "source_filename: a.pdf", "mode: None", "status: processing_started"] and started[0].line.startswith("timestamp_utc: 20")


def test_listed_lines(spark):
    # the second word opens a line of its own; the third joins the first line it fits, whose mean moves to 101.5; the last no longer fits there
    words = [(0, "a", 5.0, 100.0), (1, "b", 1.0, 106.0), (2, "c", 1.0, 103.0), (3, " ", 1.0, 100.0), (4, "high", 1.0, 84.0), (5, "low", 1.0, 601.0), (6, "d", 9.0, 97.4), (7, "e", 0.0, 90.0)]
    df = spark.createDataFrame([(1, 1, n, t, x, y, y + 8, 792.0) for n, t, x, y in words], "doc_id int, page_number int, word_number int, text string, x0 double, y0 double, y1 double, page_height double")
    assert rows(layout.listed_lines(df).select("word_number", "text", "visual_line")) == [(0, "a", 2), (1, "b", 3), (2, "c", 2), (6, "d", 1), (7, "e", 0)]


def test_tolerance(spark):
    found = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, v string")
    failures = spark.createDataFrame([(2, 9, "late"), (2, 3, "first"), (3, 1, None)], "doc_id int, page_number int, error string")
    good, warnings = dry_run.rows_or_warnings(found, failures)
    assert rows(good) == [(1, "x")]
    says = "EICAS reference dry run skipped because OCR is unavailable or failed: "
    assert rows(warnings) == [(2, says + "first"), (3, says)]


def test_row_records(spark):
    df = spark.createDataFrame([(1, "T", 2, "r", "global", "21-1", None, "why", 5)], "doc_id int, title string, page_number int, reference_text string, toc_type string, target_label string, target_page_number int, unresolved_reason string, more int")
    assert contents.row_records(df).collect()[0].asDict() == {"doc_id": 1, "title": "T", "toc_page": 2, "reference_text": "r", "toc_type": "global", "target_label": "21-1", "target_page": None, "unresolved_reason": "why"}


def test_visual_lines(spark):
    # the tall word's line has its centre at 120; the next word, lower, fits no line; the third meets the first line again, past the second
    words = [(0, "tall", 50.0, 100.0, 140.0), (1, "small", 9.0, 101.0, 109.0), (2, "back", 5.0, 117.0, 125.0), (3, "near", 1.0, 105.0, 105.0)]
    df = spark.createDataFrame([(1, 1, n, t, x, y, end) for n, t, x, y, end in words], "doc_id int, page_number int, word_number int, text string, x0 double, y0 double, y1 double")
    assert rows(layout.visual_lines(df).select("word_number", "visual_line")) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_listed_lines_query(spark):
    """Threes of a page's lines of text, 14 points apart, are lines; those out of the zone are left out and lines counted from the top."""
    d, pages = "/root/testdata/sf0.001", {}
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        for n, line in enumerate(text.split("\n")):
            place = n % 50
            if line.strip() and 85 <= 72 + 14 * (place // 3) + place % 3 <= 600:
                pages.setdefault((doc, n // 50 + 1), []).append((n - place % 3 + 2 - place % 3, line, place // 3))
    want = sorted((*page, n, t, sorted({x[2] for x in own}).index(k)) for page, own in pages.items() for n, t, k in own)
    got = sorted(tuple(r) for r in QUERIES["q_listed_lines"](spark, d).select("doc_id", "page_number", "word_number", "text", "visual_line").collect())
    assert got == want and got
