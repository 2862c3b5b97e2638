"""Scalar functions and order-dependent operators on literal rows."""

import random

from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import catalog, contents, headings, layout, revision


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_names(spark):
    assert one(spark, X.bookmark, "787 31 I I Indicating Record...") == "787_31_indicating_record"
    assert one(spark, X.bookmark, "A 320 27 Flight Controls") == "a320_27_flight_controls"
    assert one(spark, X.header_bookmark, "BOEING 787 MINIMUM EQUIPMENT LIST ATA-57 WINGS ISSUE 3") == "787_57_wings"
    assert one(spark, X.header_bookmark, "BOEING 787\u00a0ATA\u00a057 WINGS") == "787_57_wings"
    assert one(spark, X.header_bookmark, "AIRBUS A 320 ATA\u201327 FLIGHT CONTROLS") == "a320_27_flight_controls"
    assert one(spark, X.repetition_key, "Page  12 of 40") == "page # of #"
    assert one(spark, X.normalize_title, "B787 MEL - EICAS MSGS") == "EICAS MESSAGES"


def test_labels(spark):
    assert one(spark, X.reference_labels, "21-00-01 TOC 22-1 EM-4") == ["TOC 22-1", "EM-4", "21-00", "22-1"]
    assert one(spark, lambda v: X.target_label(F.lit(""), v), "22") == "TOC 22-1"
    assert one(spark, lambda v: X.target_label(F.lit(""), v), "5") is None
    assert [one(spark, X.item_level, x) for x in ("21-52-05", "21-52-05-02")] == [1, 2]
    assert [one(spark, X.local_row_level, x) for x in ("21-52-05", "21-52-05-02")] == [2, 3]
    assert one(spark, X.normalize_revision_label, "toc – 3") == "TOC-3"
    assert one(spark, X.normalize_revision_label, "TOC21 - 4") == "TOC 21-4"
    rows = spark.createDataFrame([("21-10",), ("21-9",)], "label string")
    assert [r.label for r in revision.natural_order(rows, "label").collect()] == ["21-9", "21-10"]


def test_revisions(spark):
    after = lambda v, f: spark.createDataFrame([(v, f)], "v string, f int").select(X.next_revision(F.col("v"), F.col("f"))).first()[0]
    assert [after("3", None), after("3a", None), after(None, 7), after(None, None), after("x", 2)] == ["4", "4A", "8", "1", "1"]
    assert [one(spark, X.revision_date, x) for x in ("2026-04-25", "apr  2026")] == ["APR 2026", "APR 2026"]
    assert [one(spark, X.normalize_revision, x) for x in ("REV - 3", "rev", "4A")] == ["3", "rev", "4A"]
    assert one(spark, X.number_text, 10.0, "double") == "10" and one(spark, X.number_text, 1.25, "double") == "1.25"
    assert one(spark, X.color_hex, 255, "int") == "#0000ff" and one(spark, X.safe_tag, "1 a/b") == "field_1_a_b"


def test_page_numbers(spark):
    keep = spark.createDataFrame([("12",), ("page 3 of 9",), ("Page 12/40",), ("12 items",)], "v string").where(~F.col("v").rlike(X.PAGE_NUMBER))
    assert [r.v for r in keep.collect()] == ["12 items"]


def test_spacing(spark):
    rows = spark.createDataFrame([(1, 1, i, 0.0, a, b) for i, (a, b) in enumerate([(10.0, 20.0), (25.0, 35.0), (33.0, 43.0)])], "doc_id int, page_number int, line_order int, x0 double, y0 double, y1 double")
    found = layout.with_spacing(rows).orderBy("line_order").collect()
    assert [r.spacing_before for r in found] == [99, 5, 0] and [r.spacing_after for r in found] == [5, 0, 99]


def test_margin(spark):
    rows = spark.createDataFrame([(1, 1, i, x, float(i), "x" * 21) for i, x in enumerate([70.0, 71.0, 72.0, 140.0, 141.0])], "doc_id int, page_number int, line_order int, x0 double, y0 double, text string")
    assert layout.left_margins(rows).first().left_margin == 70.0


def test_clamp(spark):
    rng = random.Random(1)
    for levels in [[3, 3, 5, 1, 4], *[[rng.randint(1, 6) for _ in range(40)] for _ in range(5)]]:
        want, last = [], 0
        for i, x in enumerate(levels):
            last = 1 if i == 0 else min(x, last + 1)
            want.append(last)
        rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "d int, i int, level int")
        assert [r.level for r in headings.clamp_levels(rows, "level", ["d"], ["i"]).orderBy("i").collect()] == want


def test_pagination(spark):
    rows = spark.range(80).selectExpr("1 as d", "id")
    found = contents.paginate(rows, ["d"], ["id"]).groupBy("toc_page").count().orderBy("toc_page").collect()
    assert [r["count"] for r in found] == [39, 40, 1]


def test_runs_and_shift(spark):
    rows = spark.createDataFrame([(1, x) for x in (2, 3, 7, 8, 10)], "d int, p long")
    assert tuple(contents.longest_run(rows, ["d"], "p").first()) == (1, 2, 2)
    pages = spark.createDataFrame([(1, 9)], "d int, page long")
    inserted = spark.createDataFrame([(1, 5, 2), (1, 9, 1)], "d int, start_page long, n long")
    assert contents.shift_pages(pages, inserted, ["d"], "page").first().shifted_page == 12
    assert contents.shift_pages(pages, inserted, ["d"], "page", own=True).first().shifted_page == 11


def test_slots_and_risk(spark):
    slots = spark.createDataFrame([("21", 1), ("21", 2)], "c string, slot int")
    labels = spark.createDataFrame([("21", True, "TOC 21-1", 0), ("21", False, "21-1", 1), ("21", False, "21-2", 2)], "c string, is_new boolean, label string, place int")
    found = {r.label: (r.slot, r.overflow) for r in revision.fill_slots(slots, labels, ["c"]).collect()}
    assert found == {"TOC 21-1": (1, False), "21-1": (2, False), "21-2": (None, True)}
    risk = spark.createDataFrame([(True, 0), (True, 1), (True, 13), (False, 3)], "d boolean, m int").select(revision.overflow_risk(F.col("d"), F.col("m")).alias("r")).collect()
    assert [r.r for r in risk] == ["low", "medium", "high", "manual_review"]


def test_states(spark):
    events = {"a": "finished started", "b": "queued started", "c": "failed queued", "d": "finished failed scheduled", "e": "failed finished deferred", "f": "finished canceled", "g": "unknown"}
    rows = spark.createDataFrame([(k, t, s) for k, v in events.items() for t, s in enumerate(v.split())], "id string, t int, status string")
    want = {"a": "ready", "b": "processing", "c": "queued", "d": "queued", "e": "ready", "f": "failed"}
    assert dict(map(tuple, catalog.synced_status(rows, "id", "status", ["t"]).collect())) == want
    assert [one(spark, catalog.display_status, x) for x in ("scheduled", "stopped", "finished", "other")] == ["queued", "failed", "ready", None]


def test_records(spark):
    rows = spark.createDataFrame([(1, "a", "x", "broken"), (2, "b", "y", "broken"), (3, "c", "z", None)], "id int, status string, path string, error string")
    changes = spark.createDataFrame([(1, "ready", None, None), (3, None, "new", "late")], "id int, status string, path string, error string")
    assert sorted(map(tuple, catalog.patched(rows, changes, ["id"]).collect())) == [(1, "ready", "x", None), (2, "b", "y", "broken"), (3, "c", "new", "late")]
    assert {r.id for r in catalog.delete(rows, changes, ["id"]).collect()} == {2}


def test_download_names(spark):
    names = {"Ünï a??b.pdf": "Ünï a_b", "C:\\x\\My: file.v2.pdf": "My_ file.v2", " ._.pdf": "document", "": "document", None: "document", "plain": "plain", "a<>|b\tc": "a_b_c"}
    for name, want in names.items():
        assert one(spark, lambda v: X.download_name(v, "_toc", ".pdf"), name) == f"{want}_toc.pdf"


def test_positions_and_empty(spark):
    rows = spark.createDataFrame([([10.0, 11.0, 20.0],)], "p array<double>")
    assert rows.select(layout.merged_positions(F.col("p"))).first()[0] == [10.5, 20.0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    from leafmill.sources.layout import virtual_lines

    assert headings.detect_headings(layout.with_spacing(virtual_lines(empty))).count() == 0
