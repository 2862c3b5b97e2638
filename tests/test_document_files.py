"""Whole documents as XML and reports as workbooks, written by tasks and read back."""

import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalog
from leafmill.sources import document_files, xml_pages

SPANS = "doc_id int, page_number int, block_number int, line_number int, span_number int, text string, font string, size double, flags int, color int, x0 double, y0 double, x1 double, y1 double"


def trees_of(spark, n_documents, n_pages):
    spans = [(d, p, 0, i, 0, f"d{d} p{p} <&> {i}", "Arial", 10.0, 0, 0, 1.0, 1.0 + i, 5.0, 2.0 + i) for d in range(n_documents) for p in range(1, n_pages + 1) for i in range(2)]
    info = [(d, p, 612.0, 792.0, 0) for d in range(n_documents) for p in range(1, n_pages + 1)]
    images = spark.createDataFrame([(0, 1, 1, 20, 30, "png", 0.0, 0.0, 20.0, 30.0)], "doc_id int, page_number int, block_number int, width int, height int, ext string, x0 double, y0 double, x1 double, y1 double")
    return xml_pages.page_trees(spark.createDataFrame(spans, SPANS).repartition(5), spark.createDataFrame(info, "doc_id int, page_number int, width double, height double, rotation int"), images=images)


def documents_of(spark, n):
    metadata = spark.createDataFrame([(0, "title", "A & B"), (0, "zz key", "last"), (0, "Author", ""), (0, "author", "x"), (0, "1st", "one"), (0, "none", None)], "doc_id int, key string, value string")
    return spark.createDataFrame([(d, f"file {d}.pdf", "2024-01-01T00:00:00+00:00") for d in range(n)], "doc_id int, filename string, generated_at string"), metadata


def test_xml_of_documents(spark, tmp_path):
    path = str(tmp_path / "out")
    documents, metadata = documents_of(spark, 8)
    document_files.write_documents(trees_of(spark, 7, 12), documents, metadata, path)
    assert sorted(os.listdir(path)) == [f"{d}.xml" for d in range(8)]
    for d in range(7):
        root = ElementTree.parse(f"{path}/{d}.xml").getroot()
        assert root.tag == "pdf_document" and dict(root.attrib) == {"document_id": str(d), "filename": f"file {d}.pdf", "generated_at": "2024-01-01T00:00:00+00:00", "page_count": "12"}
        assert [x.tag for x in root] == ["metadata", "pages"] and [p.get("number") for p in root[1]] == [str(p) for p in range(1, 13)]
        assert [s.text for s in root.iter("span")] == [f"d{d} p{p} <&> {i}" for p in range(1, 13) for i in range(2)]
    first, empty = (ElementTree.parse(f"{path}/{d}.xml").getroot() for d in (0, 7))
    assert [(x.tag, x.text) for x in first[0]] == [("field_1st", "one"), ("author", "x"), ("title", "A & B"), ("zz_key", "last")]
    assert [(b.get("index"), b.get("type"), b.get("ext"), b.get("x1")) for b in first[1][0].iter("block")] == [("0", "text", None, "5"), ("1", "image", "png", "20")]
    assert empty.get("page_count") == "0" and not len(empty[0]) and not len(empty[1])
    # Spark reads them, too
    assert spark.read.format("xml").option("rowTag", "page").load(path).count() == 84


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    documents, metadata = documents_of(spark, 7)
    failing = documents.withColumn("filename", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("filename")))
    with pytest.raises(Exception, match="lost"):
        document_files.write_documents(trees_of(spark, 7, 2), failing, metadata, path)
    assert [f for _, _, files in os.walk(path) for f in files] == []
    document_files.write_documents(trees_of(spark, 7, 2), documents, metadata, path)
    assert len(os.listdir(path)) == 7


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "books")
    reports = spark.createDataFrame([("a/b", "x.pdf", "linked", "7", None), ("c", "y <&>.pdf", "m", "\r\n 8", "z")], "document_id string, source_filename string, mode string, linked string, other string")
    summary = catalog.process_summary(reports, ["linked", "other"]).where("field != 'timestamp_utc'")
    rows = [("a/b", 10 + i % 3, "global", None if i % 2 else f"21-{i}", None, f"T\x01{i}", "r", "21") for i in range(40)] + [("nobody", 1, "global", None, None, "t", "r", "1")]
    unresolved = spark.createDataFrame(rows, "document_id string, toc_page int, toc_type string, target_label string, unresolved_reason string, title string, reference_text string, chapter string")
    document_files.write_workbooks(summary, unresolved, path)
    assert sorted(os.listdir(path)) == ["a%2fb_process.xlsx", "c_process.xlsx"]
    found = {}
    for r in document_files.read_workbooks(spark, path).orderBy("file", "sheet", "row").collect():
        found.setdefault((r.file[0], r.sheet), []).append(r.cells)
    assert found["a", "Summary"] == [["Field", "Value"], ["document_id", "a/b"], ["source_filename", "x.pdf"], ["mode", "linked"], ["linked", "7"], ["other"]]
    assert found["c", "Summary"][2] == ["source_filename", "y <&>.pdf"] and found["c", "Summary"][4] == ["linked", "\r\n 8"]
    assert found["c", "Unresolved Links"] == [document_files.HEADS["Unresolved Links"]]
    want = sorted(([str(r[1]), r[2], r[3], r[4], r[5].replace("\x01", "�"), *r[6:]] for r in rows[:40]), key=lambda r: (r[0], r[1], r[2] or "", r[4]))
    assert found["a", "Unresolved Links"][1:] == want
    previews = {r.file[0]: r.preview for r in document_files.workbook_previews(document_files.read_workbooks(spark, path)).collect()}
    assert previews["a"] == "Field: Value\ndocument_id: a/b\nsource_filename: x.pdf\nmode: linked\nlinked: 7\nother: None"


def test_a_workbook_with_shared_texts(spark, tmp_path):
    """As other programs write them: shared texts, numbers, cells and rows that are left out."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Summary" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>key</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="4"><c r="AB4"><v>2.5</v></c></row></sheetData></worksheet>')
    rows = document_files.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.row, r.cells) for r in rows] == [(1, ["key", "value"]), (4, [None] * 27 + ["2.5"])]
    assert document_files.workbook_previews(document_files.read_workbooks(spark, str(tmp_path))).first().preview == "key: value"
