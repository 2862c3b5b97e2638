"""One file for each document: XML of a whole document (K6, C11) and workbooks (K11, S15), as data sources.

Rows come sorted by document, and each task writes its documents' files as the rows come, so that no document is ever held whole. Files are
written to a folder of the task beside their place and moved there when all tasks are done; if one fails, none is there. A task that runs again writes
to a folder of its own. The path may be any that pyarrow's file systems know. Executors need this package.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import text as X

#: Characters that XML can't hold.
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
SUMMARY, UNRESOLVED = "Summary", "Unresolved Links"
# Heads of the two sheets.
HEADS = {SUMMARY: ["Field", "Value"], UNRESOLVED: ["toc_page", "toc_type", "target_label", "unresolved_reason", "title", "reference_text", "chapter"]}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(document: str, suffix: str) -> str:
    """A document's file: characters that a path can't have as %xx, so that no two documents share a file."""
    return re.sub(r"[^\w.-]|^\.", lambda m: "".join(f"%{b:02x}" for b in m[0].encode()), document) + suffix


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Rows sorted by their first column, the document, to a file each."""

    suffix = ""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def document(self, out, first: Row) -> tuple:
        """Begins a file; what is returned is a function for its rows, the first one too, and one for its end."""
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Written:
        files, folder = _place(self.job)
        folder = f"{folder}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        now, names, out, add, end = None, [], None, None, None
        for row in rows:
            if not names or row[0] != now:
                if out:
                    end()
                    out.close()
                now = row[0]
                names.append(file_name(now, self.suffix))
                out = files.open_output_stream(f"{folder}/{names[-1]}")
                add, end = self.document(out, row)
            add(row)
        if out:
            end()
            out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _place(self.path)
        for m in messages:
            for name in m.names if m else ():
                files.move(f"{m.folder}/{name}", f"{path}/{name}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, folder = _place(self.job)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


# XML ------------------------------------------------------------------------


def _text(value) -> str:
    return escape(_NOT_XML.sub("�", str(value)))


class XmlWriter(FilesWriter):
    """Rows document_id, filename, generated_at, page_count, metadata (array of key, value, in order), page (XML or null)."""

    suffix = ".xml"

    def document(self, out, first: Row) -> tuple:
        write = lambda s: out.write(s.encode("utf-8"))
        given = (("document_id", first[0]), ("filename", first[1]), ("generated_at", first[2]), ("page_count", first[3]))
        attributes = "".join(f" {k}={quoteattr(_NOT_XML.sub(chr(0xFFFD), str(v)))}" for k, v in given if v is not None)
        write(f"<?xml version='1.0' encoding='utf-8'?>\n<pdf_document{attributes}>\n  <metadata>\n")
        for key, value in first[4] or ():
            write(f"    <{key}>{_text(value)}</{key}>\n")
        write("  </metadata>\n  <pages>\n")

        def add(row: Row) -> None:
            if row[5] is not None:
                write(row[5] + "\n")

        return add, lambda: write("  </pages>\n</pdf_document>\n")


class XmlDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_xml_documents"

    def writer(self, schema, overwrite: bool) -> XmlWriter:
        return XmlWriter(self.options["path"])


def write_documents(pages: DataFrame, documents: DataFrame, metadata: DataFrame, path: str) -> None:
    """K6: for each row of documents (doc_id, filename, generated_at) a file with its metadata and its pages in order.

    pages: of xml_pages.page_trees. metadata: doc_id, key, value; of all keys, in order, those whose value is neither null nor empty, as elements of
    safe names. A document without pages or metadata has empty elements for them. The document's page count is its number of page rows.
    Its metadata are one value, its pages aren't.
    """
    spark = pages.sparkSession
    spark.dataSource.register(XmlDocuments)
    named = F.array_sort(F.collect_list(F.struct("key", "value")))
    kept = metadata.where("value IS NOT NULL AND value != '' AND key IS NOT NULL").groupBy("doc_id").agg(named.alias("all"))
    kept = kept.select("doc_id", F.transform("all", lambda x: F.struct(X.safe_tag(x["key"]).alias("key"), x["value"].alias("value"))).alias("metadata"))
    counts = pages.groupBy(F.col("_doc_id").alias("doc_id")).agg(F.count("*").alias("n"))
    heads = documents.select("doc_id", "filename", "generated_at").join(kept, "doc_id", "left").join(counts, "doc_id", "left")
    inner = [c for c in pages.columns if c not in ("_doc_id", "block")]
    attributes = [c for c in inner if c.startswith("_")]
    page = F.struct(*attributes, F.struct("block").alias("blocks"), *[c for c in inner if not c.startswith("_")])
    trees = pages.select(F.col("_doc_id").alias("doc_id"), F.col("_number").alias("number"), F.to_xml(page, {"rowTag": "page"}).alias("page"))
    rows = heads.join(trees, "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "number")
    text = lambda c: F.col(c).cast("string").alias(c)
    out = rows.select(F.col("doc_id").cast("string").alias("document_id"), text("filename"), text("generated_at"), F.coalesce("n", F.lit(0)).alias("page_count"), "metadata", "page")
    out.write.format("leafmill_xml_documents").mode("append").save(path)


# Workbooks --------------------------------------------------------------------


def _column(n: int) -> str:
    return (_column(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


class WorkbookWriter(FilesWriter):
    """Rows document_id, sheet, place, cells (array of string, number): a file with both sheets, the rows of a sheet after its head."""

    suffix = "_process.xlsx"

    def document(self, out, first: Row) -> tuple:
        book = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in (1, 2)) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(HEADS, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + "</Relationships>",
        }
        for name, text in parts.items():
            book.writestr(name, "<?xml version='1.0' encoding='UTF-8' standalone='yes'?>" + text)
        open_sheet: list = [None, None, 0]  # name, stream, rows

        def line(cells: list) -> None:
            open_sheet[2] += 1
            found = []
            for i, x in enumerate(cells):
                if x is not None:
                    text = _NOT_XML.sub("�", x).replace("\r", "&#13;") if "\r" not in x else _NOT_XML.sub("�", x)
                    found.append(f'<c r="{_column(i)}{open_sheet[2]}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>')
            open_sheet[1].write(f'<row r="{open_sheet[2]}">{"".join(found)}</row>'.encode())

        def close() -> None:
            if open_sheet[1]:
                open_sheet[1].write(f'</sheetData><autoFilter ref="A1:{_column(len(HEADS[open_sheet[0]]) - 1)}{open_sheet[2]}"/></worksheet>'.encode())
                open_sheet[1].close()

        def turn_to(sheet: str) -> None:
            close()
            open_sheet[:] = [sheet, book.open(f"xl/worksheets/sheet{list(HEADS).index(sheet) + 1}.xml", "w", force_zip64=True), 0]
            open_sheet[1].write(f"<?xml version='1.0' encoding='UTF-8' standalone='yes'?><worksheet xmlns=\"{_MAIN}\"><sheetViews><sheetView workbookViewId=\"0\"><pane ySplit=\"1\" topLeftCell=\"A2\" state=\"frozen\"/></sheetView></sheetViews><sheetData>".encode())
            line(HEADS[sheet])

        def add(row: Row) -> None:
            if open_sheet[0] is None:
                turn_to(SUMMARY)
            if open_sheet[0] != row[1]:
                turn_to(row[1])
            line(row[3])

        def end() -> None:
            if open_sheet[0] != UNRESOLVED:
                turn_to(UNRESOLVED)
            close()
            book.close()

        return add, end


def _rows(stream, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a sheet, from 1 on, as they are parsed: numbers as they are written, texts inline or shared."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    last = 0
    parser = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(parser)
    for event, element in parser:
        if event == "start" or element.tag != tag("row"):
            continue
        last = int(element.get("r") or last + 1)
        cells: list[str | None] = []
        for c in element.findall(tag("c")):
            letters = re.match("[A-Z]*", c.get("r") or "")[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            at = at - 1 if letters else len(cells)
            cells += [None] * (at + 1 - len(cells))
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(tag("t")))
            elif (v := c.find(tag("v"))) is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
        yield last, cells
        element.clear()
        root.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, path = _place(self.path)
        found = files.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".xlsx")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = _place(self.path)
        name = partition.value.rsplit("/", 1)[-1]
        # a zip is read from its end; the file is read by parts, not whole
        with files.open_input_file(partition.value) as source, zipfile.ZipFile(source) as book:
            ids = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in x.iter(f"{{{_MAIN}}}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
            for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
                target = ids[sheet.get(f"{{{_OFFICE}}}id")].removeprefix("/xl/").removeprefix("xl/")
                with book.open(f"xl/{target}") as stream:
                    for n, cells in _rows(stream, shared):
                        yield name, sheet.get("name"), n, cells


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_workbooks"

    def schema(self) -> str:
        return "file string, sheet string, row long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def write_workbooks(summary: DataFrame, unresolved: DataFrame, path: str) -> None:
    """A workbook for each document of summary (document_id, place, field, value; of catalog.process_summary) with its rows of unresolved.

    unresolved: of catalog.unresolved_links, in order of toc_page, then of the other columns. Null cells are empty.
    """
    summary.sparkSession.dataSource.register(Workbooks)
    cells = lambda names: F.array(*[F.col(c).cast("string") for c in names]).alias("cells")
    order: list[Column] = [F.col(c) for c in HEADS[UNRESOLVED]]
    of = lambda df, n, sheet, names, place: df.select(F.col("document_id").cast("string").alias("document_id"), F.lit(sheet).alias("sheet"), F.lit(n).alias("_n"), place.alias("_place"), cells(names))
    none = F.struct(*[F.lit(None).cast(unresolved.schema[c].dataType).alias(c) for c in HEADS[UNRESOLVED]])
    first = of(summary, 0, SUMMARY, ["field", "value"], F.struct(F.col("place").cast("long").alias("p"), none.alias("r")))
    known = unresolved.join(summary.select("document_id").distinct(), "document_id", "left_semi")
    second = of(known, 1, UNRESOLVED, HEADS[UNRESOLVED], F.struct(F.lit(0).cast("long").alias("p"), F.struct(*order).alias("r")))
    rows = first.unionByName(second).repartition("document_id").sortWithinPartitions("document_id", "_n", "_place", "cells")
    rows.select("document_id", "sheet", F.col("_n").cast("long").alias("place"), "cells").write.format("leafmill_workbooks").mode("append").save(path)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """File, sheet, row (from 1), cells (array of string) of the workbooks in a folder, a task for each."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("leafmill_workbooks").load(path)


def workbook_previews(rows: DataFrame) -> DataFrame:
    """Of each file the first 30 rows of two columns of the sheet Summary as lines; an empty text where there is no such sheet."""
    none = F.lit("None")
    key, value = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    own = rows.where((F.col("row") <= 30) & (key.isNotNull() | value.isNotNull()))
    line = F.struct("row", F.concat(F.coalesce(key, none), F.lit(": "), F.coalesce(value, none)).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sheet") == SUMMARY, line))), lambda x: x["line"]), "\n")
    return own.groupBy("file").agg(lines.alias("preview"))
