"""Checks of uploaded files (S13) by a few byte ranges of each: its head, its end, and the objects that tell its pages.

Files are listed by Spark without their content; tasks read ranges through pyarrow's file systems. Of a file's table of objects only the entries
asked for are read, but where the table is a compressed stream, which is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 500 * 1024 * 1024
#: Bytes of the end in which the place of the table of objects is looked for; bytes read of an object at first.
TAIL, OBJECT = 2048, 2048
_REFERENCE = rb"\s*(\d+)\s+\d+\s+R"


class Pdf:
    """What the end of a file and the objects it points to say. read(offset, n) gives bytes."""

    def __init__(self, read: Callable[[int, int], bytes], length: int):
        self.read, self.length = read, length
        #: newest first: sections of plain tables (first object, number, place), and entries of streams
        self.sections: list[tuple[int, int, int]] = []
        self.entries: dict[int, tuple[int, int, int]] = {}
        self.root: int | None = None
        self.encrypted = False
        tail = read(max(0, length - TAIL), TAIL)
        at = int(re.findall(rb"startxref\s+(\d+)", tail)[-1])
        seen = set()
        while at is not None and at not in seen and len(seen) < 10_000:
            seen.add(at)
            at = self.table(at)

    def until(self, at: int, end: bytes) -> bytes:
        """From a place to the first such end, or to the file's."""
        size = OBJECT
        while True:
            data = self.read(at, size)
            if end in data or len(data) < size:
                return data.split(end)[0]
            size *= 4

    def table(self, at: int) -> int | None:
        if self.read(at, 4) != b"xref":
            return self.stream_table(at)
        at += 4
        while True:
            line = self.read(at, 64)
            m = re.match(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?", line)
            if not m:
                break
            self.sections.append((int(m[1]), int(m[2]), at + m.end()))
            at += m.end() + 20 * int(m[2])
        return self.trailer(self.until(at, b"startxref"))

    def trailer(self, data: bytes) -> int | None:
        if self.root is None and (m := re.search(rb"/Root" + _REFERENCE, data)):
            self.root = int(m[1])
        self.encrypted |= re.search(rb"/Encrypt\b", data) is not None
        if m := re.search(rb"/XRefStm\s+(\d+)", data):
            self.stream_table(int(m[1]))
        m = re.search(rb"/Prev\s+(\d+)", data)
        return int(m[1]) if m else None

    def stream(self, at: int) -> tuple[bytes, bytes]:
        """An object's dictionary and its stream, inflated and without predictors."""
        head = self.until(at, b"stream")
        start = at + len(head) + 6
        start += len(re.match(rb"\r?\n?", self.read(start, 2))[0])
        n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        data = self.read(start, int(n[1])) if n else self.until(start, b"endstream")
        if b"/FlateDecode" in head:
            data = zlib.decompressobj().decompress(data)
        m = re.search(rb"/Predictor\s+(\d+)", head)
        if m and int(m[1]) >= 10:
            columns = re.search(rb"/Columns\s+(\d+)", head)
            data = _unpredicted(data, int(columns[1]) if columns else 1)
        return head, data

    def stream_table(self, at: int) -> int | None:
        head, data = self.stream(at)
        widths = [int(x) for x in re.search(rb"/W\s*\[\s*(\d+)\s+(\d+)\s+(\d+)", head).groups()]
        size = int(re.search(rb"/Size\s+(\d+)", head)[1])
        index = re.search(rb"/Index\s*\[([\d\s]*)\]", head)
        index = [int(x) for x in index[1].split()] if index else [0, size]
        step, row = sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + n):
                entry, fields, place = data[row * step : (row + 1) * step], [], 0
                for w in widths:
                    fields.append(int.from_bytes(entry[place : place + w], "big"))
                    place += w
                kind = fields[0] if widths[0] else 1
                self.entries.setdefault(number, (kind, fields[1], fields[2]))
                row += 1
        return self.trailer(head)

    def object(self, number: int) -> bytes:
        for first, n, at in self.sections:
            if first <= number < first + n:
                entry = self.read(at + 20 * (number - first), 20)
                if entry[17:18] == b"n":
                    return self.until(int(entry[:10]), b"endobj")
        kind, at, place = self.entries[number]
        if kind == 1:
            return self.until(at, b"endobj")
        inner_kind, inner, _ = self.entries[at]
        head, data = self.stream(inner)
        first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"First", b"N"))
        numbers = [int(x) for x in data[:first].split()]
        begins = [*numbers[1 : 2 * n : 2], len(data) - first]
        return data[first + begins[place] : first + begins[place + 1]]

    def pages(self) -> int:
        tree = int(re.search(rb"/Pages" + _REFERENCE, self.object(self.root))[1])
        return int(re.search(rb"/Count\s+(-?\d+)", self.object(tree))[1])


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows with a byte for their filter: none, sub, up, average or Paeth, of one byte to a pixel."""
    out, before = bytearray(), bytes(columns)
    for i in range(0, len(data), columns + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + columns])
        for j in range(len(row)):
            left, up, corner = row[j - 1] if j else 0, before[j], before[j - 1] if j else 0
            guess = left + up - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            row[j] = (row[j] + (0, left, up, (left + up) // 2, near)[kind]) & 255
        out += row
        before = bytes(row)
    return bytes(out)


def finding(read: Callable[[int, int], bytes], length: int) -> tuple[int | None, str | None]:
    """A file's number of pages, if it can be told, and why it doesn't pass."""
    if read(0, 5) != b"%PDF-":
        return None, "not_pdf"
    try:
        pdf = Pdf(read, length)
        try:
            pages = pdf.pages()
        except Exception:  # noqa: BLE001 - an encrypted file hides its objects
            if pdf.encrypted:
                return None, "encrypted"
            raise
    except Exception:  # noqa: BLE001 - whatever is wrong with it, it can't be read
        return None, "not_readable"
    return pages, "no_pages" if pages < 1 else "encrypted" if pdf.encrypted else None


def _checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        found = []
        for path, length, reason in zip(frame["path"], frame["length"], frame["reason"], strict=True):
            if reason:
                found.append((None, reason))
                continue
            local = re.match("file:/+", path)
            files, place = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(path)
            with files.open_input_file(place) as f:

                def read(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                found.append(finding(read, int(length)))
        yield frame.assign(pages=pd.array([p for p, _ in found], "Int64"), reason=[r for _, r in found])[["path", "length", "pages", "reason"]]


def _empty(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files without a byte, which Spark's scans pass over; the driver lists names, as it does for a scan."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, every = [], at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while every.hasNext():
        f = every.next()
        if f.getLen() == 0 and f.getPath().getName()[0] not in "._":
            found.append((f.getPath().toString(), 0))
    return found


def checked_uploads(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Path, length, pages and reason of each file below path: not_pdf_name, empty, too_large, not_pdf, not_readable, no_pages, encrypted, or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.unionByName(spark.createDataFrame(_empty(spark, path), "path string, length long"))
    reason = F.when(~F.lower("path").endswith(".pdf"), "not_pdf_name").when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large")
    return files.withColumn("reason", reason.cast("string")).mapInPandas(_checked, "path string, length long, pages long, reason string")
