"""Files made by hand, one for each way to fail and each form of a table of objects; lines from spans; images' share of a page."""

import os
import zlib

from leafmill.sources import layout, uploads


def plain(objects, trailer="", table=True):
    out, places = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += f"{n} 0 obj\n{body}\nendobj\n".encode()
    at = len(out)
    if table:
        out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in sorted(objects))
    return out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode()


def compressed(count, predictor=True, encrypt=""):
    """The catalogue and the pages lie in a stream of objects, the table is a stream, too."""
    inner = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [] /Count {count} >>"]
    head = f"1 0 2 {len(inner[0]) + 1} "
    data = zlib.compress((head + " ".join(inner)).encode())
    out = b"%PDF-1.5\n"
    objects_at = len(out)
    out += f"3 0 obj\n<< /Type /ObjStm /N 2 /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    at = len(out)
    rows = [(0, 0, 255), (2, 3, 0), (2, 3, 1), (1, objects_at, 0), (1, at, 0)]
    rows = [bytes([k]) + p.to_bytes(2, "big") + bytes([g]) for k, p, g in rows]
    if predictor:
        before, table = bytes(4), b""
        for r in rows:
            table += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before))
            before = r
    else:
        table = b"".join(rows)
    table = zlib.compress(table)
    parms = "/DecodeParms << /Predictor 12 /Columns 4 >>" if predictor else ""
    out += f"4 0 obj\n<< /Type /XRef /Size 5 /W [1 2 1] /Root 1 0 R {encrypt} /Filter /FlateDecode {parms} /Length {len(table)} >>\nstream\n".encode() + table + b"\nendstream\nendobj\n"
    return out + f"startxref\n{at}\n%%EOF".encode()


def test_uploads(spark, tmp_path):
    tree = lambda n: {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [] /Count {n} >>"}
    good = plain(tree(3))
    # a later part of the file gives the pages anew, and the table before it the rest
    at = len(good)
    update = good + b"2 0 obj\n<< /Type /Pages /Kids [] /Count 9 >>\nendobj\n"
    table = len(update)
    update += f"xref\n2 1\n{at:010d} 00000 n \ntrailer\n<< /Size 3 /Root 1 0 R /Prev {good.rindex(b'xref' + chr(10).encode() + b'0')} >>\nstartxref\n{table}\n%%EOF".encode()
    files = {
        "good.pdf": (good, 3, None), "UPPER.PDF": (good, 3, None), "update.pdf": (update, 9, None), "stream.pdf": (compressed(5), 5, None), "plain_stream.pdf": (compressed(4, False), 4, None),
        "long.pdf": (plain(tree(2) | {n: "x" * 3000 for n in range(3, 40)}), 2, None), "name.txt": (good, None, "not_pdf_name"), "empty.pdf": (b"", None, "empty"), "large.pdf": (good + b" " * 200_000, None, "too_large"),
        "head.pdf": (b"PDF-1.4" + good, None, "not_pdf"), "short.pdf": (b"%PDF-1.4\n", None, "not_readable"), "cut.pdf": (good[:60], None, "not_readable"), "wild.pdf": (b"%PDF-1.4\nstartxref\n99999999\n%%EOF", None, "not_readable"),
        "loop.pdf": (plain(tree(1), table=False).replace(b"/Root 1 0 R", b"/Prev 9"), None, "not_readable"), "none.pdf": (plain(tree(0)), 0, "no_pages"), "locked.pdf": (plain(tree(2), "/Encrypt 9 0 R"), 2, "encrypted"),
        "locked_stream.pdf": (compressed(2, encrypt="/Encrypt 9 0 R").replace(b"/ObjStm", b"/ObjSTM", 1), 2, "encrypted"),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): (r.pages, r.reason) for r in uploads.checked_uploads(spark, str(tmp_path), most=150_000).collect()}
    assert got == {name: (pages, reason) for name, (_, pages, reason) in files.items()}


def test_only_ranges_are_read():
    """Of a file of megabytes some thousand bytes."""
    data = plain({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Count 7 >>"} | {n: "y" * 50_000 for n in range(3, 60)})
    seen = []

    def read(at, n):
        seen.append(len(data[at : at + n]))
        return data[at : at + n]

    assert uploads.finding(read, len(data)) == (7, None) and sum(seen) < 15_000 < 2_000_000 < len(data)


def test_lines_from_spans(spark):
    spans = "doc_id int, page_number int, block_number int, line_number int, span_number int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double"
    rows = [
        (1, 1, 0, 0, 0, "world ", "Times", 10.0, 0, 50.0, 10.0, 80.0, 21.0), (1, 1, 0, 0, 1, "Hello,", "Arial", 13.0, 16, 10.0, 11.0, 45.0, 20.0), (1, 1, 0, 0, 2, "  ", "Big", 99.0, 16, 0.0, 0.0, 99.0, 99.0),
        (1, 1, 0, 1, 0, "plain", "Courier", 9.0, 0, 10.0, 30.0, 40.0, 39.0), (1, 1, 0, 1, 1, "  wide", "Courier-Heavy", 9.0, 0, 41.0, 30.0, 70.0, 39.0), (1, 1, 1, 0, 0, " ", "x", 9.0, 0, 1.0, 1.0, 2.0, 2.0),
    ]
    got = layout.lines_from_spans(spark.createDataFrame(rows, spans)).orderBy("block_number", "line_number").collect()
    assert [(r.text, r.font_size, r.font_name, r.is_bold, r.x0, r.y0, r.x1, r.y1) for r in got] == [
        ("Hello, world", 11.5, "Times", True, 10.0, 10.0, 80.0, 21.0),
        ("plain wide", 9.0, "Courier-Heavy", True, 10.0, 30.0, 70.0, 39.0),
    ]


def test_image_coverage(spark):
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 306.0, 396.0), (1, 1, 0.001, 0.0, 306.0, 396.001), (1, 1, 306.0, 396.0, 612.0, 792.0), (1, 2, 0.0, 0.0, 900.0, 900.0)], "doc_id int, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = {r.page_number: r.coverage for r in layout.image_coverage(images).collect()}
    assert got == {1: 0.5, 2: 1.0}
