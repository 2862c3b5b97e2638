"""Contents before sections: edits applied to a list of pages, page maps back and forth, and overlaps by a grid, against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from leafmill.operators import contents
from leafmill.plans import composite

RECT = ["x0", "y0", "x1", "y1"]


def inserted(pages, steps):
    """A list of pages with n copies of a page put before it, for all pages of a step at once; a copy is told by its page and "new"."""
    for step in steps:
        out = []
        for at, p in enumerate(pages, 1):
            out += [(p[0], "new")] * step.get(at, 0) + [p]
        pages = out
    return pages


def test_page_maps(spark):
    rng = random.Random(3)
    source = {d: [(p, "old") for p in range(1, 40)] for d in (1, 2, 3)}
    steps = [{d: {rng.randint(1, 45): rng.randint(1, 4) for _ in range(6)} for d in (1, 2)} for _ in range(3)]
    tables = [spark.createDataFrame([(d, p, n) for d, own in s.items() for p, n in own.items()], "doc int, start_page long, n long").repartition(3) for s in steps]
    want = {d: inserted(own, [s.get(d, {}) for s in steps]) for d, own in source.items()}
    rows = spark.createDataFrame([(d, p) for d, own in source.items() for p, _ in own], "doc int, page long")
    got = {(r.doc, r.page): r.shifted_page for r in contents.shifted_through(rows, tables, ["doc"], "page").collect()}
    assert got == {(d, p): i for d, own in want.items() for i, (p, kind) in enumerate(own, 1) if kind == "old"}
    # back, from the last step to the first
    final = spark.createDataFrame([(d, i, i) for d, own in want.items() for i in range(1, len(own) + 1)], "doc int, final long, page long").withColumn("new", F.lit(False))
    for table in reversed(tables):
        back = contents.source_pages(final, table, ["doc"], "page")
        final = back.select("doc", "final", F.col("source_page").alias("page"), (F.col("new") | F.col("is_new")).alias("new"))
    assert {(r.doc, r.final): (r.page, r.new) for r in final.collect()} == {(d, i): (p, kind == "new") for d, own in want.items() for i, (p, kind) in enumerate(own, 1)}
    # without insertions all stays
    none = tables[0].where("n < 0")
    assert {(r.page, r.source_page, r.is_new) for r in contents.source_pages(rows, none, ["doc"], "page").collect()} == {(p, p, False) for p in range(1, 40)}


def test_section_edits(spark):
    """Two sections with two pages and one of contents, one without; the edits done to a list of pages give the pages that plans and entries name."""
    roots = spark.createDataFrame([(1, 0, 3, "21", "Air"), (1, 1, 10, "22", "Flight"), (1, 2, 20, "23", "None"), (2, 0, 1, "21", "No headings")], "doc_id long, ord int, page int, chapter string, title string")
    heads = spark.createDataFrame([(1, 4 + i // 20, float(i), f"21-{i:02}-01", 1 + i % 2) for i in range(60)] + [(1, 15, None, "22-00-02", 9)], "doc_id long, page int, y0 double, title string, level int")
    last = spark.createDataFrame([(1, 30), (2, 5)], "doc_id long, last_page int")
    bodies = spark.createDataFrame([(1, 3, 96.0, 750.0, 757.0)], "doc_id long, page_number int, body_y double, footer_y double, footer_baseline double")
    plans, entries = composite.section_contents(roots, heads, last, bodies)
    rows = spark.createDataFrame([(1, 2, 50.0, 100.0, 300.0, 110.0, 5), (1, 2, 50.0, 120.0, 300.0, 130.0, 19), (1, 12, 50.0, 140.0, 300.0, 150.0, 25), (2, 1, 0.0, 0.0, 9.0, 9.0, 3)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double, target_page int")
    links = spark.createDataFrame([(1, 2, 60.0, 105.0, 70.0, 125.0), (1, 2, 60.0, 300.0, 70.0, 310.0), (1, 12, 0.0, 0.0, 51.0, 141.0), (2, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    edits = composite.section_edits(plans, entries, rows, links, bodies).orderBy("step", "turn", "page", "y0", "operation").collect()
    assert {r.doc_id for r in edits} == {1}
    pages = [(p, "old") for p in range(1, 31)]
    for r in edits:
        if r.operation == "insert_page":
            assert r.step == 0
            pages.insert(r.page - 1, (pages[r.page - 1][0], "new"))
    assert pages == inserted([(p, "old") for p in range(1, 31)], [{3: 2, 10: 1}])
    new = [i for i, (_, kind) in enumerate(pages, 1) if kind == "new"]
    assert new == [3, 4, 12]
    assert Counter((r.operation, r.page) for r in edits if r.step == 1) == Counter({("delete_link", p): 1 for p in new} | {("delete_text", p): 2 for p in new})
    texts = {(r.page, r.text): (r.x0, r.y0) for r in edits if r.operation == "insert_text"}
    assert texts[3, "Table of Contents"] == (None, 114.0) and texts[12, "Table of Contents"] == (None, 130.0) and (4, "Table of Contents") not in texts
    assert texts[3, "TOC 21-1"] == (None, 757.0) and texts[4, "TOC 21-2"] == (None, 757.0) and texts[12, "TOC 22-1"] == (None, 753.0)
    assert texts[3, "21-00-01"] == (54.0, 139.0) and texts[3, "21-01-01"] == (72.0, 155.0) and texts[12, "22-00-02"] == (198.0, 155.0)
    assert len(texts) == 3 + 2 + 61
    written = {(r.page, r.y1 - 3): (r.x0, r.y0, r.x1, r.target_page, r.target_y) for r in edits if r.operation == "insert_link" and r.step == 2}
    assert len(written) == 61 and written[3, 139.0] == (54.0, 128.5, 558.0, 6, 0.0) and written[12, 155.0] == (54.0, 146.5, 558.0, 18, 0.0)
    for (page, y), (*_, target, at) in written.items():
        title = next(t for (p, t), (x, at_y) in texts.items() if p == page and at_y == y and x)
        assert pages[target - 1] == (15 if title == "22-00-02" else 4 + int(at) // 20, "old")
    # targets 5 and 19 lie in sections; 25 in one without contents. The row on page 12 moves by three pages.
    assert sorted((r.page, r.y0, r.target_page) for r in edits if r.step == 3 and r.operation == "insert_link") == [(2, 100.0, 3), (2, 120.0, 12), (15, 140.0, 28)]
    assert sorted((r.page, r.y0) for r in edits if r.step == 3 and r.operation == "delete_link") == [(2, 105.0), (15, 0.0)]
    empty = composite.section_edits(plans.where("1 = 0"), entries.where("1 = 0"), rows, links, bodies)
    assert empty.count() == 0


def test_overlaps_on_a_grid(spark):
    """Against the join of all pairs: sizes from points to beyond any page, sides that touch, points, repeated and null ones, and ends in the wrong turn."""
    rng = random.Random(9)

    def some(n):
        out = []
        for _ in range(n):
            size = rng.choice([0, 1, 30, 32, 33, 200, 3000, 50_000])
            x, y = rng.choice([rng.randint(0, 600), rng.randint(-40_000, 40_000)]), rng.randint(0, 800)
            out.append((rng.choice([1, 1, 1, 2]), float(x), float(y), float(x + rng.randint(0, size)), float(y + rng.randint(0, size))))
        return [*out, *out[:9], (1, None, 0.0, 9.0, 9.0), (None, 0.0, 0.0, 9.0, 9.0), (1, 50.0, 60.0, 40.0, 70.0), (1, -1e300, 0.0, 1e300, 1.0)]

    schema = "page int, x0 double, y0 double, x1 double, y1 double"
    a, b = some(500), some(25)
    near = lambda r, o: None not in (*r, *o) and r[0] == o[0] and r[1] < o[3] and o[1] < r[3] and r[2] < o[4] and o[2] < r[4]
    want = Counter(r for r in a if any(near(r, o) for o in b))
    rects, others = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b))
    got = contents.overlapping_on_grid(rects, others, ["page"])
    assert got.columns == rects.columns and Counter(map(tuple, got.collect())) == want and 0 < sum(want.values()) < 500
    assert Counter(map(tuple, contents.overlapping(rects, others, ["page"]).collect())) == want


def test_a_crowded_page(spark):
    """100,000 rectangles of one page: the join is by equal cells, and no task compares all with all."""
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("double")
    made = lambda n, seed: spark.range(n).select(F.lit(1).alias("page"), place(seed, 60_000).alias("x0"), place(seed + 1, 60_000).alias("y0"), place(seed + 2, 20).alias("w"), place(seed + 3, 20).alias("h")).select("page", (F.col("x0") / 100).alias("x0"), (F.col("y0") / 100).alias("y0"), ((F.col("x0") + F.col("w") * 20) / 100).alias("x1"), ((F.col("y0") + F.col("h") * 20) / 100).alias("y1"))
    rects, others = made(100_000, 1), made(2_000, 11)
    got = contents.overlapping_on_grid(rects, others, ["page"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    cells = contents._cells(rects, "home").groupBy("page", "_level", "_x", "_y").count().agg(F.max("count")).first()[0]
    assert cells < 1500
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, contents.overlapping(rects, others, ["page"]).collect()))
