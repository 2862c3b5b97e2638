"""Running values by ranges against one pass in plain Python, and against windows over whole groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import contents, headings, layout, scans
from leafmill.sources.layout import read, virtual_lines

SF = "/root/testdata/sf0.001"


def test_running_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([*range(300), None]), i, rng.choice([None, *range(-9, 9)])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc string, page int, n int, v int").repartition(7)
    values = {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "seen": ("last", F.col("v")), "place": ("sum", F.lit(1))}
    got = scans.running(table, ["doc"], ["page", "n"], scans.page_range("page", 10), values)
    assert got.columns == ["doc", "page", "n", "v", *values]
    want = []
    for doc in ("a", "b", None):
        own, seen, last = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), [], None
        for place, r in enumerate(own, 1):
            seen += [r[3]] * (r[3] is not None)
            last = r[3] if r[3] is not None else last
            want.append((*r, sum(seen), min(seen, default=None), max(seen, default=None), last, place))
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_a_document_is_in_many_tasks(spark):
    """All rows are one document's: the most that a task has of them is a range's, and the rows are those of a window."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("1 AS doc", "id AS page", "cast(1 + id * 7919 % 5 AS int) AS level")
        got = headings.clamp_levels_in_ranges(rows, "level", ["doc"], ["page"], scans.page_range("page", 100))
        tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) > 4 and max(r["count"] for r in tasks) < 8000
        want = headings.clamp_levels(rows, "level", ["doc"], ["page"])
        assert Counter(map(tuple, got.select("page", "level").collect())) == Counter(map(tuple, want.select("page", "level").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    rows = spark.createDataFrame([], "doc int, page int, level int")
    cut = scans.page_range("page")
    assert headings.clamp_levels_in_ranges(rows, "level", ["doc"], ["page"], cut).count() == 0
    assert contents.paginate_in_ranges(rows, ["doc"], ["page"], cut).count() == 0


@pytest.mark.parametrize("lines_a_page", [50, 3])
def test_headings_of_long_documents(spark, lines_a_page):
    """All texts of a source as one long document: the same headings, however many pages lie in a range."""
    lines = virtual_lines(read(spark, SF, "documents"), lines_a_page).withColumn("page_number", (F.col("page_number") + F.col("doc_id") * 100).cast("int")).withColumn("doc_id", F.col("doc_id") % 3)
    want = headings.detect_headings(layout.with_spacing(layout.without_boilerplate(lines, 0.05)))
    got = headings.detect_headings_in_ranges(lines, 0.05, pages=150)
    assert want.count() > 100 and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_middles_by_counts(spark):
    rng = random.Random(9)
    rows = [(d, rng.choice([9.04, 9.96, 10.0, 12.5, 14.0, None]), rng.random() < 0.5, rng.choice(["short", "x" * 50])) for d in range(40) for _ in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, "doc_id int, font_size double, is_bold boolean, text string")
    want = {r.doc_id: r.body_font_size for r in layout.body_fonts(table).collect()}
    got = {r.doc_id: r.body_font_size for r in layout.body_fonts_by_counts(table).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
