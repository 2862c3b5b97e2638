"""Cells of ruled tables: bounds from grid lines, a page header's revision cells, rows of lists of effective pages.

Segments are those of sources.layout.segments. What is collected are the words and grid lines near one header or one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.layout import HEIGHT, WIDTH
from .layout import merged_positions
from .pages import HEADER_REVISION, PAGE

# Words that begin a date, and the form of a year.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
YEAR = r"^(?:19|20)\d{2}$"
_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def box(x0, y0, x1, y1) -> Column:
    named = zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(c) for v, c in named])


def union(boxes: Column) -> Column:
    """The least box about an array of boxes; null for none."""
    side = lambda c, pick: pick(F.transform(boxes, lambda b: b[c]))
    return F.when(F.size(boxes) > 0, box(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)))


def vertical_overlap(a: Column, b: Column) -> Column:
    """H8."""
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


# Cells between grid positions --------------------------------------------


def cell_around(text: Column, positions: Column, top: Column, bottom: Column) -> Column:
    """The cell whose sides are the nearest positions half a point or more beyond the text; null if one is missing or they are too close."""
    left = F.array_max(F.filter(positions, lambda x: x <= text["x0"] - 0.5))
    right = F.array_min(F.filter(positions, lambda x: x >= text["x1"] + 0.5))
    return F.when(right - left >= F.greatest(F.lit(14.0), text["x1"] - text["x0"] + 2), box(left, top, right, bottom))


def next_cell(cell: Column, positions: Column, top: Column, bottom: Column) -> Column:
    right = F.array_min(F.filter(positions, lambda x: x > cell["x1"] + 0.5))
    return F.when(right - cell["x1"] >= 12, box(cell["x1"], top, right, bottom))


def previous_cell(cell: Column, positions: Column, top: Column, bottom: Column) -> Column:
    left = F.array_max(F.filter(positions, lambda x: x < cell["x0"] - 0.5))
    return F.when(cell["x0"] - left >= 12, box(left, top, cell["x0"], bottom))


def row_bounds(verticals: Column, horizontals: Column, text: Column, above: float, below: float) -> tuple[Column, Column]:
    """Top and bottom of a text's row: the nearest horizontal within reach on each side, else the ends of the verticals; of equally near ones the upper."""
    over = F.filter(horizontals, lambda r: (r["y1"] <= text["y0"] + 3) & (F.abs(r["y1"] - text["y0"]) <= above))
    under = F.filter(horizontals, lambda r: (r["y0"] >= text["y1"] - 3) & (F.abs(r["y0"] - text["y1"]) <= below))
    top = F.array_min(F.transform(over, lambda r: F.struct(F.abs(r["y1"] - text["y0"]).alias("d"), r["y0"].alias("y"))))["y"]
    bottom = F.array_min(F.transform(under, lambda r: F.struct(F.abs(r["y0"] - text["y1"]).alias("d"), r["y1"].alias("y"))))["y"]
    return F.coalesce(top, F.array_min(F.transform(verticals, lambda r: r["y0"]))), F.coalesce(bottom, F.array_max(F.transform(verticals, lambda r: r["y1"])))


def grid_positions(verticals: Column, left: Column, right: Column, tolerance: float) -> Column:
    """Centres of verticals within left to right, those close together as one."""
    centres = F.transform(verticals, lambda r: (r["x0"] + r["x1"]) / 2)
    return merged_positions(F.filter(centres, lambda x: x.between(left, right)), tolerance)


def _grids(segments: DataFrame) -> DataFrame:
    """Per page arrays of verticals and horizontals, in order of place."""
    one = box(*map(F.col, ("x0", "y0", "x1", "y1")))
    kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("segment") == k, one))).alias(k + "s")
    return segments.groupBy(*PAGE).agg(kind("vertical"), kind("horizontal"))


def _with_grids(rows: DataFrame, segments: DataFrame) -> DataFrame:
    none = F.expr(f"cast(array() as array<{_BOX}>)")
    return rows.join(_grids(segments), PAGE, "left").withColumns({c: F.coalesce(c, none) for c in ("verticals", "horizontals")})


# A page header's cells ----------------------------------------------------


def _is_date_word(word: Column) -> Column:
    return F.substring(word, 1, 3).isin(*MONTHS) | word.rlike(YEAR)


def date_words(words: Column) -> Column:
    """The first words of an array (text and a box) that make up a date: from the first month or year on at most three, up to a year after it."""

    def step(a: Column, w: Column) -> Column:
        word = F.regexp_replace(F.upper(F.trim(w["text"])), r"[.,]+$", "")
        more, began = _is_date_word(word), F.size(a["found"]) > 0
        takes = ~a["done"] & more & (F.size(a["found"]) < 3)
        done = a["done"] | (began & (~takes | word.rlike(YEAR)))
        return F.struct(F.when(takes, F.concat(a["found"], F.array(w))).otherwise(a["found"]).alias("found"), done.alias("done"))

    none = F.filter(words, lambda w: F.lit(False))
    return F.aggregate(words, F.struct(none.alias("found"), F.lit(False).alias("done")), step)["found"]


def _padded(b: Column) -> Column:
    return box(b["x0"] - 1.5, b["y0"] - 1.5, b["x1"] + 2.5, b["y1"] + 2.5)


def header_cells(words: DataFrame, segments: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Per page whose header has a word REV: issue, rev and date (boxes, issue may be null), font_size and ruled (whether the cells come from grid lines).

    Without a grid that encloses the revision and a date the cells are drawn about the words, and where there is no date, right of the revision.
    """
    word = F.struct("y0", "x0", "word_number", "x1", "y1", F.trim("text").alias("text"))
    top = words.where(F.col("y0") <= min(145.0, height * 0.2)).groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    rows = top.withColumn("rev", F.get(F.filter("words", lambda w: w["text"].rlike("(?i)^REV")), F.lit(0))).where("rev is not null")
    middle = lambda w: (w["y0"] + w["y1"]) / 2
    line = F.filter("words", lambda w: F.abs(middle(w) - middle(F.col("rev"))) <= 4)
    by_x = F.array_sort(F.transform(line, lambda w: F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["word_number"].alias("word_number"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text"))))
    rows = rows.withColumn("line", by_x)
    at = F.array_position(F.transform("line", lambda w: F.struct(w["x0"], w["y0"], w["word_number"])), F.struct(F.col("rev.x0"), F.col("rev.y0"), F.col("rev.word_number"))).cast("int")
    rows = rows.withColumn("at", at)
    after = F.get("line", F.col("at"))
    bare = F.col("rev.text").rlike(HEADER_REVISION) & (F.regexp_extract("rev.text", HEADER_REVISION, 1) == "")
    rows = rows.withColumn("n_rev", F.when(bare & after["text"].rlike(r"(?i)^\d{1,3}[A-Z]?$"), 2).otherwise(1))
    issue = F.element_at(F.filter(F.slice("line", F.lit(1), F.col("at") - 1), lambda w: F.upper(w["text"]).startswith("ISSUE")), -1)
    found = date_words(F.slice("line", F.col("at") + F.col("n_rev"), F.size("line")))
    issue = F.when(F.exists(F.slice("line", F.lit(1), F.col("at") - 1), lambda w: F.upper(w["text"]).startswith("ISSUE")), issue)
    rows = rows.withColumns({"rev_text": union(F.slice("line", F.col("at"), F.col("n_rev"))), "date_text": union(found), "issue_text": F.when(issue.isNotNull(), box(issue["x0"], issue["y0"], issue["x1"], issue["y1"])), "line_text": union(F.col("line"))})
    rows = rows.select(*PAGE, "rev_text", "date_text", "issue_text", "line_text")
    rows = _with_grids(rows, segments.where(F.col("y0") <= min(150.0, height * 0.22)))
    return _loose_cells(_ruled_cells(rows), width).select(*PAGE, "issue", "rev", "date", "font_size", "ruled")


def _ruled_cells(rows: DataFrame) -> DataFrame:
    """rows with the grid's cells in g (null where there are none)."""
    rev = F.col("rev_text")
    focus = union(F.filter(F.array("rev_text", "date_text", "issue_text"), lambda b: b.isNotNull()))
    at = (rev["y0"] + rev["y1"]) / 2
    rows = rows.withColumns({"focus": focus, "near": F.filter("verticals", lambda r: (r["y0"] - 5 <= at) & (at <= r["y1"] + 5))})
    level = F.filter("near", lambda r: vertical_overlap(r, rev) >= F.least(F.lit(4.5), (rev["y1"] - rev["y0"]) * 0.35))
    rows = rows.withColumn("near", F.when(F.size(level) >= 3, level).otherwise(F.col("near")))
    tallest = F.array_max(F.transform("near", lambda r: r["y1"] - r["y0"]))
    rows = rows.withColumn("near", F.filter("near", lambda r: r["y1"] - r["y0"] >= F.greatest(F.lit(8.0), tallest * 0.6)))
    top, bottom = row_bounds(F.col("near"), F.col("horizontals"), rev, above=10, below=12)
    rows = rows.withColumns({"top": top, "bottom": bottom})
    fits = (F.col("bottom") - F.col("top")).between(8, 32)
    rows = rows.withColumns({"top": F.when(fits, F.col("top")).otherwise(F.col("focus.y0") - 2), "bottom": F.when(fits, F.col("bottom")).otherwise(F.col("focus.y1") + 3)})
    rows = rows.withColumn("at_x", grid_positions(F.col("near"), F.col("focus.x0") - 55, F.col("focus.x1") + 90, 2.2))
    sides = (F.col("at_x"), F.col("top"), F.col("bottom"))
    enough = (F.size("near") >= 3) & (F.size("at_x") >= 3)
    rows = rows.withColumn("_rev", F.when(enough, cell_around(rev, *sides)))
    date = F.when(F.col("date_text").isNotNull(), cell_around(F.col("date_text"), *sides)).otherwise(next_cell(F.col("_rev"), *sides))
    issue = F.coalesce(cell_around(F.col("issue_text"), *sides), previous_cell(F.col("_rev"), *sides))
    rows = rows.withColumns({"_date": date, "_issue": issue})
    size = F.greatest(F.lit(7.0), F.least(F.lit(9.2), (F.col("bottom") - F.col("top")) * 0.48))
    whole = F.col("_rev").isNotNull() & F.col("_date").isNotNull()
    return rows.withColumn("g", F.when(whole, F.struct(F.col("_issue").alias("issue"), F.col("_rev").alias("rev"), F.col("_date").alias("date"), size.alias("font_size"))))


def _loose_cells(rows: DataFrame, width: float) -> DataFrame:
    """rows with issue, rev, date, font_size and ruled: those of g, or else boxes about the words."""
    rows = rows.withColumns({"r": _padded(F.col("rev_text")), "d": _padded(F.col("date_text"))})
    has_date = F.col("date_text").isNotNull()
    narrow = F.col("r.x1") - F.col("r.x0") < 34
    dated = F.when(narrow, F.least(F.col("d.x0") - 2, F.col("r.x0") + 36)).otherwise(F.col("r.x1"))
    alone = F.least(F.lit(width - 88), F.greatest(F.col("r.x1"), F.col("r.x0") + 38))
    rows = rows.withColumn("right", F.when(has_date, dated).otherwise(alone))
    x0 = F.when(has_date, F.col("d.x0")).otherwise(F.least(F.lit(width - 84), F.col("right") + 4))
    x1 = F.when(has_date, F.col("d.x1")).otherwise(F.least(F.lit(width - 8), F.col("right") + 78))
    line = F.col("line_text")
    upper = lambda c: F.least(F.col(c), line["y0"] - 1.5)
    lower = lambda c: F.greatest(F.col(c), line["y1"] + 2.5)
    rev = box(F.col("r.x0"), upper("r.y0"), F.col("right"), lower("r.y1"))
    date = F.when(has_date, box(x0, upper("d.y0"), x1, lower("d.y1"))).otherwise(box(x0, upper("r.y0"), x1, lower("r.y1")))
    size = F.greatest(F.lit(7.0), F.least(F.lit(9.5), (line["y1"] - line["y0"]) * 0.68))
    return rows.withColumns({"issue": F.col("g.issue"), "rev": F.coalesce("g.rev", rev), "date": F.coalesce("g.date", date), "font_size": F.coalesce("g.font_size", size), "ruled": F.col("g").isNotNull()})


# Rows of lists of effective pages ----------------------------------------------


def effective_cells(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """X27 for entries (PAGE, label_text, date_text, rev_text: boxes, date_text may be null): label_cell, date_cell, rev_cell, all null without a grid about all three."""
    fallback = box(F.col("label_text.x1") + 10, F.col("label_text.y0") - 1, F.col("label_text.x1") + 74, F.col("label_text.y1") + 2)
    rows = _with_grids(entries.withColumn("_date", F.coalesce("date_text", fallback)), segments)
    row = union(F.array("label_text", "_date", "rev_text"))
    rows = rows.withColumn("_row", row)
    at = (F.col("_row.y0") + F.col("_row.y1")) / 2
    rows = rows.withColumn("_near", F.filter("verticals", lambda r: (r["y0"] - 4 <= at) & (at <= r["y1"] + 4)))
    top, bottom = row_bounds(F.col("_near"), F.col("horizontals"), F.col("_row"), above=8, below=8)
    rows = rows.withColumns({"_top": top, "_bottom": bottom, "_x": grid_positions(F.col("_near"), F.col("label_text.x0") - 18, F.col("rev_text.x1") + 28, 2.0)})
    cells = {name: cell_around(F.col(c), F.col("_x"), F.col("_top"), F.col("_bottom")) for name, c in (("label_cell", "label_text"), ("date_cell", "_date"), ("rev_cell", "rev_text"))}
    rows = rows.withColumns(cells)
    whole = (F.size("_near") >= 4) & (F.size("_x") >= 4) & F.col("label_cell").isNotNull() & F.col("date_cell").isNotNull() & F.col("rev_cell").isNotNull()
    rows = rows.withColumns({name: F.when(whole, F.col(name)) for name in cells})
    return rows.select(*entries.columns, *cells)


#: Where rows of a blank page begin, and how far they are apart.
BLANK_FIRST_Y, BLANK_LINE = 140.0, 12.0


def blank_page_rows(height: Column) -> Column:
    """Rows of one column of a blank page (12 points each, from 140 to the body's end)."""
    return F.greatest(F.lit(1), F.floor((F.least(F.lit(590.0), height - 175) - 140) / 12).cast("int"))


def blank_page_columns(width: Column) -> Column:
    """Places of label, date and revision in a blank page's three columns."""
    column = lambda x, date, rev: F.struct(x.alias("label_x"), (x + date).alias("date_x"), (x + rev).alias("rev_x"))
    wide = F.array(*[column(F.lit(x), 62, 122) for x in (80.0, 230.0, 380.0)])
    step = F.greatest(F.lit(360.0), width - 120) / 3
    return F.when(width >= 550, wide).otherwise(F.array(*[column(60 + step * i, 42, 100) for i in range(3)]))


def page_label(regions: Column, page_number: Column) -> Column:
    """The first label in a page's top and bottom regions, else its number."""
    return F.coalesce(F.get(X.reference_labels(regions), F.lit(0)), F.concat(F.lit("PDF page "), page_number.cast("string")))
