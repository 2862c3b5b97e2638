"""Tables of items (item label, description, remarks): their geometry, and a row for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.layout import HEIGHT, WIDTH
from .contents import first_wins
from .pages import PAGE, words_text

# Words of a table's head, lines that are its head, words that begin what comes after it.
HEADER_WORDS = ("CATEGORY", "DESCRIPTION", "DISPATCH", "EXCEPTIONS", "FOR", "INSTALLED", "ITEM", "NUMBER", "OR", "REMARKS", "REQUIRED")
HEADER_LINES = ("ITEM", "DESCRIPTION", "ITEM DESCRIPTION", "REMARKS OR EXCEPTIONS", "CATEGORY", "NUMBER INSTALLED", "NUMBER REQUIRED FOR DISPATCH")
STOP = r"(?i)^(MAINTENANCE|OPERATIONS?|OPERATIONAL|DISPATCH|CREW|NOTE\b|DEACTIVATION|RESTORATION)\b"


def _own_label(word: Column) -> Column:
    """Whether a word is an item label, of the page's chapter if that has one."""
    return X.is_item_label(word["text"]) & (F.col("chapter").isNull() | X.normalize_label(word["text"]).startswith(F.concat("chapter", F.lit("-"))))


def _upper_median(xs: Column) -> Column:
    """A5."""
    return X.bound(F.array_sort(xs), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def geometry(lines: DataFrame, pages: DataFrame, width: float = WIDTH) -> DataFrame:
    """item_left, item_right, description_left, description_right, top_y of each page that has a table.

    From the words ITEM and, right of it within 8 points of its height, the nearest DESCRIPTION; REMARKS bounds the latter. Without
    them from the upper medians of item labels and of the words beyond, if two lines have labels. lines as of pages.word_lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct("y0", "y1", "x0", "block_number", "line_number", "words")))
    page = lines.groupBy(*PAGE).agg(F.transform(ordered, lambda r: r["words"]).alias("rows"))
    page = page.join(pages.select(*PAGE, X.ata_chapter(F.col("text")).alias("chapter")), PAGE, "left")
    named = lambda name: F.filter(F.flatten("rows"), lambda w: F.upper(F.trim(w["text"])) == name)
    page = page.withColumns({"items": named("ITEM"), "descriptions": named("DESCRIPTION"), "remarks": named("REMARKS")})
    level = lambda w, i: F.abs(w["y0"] - i["y0"]) <= 8
    near = lambda i: F.array_min(F.transform(F.filter("descriptions", lambda d: (d["x0"] > i["x0"]) & level(d, i)), lambda d: F.struct(d["x0"].alias("x0"), d["y1"].alias("y1"))))
    heads = F.filter(F.transform("items", lambda i: F.struct(i.alias("item"), near(i).alias("about"))), lambda h: h["about"].isNotNull())
    page = page.withColumn("head", F.get(heads, F.lit(0)))
    beyond = F.array_min(F.transform(F.filter("remarks", lambda r: (r["x0"] > F.col("head.about.x0")) & level(r, F.col("head.item"))), lambda r: r["x0"]))
    labelled = F.filter(F.transform("rows", lambda ws: F.struct(F.get(F.filter(ws, _own_label), F.lit(0)).alias("label"), ws.alias("words"))), lambda r: r["label"].isNotNull())
    page = page.withColumns({"beyond": beyond, "labelled": labelled})
    others = F.flatten(F.transform("labelled", lambda r: F.transform(F.filter(r["words"], lambda w: (w["x0"] > r["label"]["x0"] + 36) & ~X.is_item_label(w["text"])), lambda w: w["x0"])))
    by_head = F.col("head").isNotNull()
    item_x = F.when(by_head, F.col("head.item.x0")).otherwise(_upper_median(F.transform("labelled", lambda r: r["label"]["x0"])))
    about_x = F.when(by_head, F.col("head.about.x0")).otherwise(F.coalesce(_upper_median(others), F.col("item_x") + 96))
    page = page.where(by_head | (F.size("labelled") >= 2)).withColumn("item_x", item_x).withColumn("about_x", about_x)
    right = F.when(by_head, F.least(F.col("about_x") + 125, F.col("beyond") - 64)).otherwise(F.col("about_x") + 180)
    top = F.when(by_head, F.greatest("head.item.y1", "head.about.y1") + 4).otherwise(F.greatest(F.lit(80.0), F.array_min(F.transform("labelled", lambda r: r["label"]["y1"])) + 4))
    return page.select(
        *PAGE, "chapter", F.greatest(F.lit(0.0), F.col("item_x") - 24).alias("item_left"), F.greatest(F.col("item_x") + 38, F.col("about_x") - 8).alias("item_right"),
        F.greatest(F.lit(0.0), F.col("about_x") - 8).alias("description_left"), F.greatest(F.col("about_x") + 70, F.least(right, F.lit(width * 0.52))).alias("description_right"), top.alias("top_y"),
    )


def entries(lines: DataFrame, tables: DataFrame, height: float = HEIGHT) -> DataFrame:
    """PAGE, entry, label, title, x0, y0 of each item.

    A label starts an item and descriptions add to it. A stop word at the left ends the page. A line with neither, more than 260 points
    below the item's start, ends the item. Lines come by height, so an item's start is the height of its label's line.
    """
    rows = lines.join(tables, PAGE).where((F.col("y0") >= F.col("top_y")) & (F.col("y0") <= height - 45))
    rows = rows.where(~X.normalize_label(F.col("text")).isin(*HEADER_LINES))
    label = F.get(F.filter("words", lambda w: w["x0"].between(F.col("item_left"), F.col("item_right")) & _own_label(w)), F.lit(0))
    noise = lambda w: X.bound(X.normalize_label(w["text"]), lambda t: t.isin(*HEADER_WORDS) | ((w["x0"] > F.col("description_left") + 82) & t.rlike(r"^(?:[A-D]|\d+|\*+)$")) | X.is_item_label(t))
    described = F.filter("words", lambda w: (w["x0"] >= F.col("description_left")) & (w["x0"] < F.col("description_right")) & ~noise(w))
    stop = (F.col("x0") <= F.col("item_left") + 70) & X.normalize_label(F.col("text")).rlike(STOP)
    rows = rows.withColumns({"label": X.normalize_label(label["text"]), "described": words_text(described), "stop": stop})
    order = ["y0", "y1", "x0", "block_number", "line_number"]
    so_far = W.partitionBy(*PAGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    is_start = F.col("label").isNotNull()
    rows = rows.withColumns({"stopped": F.max("stop").over(so_far), "entry": F.sum(is_start.cast("int")).over(so_far), "start_y": F.last(F.when(is_start, F.col("y0")), ignorenulls=True).over(so_far)})
    rows = rows.where("not stopped and entry > 0")
    late = ~is_start & (F.col("described") == "") & (F.col("y1") - F.col("start_y") > 260)
    rows = rows.withColumn("ended", F.max(late).over(W.partitionBy(*PAGE, "entry").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("not ended")
    parts = F.array_sort(F.collect_list(F.when(F.col("described") != "", F.struct(*order, "described"))))
    made = rows.groupBy(*PAGE, "entry").agg(F.max("label").alias("label"), F.max(F.when(is_start, F.col("x0"))).alias("x0"), F.min("start_y").alias("y0"), parts.alias("parts"))
    title = X.normalize_text(F.concat_ws(" ", F.col("label"), F.array_join(F.transform("parts", lambda p: p["described"]), " ")))
    return made.select(*PAGE, "entry", "label", title.alias("title"), "x0", "y0")


def headings(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Items as headings; a document's first of each label."""
    found = first_wins(entries(lines, geometry(lines, pages)), ["doc_id", "label"], ["page_number", "entry"])
    return found.select(
        *PAGE, "entry", "label", "title", X.item_level(F.col("label")).alias("level"), F.lit(0.96).alias("confidence"), F.lit("mel_table").alias("source"),
        "x0", F.greatest(F.lit(0.0), F.col("y0") - 24).alias("y0"),
    )
