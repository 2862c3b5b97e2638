"""Lines of pages: boilerplate, spacing, body font, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X


def is_footer(y0: Column, height: Column) -> Column:
    """F2."""
    return y0 >= height - F.greatest(F.lit(72.0), height * 0.08)


def repeated_texts(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """A4: texts of headers and footers on at least max(3, share of the pages) pages of a document."""
    y0, h = F.col("y0"), F.col("page_height")
    zone = lines.where((y0 <= F.greatest(F.lit(90.0), h * 0.1)) | is_footer(y0, h))
    pages = lines.groupBy("doc_id").agg(F.max("page_number").alias("pages"))
    counts = zone.groupBy("doc_id", "normalized_text").agg(F.count_distinct("page_number").alias("n_pages"))
    return counts.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).drop("pages")


def without_boilerplate(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """F1, with A4 as windows: lines are dealt by document once, and all that follows by document needs no other exchange."""
    rows = lines.repartition("doc_id")
    y0, h = F.col("y0"), F.col("page_height")
    zone = (y0 <= F.greatest(F.lit(90.0), h * 0.1)) | is_footer(y0, h)
    on_page = W.partitionBy("doc_id", "normalized_text", "page_number").orderBy(F.when(zone, 0).otherwise(1), "line_order")
    rows = rows.withColumn("_pages", F.max("page_number").over(W.partitionBy("doc_id")))
    # one mark for each page that has the text in a header or footer
    rows = rows.withColumn("_mark", F.when(zone & (F.row_number().over(on_page) == 1), 1).otherwise(0))
    rows = rows.withColumn("_again", F.sum("_mark").over(W.partitionBy("doc_id", "normalized_text")) >= F.greatest(F.lit(3), F.floor(F.col("_pages") * share)))
    edge = (y0 <= F.greatest(F.lit(120.0), h * 0.12)) | is_footer(y0, h)
    own = ~F.trim("text").rlike(X.PAGE_NUMBER) & ~F.col("text").rlike(X.COPYRIGHT)
    return rows.where(own & ~(edge & F.col("_again"))).select(*lines.columns)


def with_spacing(lines: DataFrame) -> DataFrame:
    """W1."""
    page = W.partitionBy("doc_id", "page_number").orderBy("y0", "x0", "line_order")
    before, after = F.col("y0") - F.lag("y1").over(page), F.lead("y0").over(page) - F.col("y1")
    floor = lambda d: F.when(d.isNull(), 99.0).otherwise(F.greatest(F.lit(0.0), d))
    return lines.withColumns({"spacing_before": floor(before), "spacing_after": floor(after)})


def body_fonts(lines: DataFrame) -> DataFrame:
    """A1: median size of plain lines of 20 to 180 characters, else of all lines, else 10."""
    size = F.bround("font_size", 1)
    plain = F.when(~F.col("is_bold") & F.length("text").between(20, 180), size)
    return lines.groupBy("doc_id").agg(F.coalesce(F.median(plain), F.median(size), F.lit(10.0)).alias("body_font_size"))


def body_fonts_by_counts(lines: DataFrame, length: Column | None = None) -> DataFrame:
    """A1 of documents of any size (length: of the text, where lines don't have it): lines are counted by rounded size, and the middle is found by running sums over the sizes, which are few."""
    plain = ~F.col("is_bold") & (F.length("text") if length is None else length).between(20, 180)
    counts = lines.groupBy("doc_id", F.bround("font_size", 1).alias("size")).agg(F.count_if(plain).alias("plain"), F.count("font_size").alias("every"))
    of, upto = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    rows, middles = counts.where("size is not null"), {}
    for n in ("plain", "every"):
        rows = rows.withColumns({f"{n}_n": F.sum(n).over(of), f"{n}_to": F.sum(n).over(upto)})
        # the first size that reaches the lower and the upper middle place
        reach = lambda place, n=n: F.min(F.when(F.col(f"{n}_to") >= place, F.col("size")))
        lower, upper = F.floor((F.col(f"{n}_n") + 1) / 2), F.floor(F.col(f"{n}_n") / 2) + 1
        middles[n] = F.when(F.max(f"{n}_n") > 0, (reach(lower) + reach(upper)) / 2)
    found = rows.groupBy("doc_id").agg(middles["plain"].alias("plain"), middles["every"].alias("every"))
    return counts.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("plain", "every", F.lit(10.0)).alias("body_font_size"))


def left_margins(lines: DataFrame, length: Column | None = None) -> DataFrame:
    """A2 (length: of the text, where lines don't have it): the most frequent x0 of lines over 20 characters, to multiples of five; of equals the one seen first; else 0."""
    x = (F.bround(F.col("x0") / 5) * 5).alias("x")
    long = lines.where((F.length("text") if length is None else length) > 20).select("doc_id", x, F.struct("page_number", "y0", "line_order").alias("at"))
    counts = long.groupBy("doc_id", "x").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    best = counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "x")
    return lines.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("x", F.lit(0.0)).alias("left_margin"))


def with_measures(lines: DataFrame) -> DataFrame:
    """lines with A1 and A2 of their document, as windows: body_font_size and left_margin."""
    of, size = W.partitionBy("doc_id"), F.bround("font_size", 1)
    plain = F.when(~F.col("is_bold") & F.length("text").between(20, 180), size)
    x = F.when(F.length("text") > 20, F.bround(F.col("x0") / 5) * 5)
    seen = F.struct((-F.col("page_number")).alias("p"), (-F.col("y0")).alias("y"), (-F.col("line_order")).alias("l"))
    of_x = W.partitionBy("doc_id", "_x")
    rows = lines.withColumn("_x", x).withColumn("_n", F.count("_x").over(of_x)).withColumn("_first", F.max(F.when(F.col("_x").isNotNull(), seen)).over(of_x))
    best = F.max(F.when(F.col("_x").isNotNull(), F.struct("_n", "_first", "_x"))).over(of)
    rows = rows.withColumn("body_font_size", F.coalesce(F.median(plain).over(of), F.median(size).over(of), F.lit(10.0)))
    return rows.withColumn("left_margin", F.coalesce(best["_x"], F.lit(0.0))).drop("_x", "_n", "_first")


def page_stats(lines: DataFrame) -> DataFrame:
    """Lines, words and characters of pages."""
    return lines.groupBy("doc_id", "page_number").agg(F.count("*").alias("n_lines"), F.sum(X.word_count(F.col("text"))).alias("n_words"), F.sum(F.length("text")).alias("n_characters"))


def document_stats(pages: DataFrame) -> DataFrame:
    """A10 of plain lines."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), *[F.sum(c).alias(c) for c in ("n_lines", "n_words", "n_characters")])


def document_totals(blocks: DataFrame, spans: DataFrame, links: DataFrame, annotations: DataFrame) -> DataFrame:
    """A10 and C11: per document its eight sums and its fonts, sorted, by one aggregate of small rows.

    blocks: doc_id, kind (text or image). spans: doc_id, page_number, block_number, line_number, text, font. links, annotations: doc_id. Words
    are counted in spans' texts, lines as distinct places; a document that only some of the tables have gets zeros for the others.
    """
    names = ["text_blocks", "image_blocks", "lines", "spans", "words", "characters", "links", "annotations"]
    row = lambda df, **n: df.select("doc_id", *[n.get(c, F.lit(0)).cast("long").alias(c) for c in names], n.get("font", F.lit(None).cast("string")).alias("font"))
    line = spans.select("doc_id", "page_number", "block_number", "line_number").distinct()
    own = spans.groupBy("doc_id", "font").agg(F.count("*").alias("n"), F.sum(X.word_count(F.col("text"))).alias("w"), F.sum(F.length("text")).alias("c"))
    parts = [
        row(blocks, text_blocks=F.when(F.col("kind") == "text", 1).otherwise(0), image_blocks=F.when(F.col("kind") == "image", 1).otherwise(0)),
        row(line, lines=F.lit(1)), row(own, spans=F.col("n"), words=F.col("w"), characters=F.col("c"), font=F.nullif("font", F.lit(""))),
        row(links, links=F.lit(1)), row(annotations, annotations=F.lit(1)),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in names], F.array_sort(F.collect_set("font")).alias("fonts"))


def _in_lines(words: DataFrame, order: list[str], tolerance: float) -> DataFrame:
    """Words of a page, in turn, each in the first line whose mean centre lies within the tolerance; lines numbered from the top, then from the left."""
    import pandas as pd

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, kind="stable")
        sums, sizes, tops, lefts, own = [], [], [], [], []
        for x, y, end in zip(page["x0"], page["y0"], page["y1"]):
            centre = (y + end) / 2
            i = next((i for i, (s, n) in enumerate(zip(sums, sizes)) if abs(s / n - centre) <= tolerance), len(sums))
            if i == len(sums):
                sums.append(0.0), sizes.append(0), tops.append(y), lefts.append(x)
            sums[i], sizes[i], tops[i], lefts[i] = sums[i] + centre, sizes[i] + 1, min(tops[i], y), min(lefts[i], x)
            own.append(i)
        place = {i: n for n, i in enumerate(sorted(range(len(sums)), key=lambda i: (tops[i], lefts[i])))}
        return page.assign(visual_line=[place[i] for i in own])[["doc_id", "page_number", "word_number", "text", "visual_line"]]

    kind = dict(words.dtypes)["doc_id"]
    rows = words.where(F.trim("text") != "").select("doc_id", "page_number", "word_number", "text", "x0", "y0", "y1")
    return rows.groupBy("doc_id", "page_number").applyInPandas(fold, f"doc_id {kind}, page_number int, word_number int, text string, visual_line int")


def visual_lines(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Words of a page, in order of y0 and x0, in lines; word_number must tell a page's words apart."""
    return _in_lines(words, ["y0", "x0", "word_number"], tolerance)


def listed_lines(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """W21 for lists of pages: words in their own order, with y0 from 85 to the lesser of 600 and 120 above the page's end."""
    zone = (F.col("y0") >= 85.0) & (F.col("y0") <= F.least(F.lit(600.0), F.col("page_height") - 120.0))
    return _in_lines(words.where(zone), ["word_number"], tolerance)


def merged_positions(positions: Column, tolerance: float = 2.0) -> Column:
    """Sorted positions in groups by distance to the group's mean, as the groups' means."""
    step = lambda a, p: F.when((F.size(a) > 0) & (F.abs(F.element_at(a, -1)["s"] / F.element_at(a, -1)["n"] - p) <= tolerance), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct((F.element_at(a, -1)["s"] + p).alias("s"), (F.element_at(a, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(a, F.array(F.struct(p.alias("s"), F.lit(1).alias("n")))))
    groups = F.aggregate(F.array_sort(positions), F.expr("cast(array() as array<struct<s: double, n: int>>)"), step)
    return F.transform(groups, lambda g: g["s"] / g["n"])
