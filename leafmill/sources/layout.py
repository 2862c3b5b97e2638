"""Layout tables: a synthetic layout of plain texts, and lines from spans and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

LINES_ON_PAGE, WIDTH, HEIGHT = 50, 612.0, 792.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual_lines(docs: DataFrame, on_page: int = LINES_ON_PAGE) -> DataFrame:
    """S1 on texts without layout. A synthetic one: a document's non-blank lines, 50 (on_page) to a page, in three styles by place.

    No step goes over documents, so partitions of documents stay what they are.
    """
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.col("text").rlike(r"(?U)\S"))
    place, style = F.col("pos") % on_page, F.col("pos") % 5
    return rows.select(
        "doc_id", (F.floor(F.col("pos") / on_page) + 1).cast("int").alias("page_number"), F.col("pos").alias("line_order"), "text",
        F.when(style == 0, 16.0).when(style == 3, 13.0).otherwise(10.0).alias("font_size"), style.isin(0, 3).alias("is_bold"),
        F.lit(72.0).alias("x0"), (72.0 + 14 * place).alias("y0"), F.lit(540.0).alias("x1"), (82.0 + 14 * place).alias("y1"),
        F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), X.repetition_key(F.col("text")).alias("normalized_text"),
    )


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Spans of a line in order of x; mean font size by characters, the font of the first longest span, bold if any is."""
    key = ["doc_id", "page_number", "block_number", "line_number"]
    rows = spans.where(F.trim("text") != "").withColumn("w", F.length("text"))
    longest = F.max_by("font", F.struct("w", -F.col("span_number")))
    return rows.groupBy(*key).agg(
        X.normalize_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_number", "text"))), lambda s: s["text"]), " ")).alias("text"),
        F.bround(F.sum(F.col("size") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1)), 2).alias("font_size"), longest.alias("font_name"),
        F.bool_or(X.is_bold(F.col("font"), F.col("flags"))).alias("is_bold"),
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
    )


def lines_from_words(words: DataFrame) -> DataFrame:
    """Words of a block and line in order of x."""
    one = F.array_sort(F.collect_list(F.struct("x0", "word_number", "text")))
    return words.groupBy("doc_id", "page_number", "block_number", "line_number").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_join(F.transform(one, lambda s: s["text"]), " ").alias("text"))


def image_coverage(images: DataFrame, page_area: float = WIDTH * HEIGHT) -> DataFrame:
    """Share of a page's area that distinct images cover, one at most."""
    rect = [F.bround(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = images.select("doc_id", "page_number", *rect).distinct()
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rows.groupBy("doc_id", "page_number").agg(F.least(F.lit(1.0), F.sum(area) / F.greatest(F.lit(page_area), F.lit(1.0))).alias("coverage"))


def needs_ocr(n_words, coverage):
    """S8."""
    return (n_words <= 8) & (coverage >= 0.35)


def segments(drawings: DataFrame) -> DataFrame:
    """Drawings as vertical (h >= 6, w <= 4) and horizontal (w >= 8, h <= 4) segments; lines (kind l, not re) at most half a point thin are padded by half a point."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    line = F.coalesce(F.col("kind") == "l", F.lit(False)) if "kind" in drawings.columns else F.lit(True)
    pad = lambda c, by, thin: F.when(line & (thin <= 0.5), F.col(c) + by).otherwise(F.col(c)).alias(c)
    rows = drawings.select("doc_id", "page_number", pad("x0", -0.5, w), pad("y0", -0.5, h), pad("x1", 0.5, w), pad("y1", 0.5, h))
    kind = F.when((h >= 6) & (w <= 4), "vertical").when((w >= 8) & (h <= 4), "horizontal")
    return rows.withColumn("segment", kind).where("segment is not null").select("doc_id", "page_number", "segment", "x0", "y0", "x1", "y1")
