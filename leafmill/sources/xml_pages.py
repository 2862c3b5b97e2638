"""K6: pages of spans as XML, one page element a row; documents' metadata, one element a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PAGE = ["doc_id", "page_number"]
# The fields of a document's metadata, in their order.
METADATA = ("author", "creationDate", "creator", "encryption", "format", "keywords", "modDate", "producer", "subject", "title", "trapped")


def _box(x0, y0, x1, y1) -> list[Column]:
    return [X.number_text(F.col(c) if isinstance(c, str) else c).alias(f"_{name}") for c, name in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)]


def _ordered(key: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda s: s["v"])


def _listed(rows: DataFrame, name: str, order: list[str], *attributes: Column) -> DataFrame:
    """Per page name + s: a struct with the page's elements in order, each with its index."""
    element = F.struct(*order, F.struct(*attributes, *_box("x0", "y0", "x1", "y1")).alias("v"))
    items = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(element)).alias("all"))
    fields = [n for n in items.schema["all"].dataType.elementType["v"].dataType.names]
    return items.select(*PAGE, F.struct(F.transform("all", lambda e, i: F.struct(i.cast("string").alias("_index"), *[e["v"][f].alias(f) for f in fields])).alias(name)).alias(name + "s"))


def page_trees(spans: DataFrame, page_info: DataFrame, links: DataFrame | None = None, annotations: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Per page _doc_id, _number, _width, _height, _rotation and block (array of line, of span). A span's text is its value.

    links (PAGE, ord, kind, target_page from 1, uri, box) and annotations (PAGE, ord, type, content, box) add the elements links and
    annotations to pages that have some. images (PAGE, block_number, width, height, ext, box) are blocks among those of text. All levels are grouped within a page, so spans are shuffled once, by page.
    """
    text = F.struct(
        F.col("span_number").cast("string").alias("_index"), F.col("font").alias("_font"), X.number_text(F.col("size")).alias("_size"), X.color_hex(F.col("color")).alias("_color"),
        F.col("flags").cast("string").alias("_flags"), X.is_bold(F.col("font"), F.col("flags"), wide=False).cast("string").alias("_bold"), X.is_italic(F.col("font"), F.col("flags")).cast("string").alias("_italic"),
        *_box("x0", "y0", "x1", "y1"), F.col("text").alias("_VALUE"),
    )
    bounds = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = spans.repartition(*PAGE).groupBy(*PAGE, "block_number", "line_number").agg(_ordered("span_number", text).alias("span"), *bounds)
    line = F.struct(F.col("line_number").cast("string").alias("_index"), *_box("x0", "y0", "x1", "y1"), "span")
    blocks = lines.groupBy(*PAGE, "block_number").agg(_ordered("line_number", line).alias("line"), *bounds)
    size = []
    if images is not None:
        size = [F.col(c).cast("string").alias(f"_{c}") for c in ("width", "height", "ext")]
        blocks = blocks.unionByName(images.select(*PAGE, "block_number", "x0", "y0", "x1", "y1", "width", "height", "ext", F.lit(True).alias("image")), allowMissingColumns=True)
    kind = F.when(F.col("image"), "image").otherwise("text") if size else F.lit("text")
    block = F.struct(F.col("block_number").cast("string").alias("_index"), kind.alias("_type"), *size, *_box("x0", "y0", "x1", "y1"), "line")
    pages = page_info.join(blocks.groupBy(*PAGE).agg(_ordered("block_number", block).alias("block")), PAGE, "left")
    more = []
    if links is not None:
        found = _listed(links, "link", ["ord"], F.col("kind").cast("string").alias("_kind"), F.col("target_page").cast("string").alias("_target_page"), F.nullif("uri", F.lit("")).alias("_uri"))
        pages, more = pages.join(found, PAGE, "left"), [*more, "links"]
    if annotations is not None:
        found = _listed(annotations, "annotation", ["ord"], F.coalesce("type", F.lit("")).alias("_type"), F.coalesce("content", F.lit("")).alias("_content"))
        pages, more = pages.join(found, PAGE, "left"), [*more, "annotations"]
    return pages.select(F.col("doc_id").alias("_doc_id"), F.col("page_number").alias("_number"), X.number_text(F.col("width")).alias("_width"), X.number_text(F.col("height")).alias("_height"), F.col("rotation").alias("_rotation"), "block", *more)


def metadata_trees(metadata: DataFrame) -> DataFrame:
    """metadata (doc_id, key, value) to a row for each document: _doc_id and an element for each field that has a value; other keys are left out."""
    value = lambda k: F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value"))).alias(k)
    return metadata.groupBy("doc_id").agg(*map(value, METADATA)).withColumnRenamed("doc_id", "_doc_id")


def write_metadata(trees: DataFrame, path: str) -> None:
    trees.write.format("xml").option("rootTag", "documents").option("rowTag", "metadata").save(path)


def write_pages(trees: DataFrame, path: str) -> None:
    trees.write.format("xml").option("rootTag", "document").option("rowTag", "page").save(path)
