"""Revisions and lists of effective pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X


def chapter_revisions(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The highest leading revision number of each chapter (and of by, such as doc_id). entries: label, revision_value."""
    number = F.nullif(F.regexp_extract("revision_value", r"^(\d+)", 1), F.lit("")).try_cast("long")
    return entries.select(*by, X.chapter_of_label(F.col("label")).alias("chapter"), number.alias("n")).where("chapter is not null and n is not null").groupBy(*by, "chapter").agg(F.max("n").alias("revision"))


def natural_order(rows: DataFrame, label: str) -> DataFrame:
    """O3."""
    return rows.orderBy(X.natural_key(F.col(label)), label)


def fill_slots(slots: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Slots (by, slot) and labels (by, is_new, label, place) by place, new labels first; labels beyond the slots have none (overflow)."""
    a = slots.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("slot")))
    b = labels.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("is_new"), "place")))
    return b.join(a, [*by, "rn"], "left").withColumn("overflow", F.col("slot").isNull())


def pack_blank_pages(rows: DataFrame, label: str, rows_in_column: int, columns: int) -> DataFrame:
    """Overflow rows in natural order to blank page, column and row."""
    i = F.row_number().over(W.partitionBy("doc_id").orderBy(X.natural_key(F.col(label)), label)) - 1
    page = rows_in_column * columns
    return rows.withColumn("_i", i).withColumns({"blank_page": F.floor(F.col("_i") / page), "column": F.floor(F.col("_i") % page / rows_in_column), "row": F.col("_i") % rows_in_column}).drop("_i")


def overflow_risk(detected: Column, missing: Column) -> Column:
    """A13."""
    return F.when(~detected, "manual_review").when(missing > 12, "high").when(missing > 0, "medium").otherwise("low")


def one_change_a_page(changes: DataFrame) -> DataFrame:
    """W20."""
    from .contents import first_wins

    return first_wins(changes.withColumn("label", X.normalize_revision_label(F.col("page_label"))), ["doc_id", "page_index", "label"], ["change_type"])
