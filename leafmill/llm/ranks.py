"""Places in a total order, without a window over all rows or over a group that may hold most of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: What monotonically_increasing_id leaves for the rows of one partition.
ROW_BITS = 33


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df, stored, with `place` (long): the row's place from 0 on among the rows of its group (nulls are one), by the order given.

    Rows are dealt by ranges of group and order, so a group of any size lies in many tasks; what passes between ranges is one row for
    each range and group that has rows there. Rows that are equal in all the columns of the order take places of their own.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(ranges.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", ROW_BITS)
    counts = rows.groupBy(*group, part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("part").alias("_part"), (before - F.col("first")).alias("_shift"))
    same = reduce(lambda a, b: a & b, [part == F.col("_part"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]])
    out = rows.join(small(starts), same)
    return out.select(*df.columns, (F.col("at") + F.col("_shift")).alias("place"))
