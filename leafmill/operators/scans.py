"""Running values over groups of any size: a group is cut into ranges, each range is a window of its own, and what came before it is carried in.

A range is told by a column that doesn't fall within a group's order, such as the page by fifties. What is carried is one row for each range
and group, computed from partial aggregates; so the largest task has one range's rows, or one group's ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Pages to a range.
PAGES = 64


def page_range(page: str, pages: int = PAGES) -> Column:
    return F.floor(F.col(page) / pages).cast("long")


def running(rows: DataFrame, by: list[str], order: list, cut: Column, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running values, from each group's first row to the row itself: name to (sum, min, max or last, column).

    last is the last value that isn't null, of columns that are not arrays or maps. Rows with equal places in the order may come in any turn, as in
    a window. A null place in a range is a range of its own, the first one. sum of no values is 0 where a window's would be null.
    """
    by_range = [*by, "_range"]
    rows = rows.withColumns({"_range": cut, **{f"_{n}": c for n, (_, c) in values.items()}})
    place = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    whole, upto, before, merged = {}, {}, {}, {}
    within = W.partitionBy(*by_range).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*by).orderBy(F.col("_range").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        own, carried, c = F.col(f"_{name}"), F.col(f"_{name}_before"), f"_{name}"
        if kind == "last":
            whole[name] = F.max_by(c, F.when(own.isNotNull(), place))
            upto[name] = F.last(c, ignorenulls=True).over(within)
            before[name] = F.last(c, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(F.col(name), carried)
        else:
            f = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            whole[name], upto[name], before[name] = f(c), f(c).over(within), f(c).over(earlier)
            both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[kind]
            merged[name] = both(F.col(name), carried)
    totals = rows.groupBy(*by_range).agg(*[c.alias(f"_{n}") for n, c in whole.items()])
    carried = totals.select(*by_range, *[c.alias(f"_{n}_before") for n, c in before.items()])
    carried = carried.select(*[F.col(c).alias(f"{c}_of") for c in by_range], *[f"_{n}_before" for n in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by_range])
    met = rows.withColumns(upto).join(carried, same).withColumns(merged)
    return met.drop("_range", *[f"{c}_of" for c in by_range], *[x for n in values for x in (f"_{n}", f"_{n}_before")])
