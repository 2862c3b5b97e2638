"""Connected components by alternating large-star and small-star steps, as joins and aggregates over edges.

A step is an aggregated minimum and an equi-join on the same node, over edges that are dealt by node once, into as many tasks as there are
edges for (TASK_EDGES to a task). A node's edges are streamed, not gathered. Each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

TASK_EDGES = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _dealt(edges: DataFrame, tasks: int) -> DataFrame:
    """Distinct edges u -> v other than loops, dealt by u."""
    return edges.where("u != v").repartition(tasks, "u").dropDuplicates(["u", "v"])


def _minimum(edges: DataFrame) -> DataFrame:
    """For directed edges u -> v, dealt by u: those with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (node, root: long): root is the least node reachable; every node of an edge has a row. Loops have none."""
    state = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = 1 + state.count() // TASK_EDGES
    before = None
    for _ in range(max_rounds):
        large = _minimum(_dealt(_both(state), tasks)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: edges already point from the larger to the smaller node
        small = _minimum(_dealt(large, tasks)).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        state = checkpointed(_dealt(small, tasks))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge leads to its root
    return _both(state).groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root"))


def near_roots(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): the least node within two edges. Nodes of one star have the same; nodes of other components never have."""
    both = _both(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    first = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.join(first, "v").groupBy(F.col("u").alias("node")).agg(F.min("m").alias("root"))
