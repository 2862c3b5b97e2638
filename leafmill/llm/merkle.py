"""A Merkle tree over a dataset: leaves for rows, a subtree for each group, a root above the subroots, and a proof for each row.

Each level is one window: nodes are partitioned by group and parent's place, and the ordered list over the full frame is both the
parent's preimage and the siblings of each node in it. One node of each run stands for the parent on the next level. A window's frame
has FANOUT rows at most, whatever the group's size. Proofs are put together from the root downwards, so what the rows of a run share
is joined to them once for the run.

Nulls count as `-` in a leaf; a null group is a group, the first one. Rows ascend by doc_id, nulls first; rows with one doc_id by their
leaves; equal rows stand side by side and have equal proofs. Empty texts are `0:`. A table without rows gives none. Other columns are
left out of leaves, whatever their names. Texts are hashed where they are read; only digests are dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import COLUMNS, small, stored
from .ranks import numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """A row's leaf; of another text if one is given."""
    return digest(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS])


def lower_cased(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_third(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 0


def parents(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Nodes (group, place, node) with parent (its place), run (the digests under it, in order) and above (its digest)."""
    run = Window.partitionBy(*group, "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = nodes.withColumn("parent", F.floor(F.col("place") / FANOUT).cast("long")).withColumn("run", F.collect_list("node").over(run))
    return out.withColumn("above", digest(F.array_join("run", "")))


def step() -> Column:
    """What stands before and after a node in its run."""
    at = (F.col("place") % FANOUT).cast("int")
    return F.struct(
        F.array_join(F.slice("run", F.lit(1), at), "").alias("before"),
        F.array_join(F.slice("run", at + 2, F.lit(FANOUT)), "").alias("after"),
    )


def tree(nodes: DataFrame, group: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The root of each group (group, node), and for each first node (group, place) its path: before and after it on each level, upwards.

    nodes: group, place (from 0 on in each group), node. The node of a group of one is its root and has no row among the paths.
    """
    # a group goes on while it has more than one node; its size follows from its own number of rows
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    level, levels, roots = beside(nodes, small(sizes), group).select(*group, "place", "node", "n"), [], None
    while most > 1:
        ended = level.where("n = 1").select(*group, "node")
        roots = ended if roots is None else roots.unionByName(ended)
        runs = stored(parents(level.where("n > 1"), group), f"{name}-level")
        levels.append(runs)
        level = runs.where(F.col("place") % FANOUT == 0).select(*group, F.col("parent").alias("place"), F.col("above").alias("node"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        most = -(-most // FANOUT)
    ended = level.select(*group, "node")
    roots = ended if roots is None else roots.unionByName(ended)

    paths = level.select(*group, "place", F.array().cast(_PATH).alias("path"))
    for i in reversed(range(len(levels))):
        # those of groups that ended on this level begin with no path
        tops = levels[i].where(F.col("n") <= FANOUT).select(*group, "place", F.array(step()).cast(_PATH).alias("path"))
        if i + 1 < len(levels):
            joined = beside(levels[i].where(F.col("n") > FANOUT), paths.withColumnRenamed("place", "parent"), [*group, "parent"])
            tops = tops.unionByName(joined.select(*group, "place", F.concat(F.array(step()), F.col("path")).alias("path")))
        paths = tops if i == 0 else stored(tops, f"{name}-paths")
    return roots, paths


def beside(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b's other columns on the keys; nulls are equal."""
    renamed = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return a.join(renamed, on, how).drop(*[f"_{c}" for c in keys])


def manifest(docs: DataFrame, group: str = "lang", tampered: Callable[[Column], Column] = every_third, change: Callable[[Column], Column] = lower_cased) -> DataFrame:
    """For each row its doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, as the root is recomputed from its leaf and path.

    Rows that `tampered` picks by doc_id are recomputed from the leaf of a text that `change` has changed.
    """
    docs = docs.select(*COLUMNS)
    leaves = docs.select(
        "doc_id", F.col(group).alias("grp"), leaf().alias("leaf"), F.when(tampered(F.col("doc_id")), leaf(change(F.col("text")))).alias("shown"))
    rows = numbered(leaves, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "merkle-leaves")
    subroots, paths = tree(rows.select("grp", "place", F.col("leaf").alias("node")), ["grp"], "merkle")
    tops = numbered(subroots.withColumn("all", F.lit(0)), ["all"], [F.col("grp").asc_nulls_first()], "merkle-subroots")
    roots, above = tree(tops.select("all", "place", "node"), ["all"], "merkle-top")
    ends = tops.join(above.withColumnRenamed("path", "above"), ["all", "place"], "left").join(F.broadcast(roots.withColumnRenamed("node", "root")), "all")
    ends = ends.select("grp", F.col("node").alias("subroot"), "root", "above")

    none = F.array().cast(_PATH)
    out = beside(beside(rows, paths, ["grp", "place"], "left"), small(ends), ["grp"]).withColumn("path", F.concat(F.coalesce("path", none), F.coalesce("above", none)))
    proof = digest(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""))
    folded = F.aggregate("path", F.coalesce("shown", "leaf"), lambda node, x: digest(x["before"], node, x["after"]))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
