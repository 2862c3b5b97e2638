"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A node is all fingerprints that begin with the same bits; its number is those bits. The join begins with the pair (root, root). A pair of
nodes is opened into the pairs of their descendants OPEN levels further; the bits in which two nodes' numbers differ are the errors so
far, and a pair beyond the budget, or one with a node that has no fingerprints, is pruned. While a node of a pair holds more than `cap`
fingerprints, pairs are opened as rows of numbers and counts, without the fingerprints: a node's partners are looked up among the nodes of
its level. Then each small node's fingerprints are gathered (`cap` at most), the pairs get those of their two nodes, and both are
descended together in Arrow batches, level by level to single fingerprints. Distinct fingerprints have at most 64 + 64 * 63 / 2
neighbours within two bits, so links stay in proportion; each batch emits a spanning forest of its links, which keeps all components.

At depth d a node has at most 1 + d + d (d - 1) / 2 partners, half of which are sent to it: at 10^7 fingerprints (d = 12) some 40 x 8 bytes
for each.

A text that is null or has no words has fingerprint zero and is linked like any other. Rows with the same doc_id share a
component; repeated rows get a row each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import LOWER, buffers, checkpointed, ship, stored, tidy, unpacked, whole
from .components import components

BUDGET, SEED = 2, 42
OPEN = 6
CAP = 4096
#: Fingerprints that are descended at once.
BATCH = 200_000


def fingerprint(words: list[bytes]) -> int:
    if not words:
        return 0
    if len(words) < 3:
        h = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        h = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    x = np.array(h, np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(x), 1 << 16):
        # little-endian bytes and bits: column i is bit i
        ones += np.unpackbits(x[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = buffers(batch.column(1))
        whole = data.tobytes()
        found = [fingerprint(whole[a:b].translate(LOWER).split()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# Traversal of small node pairs ----------------------------------------------


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def traverse(x: np.ndarray, pairs: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links within the node pairs: places in x of values that differ in 1 to budget bits.

    x: unsigned values, sorted within each node. pairs: rows of lo, hi, lo, hi, errors; a node is a range of x whose values
    share their first depth bits, and a pair may be a node with itself.
    """
    left, right = [], []
    for level in range(depth, 65):
        a0, a1, b0, b1, err = pairs.T
        self_pair = a0 == b0
        pairs = pairs[(a1 > a0) & (b1 > b0) & (err <= budget) & ~(self_pair & (a1 - a0 < 2))]
        a0, a1, b0, b1, err = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = _ones(x[i] ^ x[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            pairs = pairs[~single]
        if not len(pairs) or level == 64:
            break
        a0, a1, b0, b1, err = pairs.T
        zeros = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - level)) & np.uint64(1) == 0)])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = a0 == b0
        kids = [np.stack([a0, am, b0, bm, err], 1), np.stack([am, a1, bm, b1, err], 1), np.stack([a0, am, bm, b1, err + 1], 1), np.stack([am, a1, b0, bm, err + 1], 1)[~own]]
        pairs = np.concatenate(kids)
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(left), join(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows depth, errors, x, y (sorted fingerprints of two nodes; y null for a node with itself) to spanning edges of their links."""
    for batch in batches:
        depths, errors = (batch.column(c).to_numpy() for c in ("depth", "errors"))
        x, y = batch.column("x"), batch.column("y")
        nx, ny = (np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for c in (x, y))
        upto = np.cumsum(nx + ny)
        for d in np.unique(depths):
            own = np.flatnonzero(depths == d)
            for part in np.split(own, np.flatnonzero(np.diff(upto[own] // BATCH)) + 1):
                sides = [x.take(pa.array(part)).flatten().to_numpy().view(np.uint64), y.take(pa.array(part)).flatten().to_numpy().view(np.uint64)]
                if d == 0:  # they come in order of signed numbers
                    sides[0] = np.sort(sides[0])
                values = np.concatenate(sides)
                a1 = np.cumsum(nx[part])
                b1 = len(sides[0]) + np.cumsum(ny[part])
                alone = ny[part] == 0
                a0, b0 = a1 - nx[part], b1 - ny[part]
                i, j = traverse(values, np.stack([a0, a1, np.where(alone, a0, b0), np.where(alone, a1, b1), errors[part]], 1), int(d))
                # places to values: a value may stand in several pairs
                distinct, place = np.unique(values, return_inverse=True)
                root = forest(len(distinct), place[i], place[j])
                linked = np.flatnonzero(root != np.arange(len(distinct)))
                yield pa.record_batch([pa.array(distinct[linked].view(np.int64)), pa.array(distinct[root[linked]].view(np.int64))], ["a", "b"])


# Node pairs as DataFrames ---------------------------------------------------


def _node(depth: int) -> Column:
    """The number of a fingerprint's node: its first bits."""
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _opened(pairs: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) to those of their descendants, bits levels further, that are in nodes (node, n) and within the budget: a, b, na, nb."""
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= BUDGET]
    left = nodes.select(F.shiftright("node", bits).alias("a"), F.col("node").alias("x"), F.col("n").alias("na"))
    met = pairs.select("a", "b").join(left, "a").withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    met = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count("mask") <= BUDGET)
    low = F.col("x").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    met = met.select("a", "b", "x", "na", F.shiftleft("b", bits).bitwiseOR(low.bitwiseXOR(F.col("mask"))).alias("y"))
    met = met.where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
    return met.join(nodes.select(F.col("node").alias("y"), F.col("n").alias("nb")), "y").select(F.col("x").alias("a"), F.col("y").alias("b"), "na", "nb")


def node_pairs(fps: DataFrame, cap: int) -> list[tuple[int, DataFrame]]:
    """Depths, and at each the pairs (a, b) whose nodes both hold at most cap fingerprints, from which all links can be reached."""
    depth, found = 0, []
    pairs = fps.agg(F.count("*").alias("na")).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "na", F.col("na").alias("nb"))
    while True:
        pairs = checkpointed(pairs)
        little = (F.col("na") <= cap) & (F.col("nb") <= cap) if depth < 64 else F.lit(True)
        found.append((depth, pairs.where(little & ((F.col("a") != F.col("b")) | (F.col("na") > 1))).select("a", "b")))
        large = pairs.where(~little)
        if large.isEmpty():
            return found
        bits = min(OPEN, 64 - depth)
        depth += bits
        nodes = checkpointed(fps.groupBy(_node(depth).alias("node")).agg(F.count("*").alias("n")))
        pairs = _opened(large, nodes, bits)


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect what is within BUDGET bits, by the trie self-join."""
    ship(fps.sparkSession)
    every, values = None, None
    for depth, pairs in node_pairs(fps, cap):
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # at most cap fingerprints to a node
        own = fps.select(_node(depth).alias("node"), "fp").join(needed, "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("fp")).alias("x"))
        own, pairs = own.withColumn("depth", F.lit(depth)), pairs.withColumn("depth", F.lit(depth))
        every, values = (pairs, own) if every is None else (every.unionByName(pairs), values.unionByName(own))
    values = stored(values, "nodes")
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() >> 14)
    left = every.join(values.withColumnRenamed("node", "a"), ["depth", "a"]).select("depth", "a", "b", "x")
    left = left.repartition(tasks, "depth", "b")
    alone = left.where("a = b").withColumn("y", F.lit(None).cast("array<long>"))
    two = left.where("a != b").join(values.select("depth", F.col("node").alias("b"), F.col("x").alias("y")), ["depth", "b"])
    both = alone.unionByName(two).select("depth", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("long").alias("errors"), "x", "y")
    return both.mapInArrow(_descended, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Per document row: doc_id, fp (long), component_id (the smallest doc_id reachable; null if all of them are null)."""
    rows = stored(fingerprints(docs), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    fps = stored(fps, "distinct")
    roots = components(links(fps.select("fp"), cap))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = next(_fingerprints(iter([batch])))
        yield pa.record_batch([*prints.columns, *near_copies.sketch(batch.column(1))], ["doc_id", "fp", "s", "keys"])
    tidy()


def copies(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """As near_duplicates, with near copies by five-word shingles (near_copies) linked as well."""
    ship(docs.sparkSession)
    rows = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketched, "doc_id long, fp long, s long, keys array<long>"), "sketches")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # a set stands for one of its fingerprints, and its others are linked to that
    of_set = stored(rows.where("s is not null").groupBy("s").agg(F.min("fp").alias("own")), "sets")
    same = rows.join(of_set, "s").where("fp != own").select(F.col("own").alias("a"), F.col("fp").alias("b")).distinct()
    near = near_copies.links(rows.select("s", "keys"), docs)
    near = near.join(of_set.toDF("a", "fa"), "a").join(of_set.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    roots = components(links(fps.select("fp"), cap).unionByName(same).unionByName(near))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp").join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their group of copies: the smallest doc_id, and of repeated rows one.

    Rows without doc_id stay, as nothing names them. Of different texts with the same doc_id, any one stays.
    """
    found = stored(copies(docs, cap), "copies")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    rows = docs.select(whole(docs).alias("d"), F.col("doc_id").cast("long").alias("own"))
    rest = rows.join(gone, F.col("own") == F.col("_gone"), "left_anti")
    once = rest.join(again, F.col("own") == F.col("_again"), "left_anti")
    # only repeated rows meet by doc_id
    first = rest.join(again, F.col("own") == F.col("_again"), "left_semi").dropDuplicates(["own"])
    return unpacked(once.unionByName(first), docs.columns)
