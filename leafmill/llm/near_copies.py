"""Links between near copies: word shingles of SHINGLE words whose sets have a Jaccard similarity of 0.8 or more.

Words are lower-cased and blank-separated, a text of fewer words is one shingle, and one without words has none. Texts with the same set are
one. Sets that agree in all min-hashes of a band are in one bucket; what a bucket proposes is held against each other shingle by shingle.

First BANDS bands: at a similarity of 0.8 all but (1 - 0.8^4)^20 = 0.00003 of the pairs share a bucket. Only the leader of a bucket meets
its others: the set whose buckets are the largest, so of copies that were made from one text that text. So pairs grow with the sets, not
with the square of a bucket's, and large groups are connected.

Then the rest, exactly: all sets of buckets that aren't connected by then are joined by their prefixes. In any common order of shingles two
sets of a similarity of 0.8 or more have one of their first fifths' shingles in common; frequent shingles come last, so few others have.
Of such pairs those go that are connected, or whose sizes, places in the order or counts of shingles by bins rule the similarity out (each bound
holds for certain), and the others are held against each other. No bucket is capped: one of many sets is met in blocks, in as many tasks as
it has pairs of blocks. Which shingles are frequent is learned from SAMPLE sets; that decides on the work alone, not on what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, GRAM, gram_hashes, hashed_steps, mix, ship, small, stored, tidy
from .components import near_roots

SHINGLE = 5
#: Bands, and min-hashes of a band.
BANDS, OF_BAND = 20, 4
#: Sets that the order of shingles is learned from, shingles that it tells apart from rare ones, sets of a block, and bins of shingles.
SAMPLE, ORDERED, BLOCK, BINS = 10_000, 1 << 17, 1000, 64
#: Others that a leader meets in one task, and names of sets that are broadcast at most.
PART, NAMES = 1000, 1_000_000
_random = np.random.Generator(np.random.PCG64(5))
_FACTORS = _random.integers(1, 2**63, BANDS * OF_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _random.integers(0, 2**64, BANDS * OF_BAND, dtype=np.uint64)


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first, last + 1, and each row's distinct shingles in order, as rows from 0 and hashes."""
    for lo, hi, h, before in hashed_steps(column, BLANK):
        count = np.diff(before)
        place = np.arange(len(h)) - np.repeat(before[:-1], count)
        at = np.flatnonzero(place + SHINGLE <= np.repeat(count, count))
        row, g = [np.repeat(np.arange(hi - lo), count)[at]], [gram_hashes(h, SHINGLE)[at]]
        for n in range(1, SHINGLE):
            short = np.flatnonzero(count == n)
            row.append(short)
            g.append(gram_hashes(h, n)[before[:-1][short]])
        row, g = np.concatenate(row), np.concatenate(g)
        order = np.lexsort((g, row))
        row, g = row[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
        yield lo, hi, row[new], g[new]


def named(n: int, row: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles and the names of their sets."""
    some = np.flatnonzero(np.bincount(row, minlength=n))
    first = np.searchsorted(row, some)
    return some, mix(np.add.reduceat(mix(g), first) + np.bincount(row, minlength=n)[some].astype(np.uint64) * GRAM[9]) if len(some) else np.zeros(0, np.uint64)


def _full(n: int, some: np.ndarray, x: np.ndarray) -> pa.Array:
    values, there = np.zeros(n, np.int64), np.zeros(n, bool)
    values[some], there[some] = x.view(np.int64), True
    return pa.array(values, mask=~there)


def sketch(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Names of the rows' sets (null without words) and their bands' keys."""
    names, keys = [], []
    for lo, hi, row, g in shingles(column):
        some, name = named(hi - lo, row, g)
        names.append(_full(hi - lo, some, name))
        found = np.zeros((hi - lo, BANDS), np.uint64)
        first = np.searchsorted(row, some)
        for i in range(BANDS * OF_BAND if len(some) else 0):
            least = np.minimum.reduceat((g ^ _TURNS[i]) * _FACTORS[i], first)
            band = i // OF_BAND
            found[some, band] = mix(found[some, band] * GRAM[10] + least + np.uint64(band))
        keys += list(found.view(np.int64))
    return pa.chunked_array(names or [pa.array([], pa.int64())]).combine_chunks(), pa.array(keys, pa.list_(pa.int64()))


def _with_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, row, g in shingles(batch.column(0)):
            yield pa.record_batch([_full(hi - lo, *named(hi - lo, row, g)), batch.column(0).slice(lo, hi - lo)], ["s", "text"])
    tidy()


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, row, g in shingles(column):
        yield from np.split(g, np.searchsorted(row, np.arange(1, hi - lo)))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, s, text, in which a leader a comes before its others, to those others (a, b) that are near copies of it."""
    now, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        leads, others = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = []
        for i, x in enumerate(_sets(batch.column(2))):
            if leads[i] == others[i]:
                now, own = leads[i], x
                continue
            if now != leads[i]:
                raise ValueError("a leader is missing")
            both = len(np.intersect1d(own, x, assume_unique=True)) if 5 * min(len(x), len(own)) >= 4 * max(len(x), len(own)) else 0
            if 5 * both >= 4 * (len(x) + len(own) - both):
                found.append(i)
        yield pa.record_batch([pa.array(leads[found]), pa.array(others[found])], ["a", "b"])
    tidy()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets, a the leader, whose similarity is 0.8 or more. A leader of many meets them in several tasks."""
    pairs = stored(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("n"))
    dealt = pairs.join(parts, "a").select("a", F.col("b").alias("s"), F.pmod(F.xxhash64("b"), "n").alias("part"))
    leads = parts.select("a", F.col("a").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"))
    rows = dealt.unionByName(leads).join(texts, "s")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("s") != F.col("a"))
    return stored(rows.select("a", "s", "text").mapInArrow(_similar, "a long, b long"), "near")


def _buckets(sets: DataFrame, name: str) -> DataFrame:
    """sets (s, keys) to key, s, w: buckets with more than one set, and how many places their sets have in buckets."""
    entries = sets.select("s", F.explode("keys").alias("key"))
    entries = stored(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), name)
    return entries.select("key", "s").join(entries.groupBy("s").agg(F.sum("n").alias("w")), "s")


def _open(buckets: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Entries of buckets whose sets aren't known to be connected: key, s, root, and the bucket's leader."""
    placed = buckets.withColumn("root", F.col("s"))
    if edges is not None:
        placed = buckets.join(near_roots(edges).withColumnRenamed("node", "s"), "s", "left").select("key", "s", "w", F.coalesce("root", "s").alias("root"))
    leads = placed.groupBy("key").agg(F.max(F.struct("w", "s", "root")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "lead")
    return stored(placed.join(leads, "key"), "open")


def _led(entries: DataFrame) -> DataFrame:
    return entries.where("root != lead.root").select(F.col("lead.s").alias("a"), F.col("s").alias("b")).distinct()


# What leaders leave ---------------------------------------------------------


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, g in shingles(batch.column(0)):
            yield pa.record_batch([pa.array(g.view(np.int64))], ["g"])
    tidy()


def _order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur again in SAMPLE or so of the sets, the most frequent ORDERED of them by value, and how often they occur."""
    step = 1 + sets.count() // SAMPLE
    counts = sets.where(F.pmod("s", F.lit(step)) == 0).select("text").mapInArrow(_every, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "g").limit(ORDERED).toArrow()
    g, n = found.column("g").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(g)
    return g[order], n[order]


def prefix(x: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first fifth of a set x, and one shingle: all but as many as it must share with any set of a similarity of 0.8; rare ones first."""
    often = np.zeros(len(x), np.int64)
    if len(g):
        at = np.minimum(np.searchsorted(g, x), len(g) - 1)
        often = np.where(g[at] == x, n[at], 0)
    return x[np.lexsort((x, often))[: len(x) - (4 * len(x) + 4) // 5 + 1]]


def _prefixes(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows s, root, text to s, root, size, the set's counts by bins (16 bits, held at their most), and its prefix in order."""
        g, n = order.value
        for batch in batches:
            found = list(_sets(batch.column(2)))
            bins = [np.minimum(np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=BINS), 65_535).astype("<u2").tobytes() for x in found]
            firsts = [prefix(x, g, n).view(np.int64) for x in found]
            sizes = pa.array([len(x) for x in found], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), sizes, pa.array(bins, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["s", "root", "size", "bins", "prefix"])
        tidy()

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, both sizes and both bins to those (a, b) whose bins differ by a ninth of both sizes at most, as they do at 0.8."""
    for batch in batches:
        size, x, y = batch.column(2).to_numpy(), *(np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BINS).astype(np.int64) for c in batch.columns[3:])
        near = pa.array(9 * np.abs(x - y).sum(1) <= size)
        yield pa.record_batch([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])


def _candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (s, root, text) of unlike roots, among them all that have a similarity of 0.8 or more."""
    order = sets.sparkSession.sparkContext.broadcast(_order(sets))
    own = stored(sets.select("s", "root", "text").mapInArrow(_prefixes(order), "s long, root long, size long, bins binary, prefix array<long>"), "prefixes")
    entries = own.select("s", "root", "size", F.posexplode("prefix").alias("place", "token"))
    shared = entries.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token", "k")
    blocks = stored(entries.join(shared, "token").withColumn("block", F.pmod(F.xxhash64("s"), "k")), "blocks")
    # each pair of blocks of a token is a group of its own
    left = blocks.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("k") - 1)).alias("j"), *[F.col(c).alias(f"a_{c}") for c in ("s", "root", "size", "place")])
    right = blocks.select("token", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("s", "root", "size", "place")])
    once = (F.col("i") < F.col("j")) | (F.col("a_s") < F.col("b_s"))
    sizes = 5 * F.least("a_size", "b_size") >= 4 * F.greatest("a_size", "b_size")
    # of the first shingle that both have: what they can share from there on
    rest = 9 * F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) >= 4 * (F.col("a_size") + F.col("b_size"))
    met = left.join(right, ["token", "i", "j"]).where(once & (F.col("a_root") != F.col("b_root")) & sizes & rest)
    pairs = met.select(F.least("a_s", "b_s").alias("a"), F.greatest("a_s", "b_s").alias("b")).distinct()
    side = lambda c: own.select(F.col("s").alias(c), F.col("size").alias(f"{c}_size"), F.col("bins").alias(f"{c}_bins"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return pairs.select("a", "b", F.col("a_size") + F.col("b_size"), "a_bins", "b_bins").mapInArrow(_possible, "a long, b long")


def links(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the sets (s, keys) of near copies."""
    ship(docs.sparkSession)
    buckets = _buckets(sketches.where("s is not null").dropDuplicates(["s"]), "buckets")
    # texts are fetched once, those of sets that share a bucket; names are few bytes and broadcast up to a million
    met = stored(buckets.select("s").distinct(), "met")
    texts = docs.select("text").mapInArrow(_with_names, "s long, text string").join(small(met, NAMES), "s", "left_semi").dropDuplicates(["s"])
    texts = stored(texts, "texts")
    edges = _verified(_led(_open(buckets, None)), texts)
    left = stored(_open(buckets, edges).select("s", "root").distinct(), "left")
    return edges.unionByName(_verified(_candidates(texts.join(small(left, NAMES), "s")), texts))
