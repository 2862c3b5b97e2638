"""Benchmark decontamination by winnowing.

Items and documents are cut into k-grams of words; of each window of w k-grams the rightmost one with the smallest hash
is a fingerprint. Two texts that share w + k - 1 = 10 words or more have a fingerprint in common at the same place of the
shared span. Documents' fingerprints are joined to those of the items, hits are extended word by word on both sides, and
spans of 10 words or more count. An item of fewer words counts as one window, found by its n-gram of all its words.

The items' words are broadcast while there are at most `max_index_words` of them; beyond that the items are dealt into
blocks of that size, each block is held against all documents, and the hits are merged.

Words are compared by 64-bit hashes. Null and empty texts have no words: no hits, not contaminated. An item without words has no
windows, and an empty benchmark hits nothing. Words of an item with a null item_id are hit as any other's, but it has no name to be listed or
counted by. Repeated rows get a row each. Only doc_id and text (item_id and text) are read; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, gram_hashes, hashed_steps, ship, stored, tidy

WINDOW, K = 10, 5
MAX_INDEX_WORDS = 4_000_000
_FOUND = pa.list_(pa.int64())


def winnow(h: np.ndarray, bounds: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints among the words h; bounds has the first word of each text and the end."""
    grams = gram_hashes(h, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, w):
        other = grams[j : n + j]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = j
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:n] == text[w + k - 2 : n + w + k - 2]
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + at)[inside]] = True
    return np.flatnonzero(chosen)


class Index:
    """Fingerprints and words of items, for one broadcast."""

    def __init__(self, item_ids: list[int | None], lengths: np.ndarray, h: np.ndarray, window: int = WINDOW, k: int = K):
        self.window, self.k, self.w = window, k, window - k + 1
        self.ids, self.h = item_ids, h
        self.bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(item_ids)), lengths)
        at = winnow(h, self.bounds, k, self.w)
        self.at, self.keys = self._sorted(at, gram_hashes(h, k)[at])
        self.short = {}
        for n in range(1, window):
            at = self.bounds[:-1][lengths == n]
            if len(at):
                self.short[n] = self._sorted(at, gram_hashes(h, n)[at])

    @staticmethod
    def _sorted(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    @staticmethod
    def _pairs(where: np.ndarray, h: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the documents and in the items with the same hash."""
        lo = np.searchsorted(keys, h, "left")
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h) if len(keys) else np.zeros(0, np.int64)
        n = np.searchsorted(keys, h[hit], "right") - lo[hit]
        q = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else np.zeros(0, np.int64)
        return np.repeat(where[hit], n), at[q]

    def _extend(self, d: np.ndarray, p: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest span of equal words about p in the documents' words d, and q in the items'. first, last: bounds of p's text."""
        a, b = p.copy(), p.copy()
        low, high = np.maximum(first, p - (q - self.bounds[self.owner[q]])), np.minimum(last, p + (self.bounds[self.owner[q] + 1] - q))
        live = np.arange(len(p))
        while len(live := live[a[live] > low[live]]):
            live = live[d[a[live] - 1] == self.h[q[live] - (p[live] - a[live]) - 1]]
            a[live] -= 1
        live = np.arange(len(p))
        while len(live := live[b[live] < high[live]]):
            live = live[d[b[live]] == self.h[q[live] + (b[live] - p[live])]]
            b[live] += 1
        return a, b

    def spans(self, d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and items of all shared spans in the words d of some documents."""
        starts, ends, items = [], [], []
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = winnow(d, bounds, self.k, self.w)
        if len(at) and len(self.keys):
            p, q = self._pairs(at, gram_hashes(d, self.k)[at], self.at, self.keys)
            while len(p):  # one extension for each diagonal, then those that it doesn't cover
                order = np.lexsort((p, q - p))
                p, q = p[order], q[order]
                group = np.flatnonzero(np.concatenate([[True], np.diff(q - p) != 0]))
                size = np.diff(np.concatenate([group, [len(p)]]))
                a, b = self._extend(d, p[group], q[group], bounds[text[p[group]]], bounds[text[p[group]] + 1])
                long = b - a >= self.window
                starts.append(a[long])
                ends.append(b[long])
                items.append(self.owner[q[group][long]])
                # past the span and past the item that it lies in
                left = p >= np.repeat(np.maximum(b, p[group] + 1), size)
                p, q = p[left], q[left]
        for n, (where, keys) in self.short.items():
            g = gram_hashes(d, n)
            inside = np.flatnonzero(text[: len(g)] == text[n - 1 : len(g) + n - 1]) if len(g) else np.zeros(0, np.int64)
            p, q = self._pairs(inside, g[inside], where, keys)
            same = np.ones(len(p), bool)
            for j in range(n):
                same &= d[p + j] == self.h[q + j]
            starts.append(p[same])
            ends.append(p[same] + n)
            items.append(self.owner[q[same]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(starts), join(ends), join(items)

    def report(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Per row: number of words, merged spans as start, end, start, end, ..., and item_ids but for null."""
        counts, spans, found = [], [[] for _ in range(len(column))], [[] for _ in range(len(column))]
        for lo, hi, d, before in hashed_steps(column, ALNUM):
            counts.append(np.diff(before))
            a, b, item = self.spans(d, before)
            if not len(a):
                continue
            text = np.searchsorted(before, a, "right") - 1
            pair = np.unique(np.stack([text, item], 1), axis=0)
            for t, i in pair.tolist():
                if self.ids[i] is not None:
                    found[lo + t].append(self.ids[i])
            delta = np.zeros(len(d) + 1, np.int64)
            np.add.at(delta, a, 1)
            np.add.at(delta, b, -1)
            hit = np.cumsum(delta[:-1]) > 0
            first = np.zeros(len(d) + 1, bool)
            first[before] = True
            edge = np.zeros(len(d), bool)
            edge[1:] = hit[:-1] & ~first[1:-1]
            begin = np.flatnonzero(hit & ~edge)
            edge = np.zeros(len(d), bool)
            edge[:-1] = hit[1:] & ~first[1:-1]
            end = np.flatnonzero(hit & ~edge) + 1
            for t, x, y in zip((np.searchsorted(before, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
                spans[lo + t] += [x - int(before[t]), y - int(before[t])]
        return np.concatenate(counts) if counts else np.zeros(0, np.int64), spans, found


def _hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, h, before in hashed_steps(batch.column(1), ALNUM):
            bounds = before.tolist()
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["item_id", "h"])


def indexes(benchmark: DataFrame, max_words: int = MAX_INDEX_WORDS) -> Iterator[Index]:
    """The items with words, in indexes of at most max_words words (an item with more is an index of its own)."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(_hash_items, "item_id long, h binary").where(F.length("h") > 0)
    ids, h, size = [], [], 0
    for row in items.toLocalIterator():
        if size and size + len(row.h) // 8 > max_words:
            yield _index(ids, h)
            ids, h, size = [], [], 0
        ids.append(row.item_id)
        h.append(np.frombuffer(row.h, np.uint64))
        size += len(h[-1])
    if ids:
        yield _index(ids, h)


def _index(ids: list[int | None], h: list[np.ndarray]) -> Index:
    return Index(ids, np.array([len(x) for x in h]), np.concatenate(h))


def _hits(docs: DataFrame, index: Index) -> DataFrame:
    """docs' columns key and text become key, n_words, spans, items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = shared.value.report(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, _FOUND), pa.array(items, _FOUND)], ["key", "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.select("key").schema.simpleString()[7:-1].replace("key:", "key ") + ", n_words long, spans array<long>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, spans (array of struct start, end: merged word ranges, end exclusive), n_hit, items (sorted array of item_id).

    No rows where docs has none; without benchmark items no document has hits.
    """
    spark = docs.sparkSession
    ship(spark)
    every = indexes(benchmark, max_index_words)
    # the driver holds two blocks at most
    first = next(every, Index([], np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    second = next(every, None)
    if second is None:
        hits = _hits(docs.select(F.col("doc_id").alias("key"), "text"), first).withColumnRenamed("key", "doc_id")
        pairs = F.expr("transform(sequence(0, cast(size(spans) as int) div 2 - 1), i -> struct(spans[2 * i] as start, spans[2 * i + 1] as end))")
        spans = F.when(F.size("spans") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    else:
        # the key of a row is its whole content: repeated rows have the same hits
        keyed = docs.select("doc_id", "text", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("key"))
        hits = None
        for index in chain((first, second), every):
            # done before the next block is read
            own = stored(_hits(keyed.select("key", "text"), index), "hits")
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("items")).alias("items"), F.collect_set("spans").alias("spans"))
        rows = docs.select("doc_id", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("key"))
        hits = rows.alias("r").join(hits.alias("h"), F.expr("r.key <=> h.key")).select("r.doc_id", "h.n_words", "h.items", "h.spans")
        spans = F.expr(
            """aggregate(
                 array_sort(flatten(transform(spans, s -> transform(filter(sequence(0, greatest(size(s) - 2, 0), 2), i -> i < size(s)), i -> struct(s[i] as start, s[i + 1] as end))))),
                 cast(array() as array<struct<start: bigint, end: bigint>>),
                 (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
                   concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, x.end) as end))),
                   concat(acc, array(x))))"""
        )
    return hits.select("doc_id", "n_words", spans.alias("spans"), F.sort_array(F.array_distinct("items")).alias("items")).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that share no window with any item."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index("text")
    # plain names, as columns may have dots
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for n, index in enumerate(indexes(benchmark)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, _ = shared.value.report(batch.column(at))
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))
            tidy()

        # a further block is read when this one is done
        kept = (stored(kept, "kept") if n else kept).mapInArrow(run, kept.schema)
    return kept.toDF(*docs.columns)


def digest(report: DataFrame) -> DataFrame:
    """The columns of the query: items as a hash of their sorted, joined names."""
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
