"""A quality score learnt from preference pairs (Bradley-Terry).

Of two labelled documents, one good and one bad, the good one is preferred; the probability of that is the logistic function of the
difference of their scores, and a score is linear in the text's features. Weights minimise logistic loss on feature
differences plus an L2 term, by Newton steps. The raw score's cut is its quantile at the share of bad documents, both over all labelled
training rows; scores are mapped to 0..1 by a logistic curve that is 0.7 at the cut.

Features come from the whole text: shares of its bytes by character, of words by form, repetition of words and lines, and lengths.
doc_id, lang, source and labels are no features. Fitting uses at most MAX_LABELLED labelled training rows of each class, those
with the smallest hashes of doc_id, and MAX_PAIRS pairs; the cut comes from all of them, and all rows are scored.

Null and empty texts have features of their own (all zero) and a score. Without labels of both classes all scores are 0.5.
A document with several labels counts with each. Repeated rows get a row each, with equal scores. An empty table gives no rows. Columns beside
doc_id and text (of labels: doc_id and the class) play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, CASED, buffers, remainder, ship, steps, stored, word_hashes, words

MAX_LABELLED, MAX_PAIRS = 8_000, 100_000
CUT, L2 = 0.7, 1e-3
N_FEATURES = 3 + 32 + 7


def _byte_kinds() -> np.ndarray:
    """0 lower case and bytes beyond ASCII, 1 upper case, 2 digits, 3 blanks, 4 other controls, then each ASCII mark."""
    kind = np.full(256, 4, np.uint8)
    kind[97:123] = kind[128:] = 0
    kind[65:91], kind[48:58] = 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    for i, c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
        kind[c] = 5 + i
    return kind


_KINDS = _byte_kinds()
_N_KINDS = 5 + 32


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """For ranges of rows: first, last + 1, a matrix."""
    data, offs = buffers(column)
    for lo, hi in steps(offs):
        part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        n = hi - lo
        row = np.repeat(np.arange(n), np.diff(own))
        size = np.maximum(np.diff(own), 1)
        by_kind = np.bincount(row * _N_KINDS + _KINDS[part], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
        starts, ends, before = words(part, own, CASED)
        count = np.diff(before)
        some = np.maximum(count, 1)
        h = word_hashes(part, starts, ends, BLANK)
        text = np.repeat(np.arange(n), count)
        order = np.lexsort((h, text))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        kinds = np.bincount(text[order][new], minlength=n)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        length = np.bincount(text, (ends - starts).astype(float), minlength=n)
        lines = np.bincount(row[part == 10], minlength=n) + 1
        x = np.column_stack([
            np.sqrt(by_kind[:, 1:3] / size[:, None]), np.sqrt(by_kind[:, 4:5] / size[:, None]), np.sqrt(by_kind[:, 5:] / size[:, None]),
            np.log1p(count) / 10, kinds / some, kinds / np.sqrt(some) / 10, np.sqrt(np.bincount(text[again], minlength=n) / some),
            length / some / 10, np.log1p(count / lines) / 10, (count < 50).astype(float),
        ])
        yield lo, hi, x


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7, max_pairs: int = MAX_PAIRS) -> np.ndarray:
    """Weights; all zero without rows of both classes."""
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return np.zeros(x.shape[1])
    n = min(max_pairs, 8 * (len(better) + len(worse)))
    # each labelled row is in pairs as often as any other of its class
    deal = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    scale = x.std(0) + 1e-6
    d = (x[deal(better)] - x[deal(worse)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + L2 * np.eye(len(w)), d.T @ p / n - L2 * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def curve(raw: Column, cut: float, scale: float) -> Column:
    """0.7 at the cut."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (raw - cut) / scale * 2 + float(np.log(CUT / (1 - CUT)))))))


def _training(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """text and class of the bounded training sample; only its few ids meet the documents."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("good"))
    some = [rows.where(F.col("good") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for c in (0, 1)]
    # at most 2 * limit ids
    return docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("good", "text")


def score(docs: DataFrame, labels: DataFrame, n: int = 4, rest: int = 2, column: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["good", "x"])

    train = _training(docs, labels.where(remainder(labels, n) != rest), column, limit).mapInArrow(examples, "good int, x array<float>").toArrow()
    x = np.stack([np.zeros(N_FEATURES, np.float32), *train.column("x").to_pylist()])[1:].astype(float)
    good = train.column("good").to_numpy() == 1
    # rows arrive in any order; pairs are dealt from a fixed one
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)
    w = fit(x[order], good[order])
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (remainder(docs, n) == rest).alias("held_out"))
    if not w.any():
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column(1)):
                yield pa.record_batch([*[c.slice(lo, hi - lo) for c in (batch.column(0), batch.column(2))], pa.array(x @ w)], ["doc_id", "held_out", "raw"])

    found = stored(rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, raw double"), "raw scores")
    known = labels.where(remainder(labels, n) != rest).where(F.col(column).isin(0, 1)).select(F.col("doc_id").alias("_labelled"), F.col(column).alias("_good"))
    known = found.join(known, F.col("doc_id") == F.col("_labelled"))
    share, scale = known.agg(F.avg(1 - F.col("_good")), F.stddev_pop("raw")).first()
    last_bad = known.agg(F.percentile_approx("raw", float(share), 100_000)).first()[0]
    score = curve(F.col("raw"), float(np.nextafter(last_bad, np.inf)), scale or 1.0)
    return found.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
