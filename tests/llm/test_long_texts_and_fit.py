"""Texts beyond the steps that vectorised code takes, and the quality classifier against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leafmill.llm import common, decontam, lm_bloom, pairwise_quality, quality_rules, token_pack
from leafmill.llm.queries import WORD_BPE

BLANKS = r"[\x20\x09-\x0D]+"
PASSAGE = "this passage of the benchmark has twelve words and stands late here"


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of more than a step's bytes among short ones; what a test looks for stands at their ends."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)] + ["é", "Ünï", "#", "UP"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "\n"]) for _ in range(n))
    texts = ["short", text(230_000) + " " + PASSAGE.upper(), None, text(60), text(210_000) + " again again again again", ""]
    assert sum(len((t or "").encode()) > common.STEP_BYTES for t in texts) == 2
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def words(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def test_rules_of_long_texts(spark, long):
    rows, table = long
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_report(table, labels).collect()}
    for d, t, *_ in rows:
        w = words(t)
        again = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if again[g] > 1 for j in range(3)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(covered))


def test_model_of_long_texts(long):
    rows, table = long
    lower = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    counts = collections.Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in lm_bloom.score(table, lm_bloom.held_out(table)).collect():
        own = [*lower(rows[r.doc_id][1]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(x in counts for x in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in own))


def test_passages_of_long_texts(spark, long):
    rows, table = long
    bench = spark.createDataFrame([(7, PASSAGE), (8, "not in any of them at all, whatever one may look for")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.digest(decontam.contamination(table, bench)).collect()}
    for d, t, *_ in rows:
        n = len([w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w])
        hit = 12 if d == 1 else 0
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (n, hit, int(hit > 0), hit > 0)


def test_ids_of_long_texts(long):
    rows, table = long
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(WORD_BPE)), 0
    for r in token_pack.packed(table, public_tokenizers.path(WORD_BPE)).orderBy("doc_id").collect():
        ids = [*tokenizer.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_features(text):
    data = text.encode()
    size = max(1, len(data))
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    count = lambda f: sum(map(f, data))
    control = count(lambda b: (b < 33 and b not in b" \t\n\x0b\x0c\r") or b == 127)
    shares = [count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57), control, *[count(lambda b, m=m: b == m) for m in marks]]
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", data) if x]
    low = [x.lower() for x in w]
    some = max(1, len(w))
    again = sum(a == b for a, b in zip(low, low[1:]))
    lengths = sum(map(len, w))
    return [
        *[np.sqrt(x / size) for x in shares], np.log1p(len(w)) / 10, len(set(low)) / some, len(set(low)) / np.sqrt(some) / 10, np.sqrt(again / some),
        lengths / some / 10, np.log1p(len(w) / (data.count(b"\n") + 1)) / 10, float(len(w) < 50),
    ]


def texts_of(n):
    rng = random.Random(13)
    good, bad = ["river", "stone", "plain", "the", "of"], ["BUY!", "$$$", "now", "now", "x9#", "\x01"]
    make = lambda some, k: " ".join(rng.choice(good if rng.random() < some else bad) + rng.choice(["", "\n", "", ""]) for _ in range(k))
    return [(i, make((i % 2) * 0.35 + 0.4, rng.randint(0, 120)), i % 2) for i in range(n)]


def test_features_plainly(long):
    texts = [t or "" for _, t, *_ in long[0] if len(t or "") < 10_000] + ["", " ", "a\x7fb\x00", "é É Aa aA"] + [t for _, t, _ in texts_of(50)]
    found = np.concatenate([x for _, _, x in pairwise_quality.features(pa.array(texts))])
    assert found.shape[1] == pairwise_quality.N_FEATURES and np.allclose(found, [plain_features(t) for t in texts])
    # a text of a step's size and more has the features of the whole text
    whole = long[0][4][1]
    (found,) = [x for _, _, x in pairwise_quality.features(pa.array([whole]))]
    assert np.allclose(found[0], plain_features(whole))


def test_fit_is_the_least_loss(spark):
    """The weights are where the loss over the pairs has no slope, found here by plain descent."""
    rows = texts_of(300)
    x, good = np.array([plain_features(t) for _, t, _ in rows]), np.array([q == 1 for *_, q in rows])
    scale = x.std(0) + 1e-6
    w = pairwise_quality.fit(x, good) * scale
    rng = np.random.default_rng(7)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = 8 * len(rows)
    deal = lambda of: np.concatenate([rng.permutation(of) for _ in range(-(-n // len(of)))])[:n]
    d = (x[deal(better)] - x[deal(worse)]) / scale
    plain = np.zeros(x.shape[1])
    for _ in range(20_000):
        plain += 0.5 * (d.T @ (1 / (1 + np.exp(d @ plain))) / n - pairwise_quality.L2 * plain)
    loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + pairwise_quality.L2 / 2 * (v @ v)
    assert loss(w) <= loss(plain) + 1e-9 and loss(w) == pytest.approx(loss(plain), rel=1e-4)


def test_scores_plainly(spark):
    rows = texts_of(400) + [(900, None, 0), (901, "", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    trained = [(i, t or "", q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    of = {i: np.array(plain_features(t or "")) for i, t, _ in rows}
    x, good = np.array([of[i].astype(np.float32) for i, *_ in trained]).astype(float), np.array([q == 1 for *_, q in trained])
    order = np.lexsort(x.T)
    w = pairwise_quality.fit(x[order], good[order])
    raw = {i: v @ w for i, v in of.items()}
    known = np.sort([raw[i] for i, *_ in trained])
    last_bad = known[int(np.ceil((~good).mean() * len(known))) - 1]
    got = {r.doc_id: r for r in pairwise_quality.score(table.drop("quality"), table.drop("text")).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        want = 1 / (1 + np.exp(-np.clip((raw[i] - last_bad) / known.std() * 2 + np.log(0.7 / 0.3), -30, 30)))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.score == pytest.approx(want, abs=1e-3)
        if abs(raw[i] - last_bad) > 1e-4 * known.std():
            assert r.predicted == int(raw[i] > last_bad)
    assert hashlib.md5(str(sorted((i, round(r.score, 9)) for i, r in got.items())).encode()).hexdigest() == hashlib.md5(str(sorted((r.doc_id, round(r.score, 9)) for r in pairwise_quality.score(table.drop("quality").repartition(7), table.drop("text")).collect())).encode()).hexdigest()
