"""Operators against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import decontam, line_dedup, lm_bloom, mixing, near_copies, pairwise_quality, pii, quality_rules, simhash, token_counts, token_pack
from leafmill.llm.queries import PIECES, QUERIES, SQL, WORD_BPE

LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp string, score double"
BENCH = [(0, "one two three four five six seven eight nine ten eleven twelve"), (1, "short item"), (2, None), (3, ""), (4, "...")]


def words(text):
    return [w for w in re.split(BLANKS, text.translate(LOWER)) if w]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "The", "of", "x@y.z", "4111111111111111", "1.2.3.4", "+1 (988) 555-2485", "é", "\n", "***", "short item"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", "  \n ", "copy of one text " * 30, "copy of one text " * 30, "w " * 30_000, "UP " * 80, BENCH[0][1].upper() + " end"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1, 7, "z", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "en", None, 1, 7, "z", 0.5), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_quality_measures(odd):
    want, got = collections.Counter(), collections.Counter()
    for d, t in rows_of(odd):
        w = [x for x in re.split(BLANKS, t) if x]
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    for r in quality_rules.measures(odd.select("doc_id", "lang", "text")).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
    assert got == want


def test_quality_risk(spark, odd, labels):
    k = spark.createDataFrame([(3, 50), (0, 10)], "k long, n long")
    tail = [r[0] for r in k.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.1)).collect()]
    assert tail == pytest.approx([0.2502939057, 0.9**10])
    assert odd.count() == quality_rules.quality_report(odd, labels).count()
    # a third of the labels proves: 2,000 of good documents with a measure of 0 prove the strictest cutoffs, 20 prove none
    good = lambda n: spark.range(3 * n).selectExpr("id as doc_id", "'en' as lang", "100L as n_words", "500L as word_chars", "0L as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words", "0L as n_upper", "5L as n_lines", "false as base_failed")
    marks = spark.range(9000).selectExpr("id as doc_id", "1 as quality")
    least = min(quality_rules.CUTOFFS)
    assert {r.cutoff for r in quality_rules.calibrate(good(2000), marks).collect()} == {least}
    assert quality_rules.calibrate(good(20), marks).count() == 0
    # 300 are too few for rules one by one, but not for all of them together
    found = {r.rule: r.cutoff for r in quality_rules.calibrate(good(300), marks).collect()}
    assert found == pytest.approx(dict.fromkeys(quality_rules.RULES, least * min(quality_rules.MULTIPLES)))
    assert quality_rules.calibrate(good(120), marks).count() == 0  # 0.98**120 > 0.05
    # a seventh of the good documents has 0.11 of symbols: no cutoff below that is proved
    mixed = good(300).withColumn("n_symbols", F.when(F.col("doc_id") % 7 == 0, 55).otherwise(0).cast("long"))
    assert 0.11 <= quality_rules.calibrate(mixed, marks).where("rule = 'symbol_ratio'").first().cutoff < 0.13


def test_quality_loss(spark):
    sf = "/root/testdata/sf0.1"
    found = quality_rules.false_rejections(*[spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels")]).collect()
    assert len(found) == 4 and all(r.rejected <= quality_rules.RISK * r.n for r in found)


def test_dotted_columns(spark, odd, labels, bench):
    """Columns with dots, and those that operators have names of their own for, stay as they are."""
    own = {"a.b": 1, "d": "x", "row": 2, "_row": 3, "_size": 4, "_copy": 5, "_spans": "y", "_gone": 6, "kept": 7, "cut": 8, "_w": 9, "key": 10}
    docs = odd.where("doc_id < 40").select("*", *[F.lit(v).alias(k) for k, v in own.items()])
    for kept in (quality_rules.good_documents(docs, labels), simhash.deduplicate(docs), decontam.decontaminate(docs, bench), mixing.mixed(docs), pii.redact(docs), line_dedup.deduplicate_lines(docs)):
        assert kept.columns == docs.columns and kept.schema["d"].dataType == docs.schema["d"].dataType
        for r in kept.collect():
            assert {k: r[k] for k in own} == own


@pytest.mark.parametrize("cap", [simhash.CAP, 3])
def test_simhash(odd, cap):
    rows = rows_of(odd)
    prints = []
    for _, t in rows:
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), x in zip(rows, group, strict=True) if x == g and d is not None), default=None) for g in group}
    want = collections.Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert collections.Counter(map(tuple, simhash.digest(simhash.near_duplicates(odd, cap)).collect())) == want


def test_near_copies_that_no_leader_meets(spark, monkeypatch):
    """200 pairs of texts: those of a pair have a similarity of 0.82, any others 0.797, so buckets hold many of all pairs and few of them are led."""
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = some(240), []
    for _ in range(200):
        own = some(4)
        texts += [" ".join(base + own + some(26)) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(i, j) for i in range(400) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near == {(i, i - 1) for i in range(1, 400, 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    names, keys = near_copies.sketch(pa.array(texts))
    place = {s: i for i, s in enumerate(names.to_pylist())}
    sketches = spark.createDataFrame(list(zip(names.to_pylist(), keys.to_pylist(), strict=True)), "s long, keys array<long>")
    assert {tuple(sorted((place[r.a], place[r.b]), reverse=True)) for r in near_copies.links(sketches, docs).collect()} == near


def test_near_copies(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(rng.choice([3, 60, 150]))]
        for _ in range(5):
            base = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                base[rng.randrange(len(base))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(base))
    texts += [None, " ", "one", "One"]
    rows = list(enumerate(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t or "")) else set() for t in texts]
    prints = [simhash.fingerprint([w.encode() for w in words(t or "")]) for t in texts]
    group, only = list(range(len(rows))), 0
    for i, j in ((i, j) for i in range(len(rows)) for j in range(i)):
        near, copy = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0, (prints[i] ^ prints[j]).bit_count() <= 2
        only += near and not copy
        if near or copy:
            x, y = sorted((group[i], group[j]))
            group = [x if g == y else g for g in group]
    assert only > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {i for i, g in enumerate(group) if g == i}


def test_decontamination(odd, bench):
    grams = {}
    for i, t in BENCH:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        for k in range(len(w) - min(10, len(w)) + 1) if w else ():
            grams.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    want = collections.Counter()
    for d, t in rows_of(odd):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hit, items = set(), set()
        for g, ids in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= ids
        want[(d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit))] += 1
    for words_at_once in (10**6, 3):
        assert collections.Counter(map(tuple, decontam.digest(decontam.contamination(odd, bench, words_at_once)).collect())) == want
    assert decontam.decontaminate(odd, bench).count() == sum(n for r, n in want.items() if not r[-1])


def test_items_without_id(spark):
    docs = spark.createDataFrame([(1, BENCH[0][1]), (2, "some other passage of more than ten words that no named item has"), (3, "no passage of any item")], "doc_id long, text string")
    items = spark.createDataFrame([(0, BENCH[0][1]), (None, "other passage of more than ten words that no named item has")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect()} == {1: (12, [0]), 2: (12, []), 3: (0, [])}
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == [3]
    blocks = decontam.digest(decontam.contamination(docs, items, 3)).collect()
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in blocks} == {(1, 12, 1, True), (2, 12, 0, True), (3, 0, 0, False)}


def test_pii_and_redaction(spark):
    texts = [
        "mail a@b.cd, card 4111 1111 1111 1111; ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32", "1 " * 20_000, "a" * 20_000 + "@", None,
        "123-45-6789 and DE89370400440532013000 The next, DE89 3704 0044 0532 0130 00 Please, DE89 3704 0044 0532 0130 00 NEXT 12",
        "api token = 0123456789abcdef0123456789abcdef; far from any such word there stands 0123456789abcdef0123456789abcdef",
        "123-45-6789 is their social number; then we: 0123456789abcdef0123456789abcdef, 1123456789abcdef0123456789abcdef is the key",
    ]
    d = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.find(d)).collect()}
    assert found[1].spans == "email:5:11,card:18:37,iban:60:87,ssn:43:54"
    assert found[2].spans == found[3].spans == found[4].spans == "" and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[5].spans == "iban:16:38,iban:49:76,iban:85:112"
    assert found[6].spans == "secret:12:44"
    assert found[7].spans == "ssn:0:11,secret:79:111"
    assert pii.redact(d).where("doc_id = 1").first().text == "mail [email], card [card]; ssn [ssn] iban [iban]"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    """Spans by the plain expressions and rules, one by one."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    near = lambda x, at, words: any(re.search(f"(?<![a-z])(?:{words})", y.lower()) for y in (text[max(0, at - 40) : at], text[at + len(x) : at + len(x) + 40]))
    iban = lambda x: 15 <= len(y := x.replace(" ", "")) <= 34 and int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x, at: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x, at: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x, at: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x, at: 8 <= len(digits(x)) <= 15),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*(?![A-Za-z0-9])(?: [A-Z0-9]+(?![A-Za-z0-9])){0,9}", None),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda x, at: not re.search("^000|-00-|0000$", x) and near(x, at, pii.WORDS["ssn"])),
        ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,64}(?![A-Za-z0-9_-])", lambda x, at: re.search("[0-9]", x) and re.search("[A-Za-z]", x) and near(x, at, pii.WORDS["secret"])),
    ]
    found = []
    for kind, pattern, holds in kinds:
        for m in re.finditer(pattern, text):
            x = m[0]
            if kind == "iban":
                groups = x.split(" ")
                x = next((y for n in range(len(groups), 0, -1) if iban(y := " ".join(groups[:n]))), None)
                if x is None:
                    continue
            elif not holds(x, m.start()):
                continue
            found.append(f"{kind}:{m.start()}:{m.start() + len(x)}")
    return ",".join(found)


def test_pii_plainly(spark):
    rng = random.Random(8)
    parts = ["a@b.cd", "x.y@z", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "0000 0000 0000 0000", "+1 (988) 555-2485", "+12", "+", "é", "𝄞", "\n", " ", " ", "-", ".",
             "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NEXT", "The", "123-45-6789", "000-45-6789", "ssn ", "token=", "key ", "0123456789abcdef0123456789abcdef", "_" * 33, "7", "a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(3000)) for _ in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in pii.digest(pii.find(d)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        base = [x for x in want.split(",") if x.split(":")[0] in pii.BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, got[i])
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k + ":") for x in base) for k in pii.BASE]
        assert got[i].spans == want, (t, got[i].spans, want)


def test_pii_long_text(spark):
    """A text of 200,000 matches takes seconds, not hours."""
    d = spark.createDataFrame([(1, "from 10.0.0.1 to a@b.cd\n" * 100_000)], "doc_id long, text string")
    began = time.time()
    r = pii.digest(pii.find(d)).first()
    assert (r.n_ip, r.n_email) == (100_000, 100_000) and time.time() - began < 60


def test_language_model(odd):
    rows = rows_of(odd)
    c = collections.Counter()
    for d, t in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((d is not None, d or 0, len(words(t)) + 1, sum(x in c for x in [*words(t), None]), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in [*words(t), None]), 5)) for d, t in rows)
    for head in (1 << 20, 2):
        got = lm_bloom.score(odd, lm_bloom.held_out(odd), head_words=head).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)


def test_pairs_of_rare_words_are_in_the_segment_of_the_word():
    rng = np.random.default_rng(1)
    previous, own = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    rare_previous, rare_own = rng.integers(0, 2, (2, 5000)).astype(bool)
    for bits in (0, 1, 2, 20, 21, 23):
        n = 1 << bits
        pairs = lm_bloom.segment_of(lm_bloom._pair(previous, own, rare_previous, rare_own, n), n)
        for rare, word in ((rare_own, own), (rare_previous & ~rare_own, previous)):
            assert (pairs[rare] == lm_bloom.segment_of(lm_bloom._single(word[rare]), n)).all()


def test_language_model_score(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(3000 * rng.random() ** 3)}" if rng.random() < 0.95 else f"z{rng.randrange(10**6)}" for _ in range(rng.randint(0, 250))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    single, pairs = collections.Counter(), collections.Counter()
    both = lambda t: list(zip([0, *words(t)], [*words(t), None], strict=True))
    for d, t in enumerate(texts):
        if zlib.crc32(str(d).encode()) % 7 != 2:
            single.update(x for pair in both(t) for x in ([0, pair[1]] if pair[0] == 0 else [pair[1]]))
            pairs.update(both(t))
    n, v = sum(single.values()) - single[0], len(single) - 1
    about = lambda c: c if c < 2 else 1.4 * 2 ** (c.bit_length() - 1)

    def log_p(h, w):
        alone, context = (about(single[w]) + 1) / (n + v + 1), about(single[h])
        return np.log10((min(about(pairs[h, w]), context) + lm_bloom.MU * alone) / (context + lm_bloom.MU))

    want = {d: sum(log_p(*x) for x in both(t)) for d, t in enumerate(texts)}
    entries = sum(c.bit_length() for x in (single, pairs) for c in x.values())
    assert entries > 3 * (1 << 16) * np.log(2) / 6  # the first part has room for a third
    most = lm_bloom.MOST_SEGMENTS
    # as it comes; many tasks and segments; more tasks than there may be segments
    for task_tokens, flush, segments in ((lm_bloom.TASK_TOKENS, lm_bloom.FLUSH, most), (10_000, 3000, most), (2_000, 3000, 4)):
        monkeypatch.setattr(lm_bloom, "TASK_TOKENS", task_tokens)
        monkeypatch.setattr(lm_bloom, "MOST_SEGMENTS", segments)
        monkeypatch.setattr(lm_bloom, "FLUSH", flush)
        for bits, head in ((lm_bloom.FILTER_BITS, lm_bloom.HEAD_WORDS), (1 << 12, 100)):
            got = {r.doc_id: r.score for r in lm_bloom.score(docs, lm_bloom.held_out(docs), filter_bits=bits, head_words=head).collect()}
            assert got.keys() == want.keys()
            # a filter finds some n-grams that aren't there
            assert np.mean([abs(got[d] - want[d]) / len(both(t)) for d, t in enumerate(texts)]) < 0.02


def test_mixing(spark, odd):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    by = mixing.mixture(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r.t - r.g) <= 50 and r.g <= 2 * r.s and r.most <= 2 for r in by)
    assert sum(r.g for r in by) == pytest.approx(1.5 * sum(r.s for r in by))
    assert mixing.mixture(odd).count() == odd.count() and set(mixing.mixed(odd).columns) == set(odd.columns)
    assert sorted(map(tuple, mixing.mixture(docs).collect())) == sorted(map(tuple, mixing.mixture(docs).collect()))


@pytest.mark.parametrize("limit", [2.0, 4.0])
def test_pareto_order(spark, limit):
    """The chosen documents against plain Python, with unequal weights."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(pow(2, id % 9) as int)) as text", "if(id % 2 = 0, 'a', if(id % 11 = 1, 'c', 'b')) as source")
    rows = {r.doc_id: r for r in mixing.mixture(docs, limit=limit).collect()}
    copies = collections.Counter(r.doc_id for r in mixing.mixed(docs, limit=limit).collect())
    assert copies == collections.Counter({d: r.copies for d, r in rows.items() if r.copies})
    assert plain_copies([(d, r.source, r.size) for d, r in rows.items()], limit) == {d: r.copies for d, r in rows.items()}


def plain_copies(rows, limit=2.0):
    """Copies by doc_id of rows (doc_id, source, size): targets shared anew until none is above its limit, then Pareto order."""
    size = collections.Counter()
    for _, source, n in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(limit * size[s] for s in full)
        free = [s for s in names if s not in full]
        target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > limit * size[s]]
        if not over:
            break
        target |= {s: limit * size[s] for s in over}
        full |= set(over)
    sure = {}
    for source in names:
        own = [(d, n, n.bit_length()) for d, s, n in rows if s == source]
        lo, hi = 0.0, 1e3
        for _ in range(200):
            unit = (lo + hi) / 2
            lo, hi = (unit, hi) if sum(s * min(limit, unit * w) for _, s, w in own) < target[source] else (lo, unit)
        order, upto = [], 0
        for d, s, w in own:
            e = min(limit, unit * w) if s else 0
            sure[d] = int(e + 1e-9)
            upto += sure[d] * s
            if (p := e - sure[d]) > 1e-9:
                u = (int(hashlib.md5(f"pareto order {d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append((u / (1 - u) * (1 - p) / p, d, s))
        ends = [upto]
        for _, _, s in sorted(order):
            ends.append(ends[-1] + s)
        n = min(range(len(ends)), key=lambda i: (abs(ends[i] - target[source]), -i))
        for _, d, _ in sorted(order)[:n]:
            sure[d] += 1
    return sure


def test_pairwise_quality(spark, odd, labels):
    good = [(i, f"the {i} quiet river of words runs on and over plain stones " * 3, 1) for i in range(200)]
    bad = [(1000 + i, f"BUY!! {i} NOW!! *** $$$ " * 9, 0) for i in range(200)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    found = pairwise_quality.score(d.drop("quality"), d.drop("text")).join(d, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    some = pairwise_quality.score(odd, labels).collect()
    assert len(some) == odd.count() and all(0 <= r.score <= 1 for r in some)
    assert {r.score for r in pairwise_quality.score(odd, labels.where("false")).collect()} == {0.5}


def test_token_counts_and_ids(spark, odd, tmp_path):
    rng = random.Random(3)
    letters = list("ab Z.,'!é̱́Hß\n\t  #x<|endoftext|>1２İΣς…—　\xa0\x00\x1cﬁ▁")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>x <|ENDOFTEXT|>", "don't I'll 'S", ".\"'s word.'s a.!'s", "a" * 500 + " " + "b" * 300 + "."]
    rows = [(i, t) for i, t in enumerate(texts)] + rows_of(odd.where("doc_id is not null").select("doc_id", "text"))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, public_tokenizers.path(PIECES)).collect())
    assert got == collections.Counter((i, len(t.encode()), len(model.encode(t))) for i, t in rows)
    ids = {}
    start, want = 0, collections.Counter()
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for i, t in sorted(rows):
        x = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        ids[i] = x
        want[(i, start, len(x), zlib.crc32(x.tobytes()))] += 1
        start += len(x)
    path = str(tmp_path / "tokens")
    found = token_pack.packed(d, public_tokenizers.path(WORD_BPE), path=path).collect()
    assert collections.Counter(map(tuple, found)) == want
    entry = token_pack.index(spark, path).where("doc_id = 2000").first()
    assert (token_pack.read_ids(spark, path, entry.shard, entry.offset, entry.n_tokens) == ids[2000]).all()


@pytest.mark.parametrize("name", sorted(x.name for x in Path(public_tokenizers.path("x")).parent.glob("*.json")))
def test_every_tokenizer(name):
    import pyarrow as pa

    rng = random.Random(7)
    pieces = ["Hello", "WORLD", "don't", " ", "  ", "\n", "<|endoftext|>", "<|", "é", "e\u0301", "İ", "ﬁ", "12", ".", "—", "\x00", "ß", "'S", "long" * 30]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, "word " * 300_000, "x" * 70_000]
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), token_pack.encoder(public_tokenizers.path(name))
    got = []
    for n, ids, before in own.encode(pa.array(texts), 1):
        got += np.split(ids, before[1:-1]) if n > 1 else [ids]
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("width", [5, 15, 16, 17])
def test_packing(width):
    ids = np.random.default_rng(1).integers(0, 2**width, 10_007).astype(np.uint32)
    packed = token_pack.pack(ids, width)
    assert (token_pack.unpack(packed, width, len(ids)) == ids).all() and (token_pack.unpack(packed, width, 77, 1234) == ids[1234:1311]).all()


def test_line_dedup(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 8, 9, 10, 11, 12, 20, 33, 100) for _ in range(6)]

    def changed(x):
        x = list(x)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, k = rng.randrange(len(x) + 1), rng.randrange(3)
            if k == 0:
                x.insert(i, rng.choice("abcdefgh"))
            elif i < len(x):
                x[i : i + 1] = [rng.choice("abcdefgh")] if k == 1 else []
        return "".join(x)

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(200, None), (201, "x\n\n"), (None, " lone line \n\n")]
    near = lambda a, b: max(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 1 and any(a[:i] == b[:i] and a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] for i in range(max(len(a), len(b))))
    seen, want = [], set()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        lines = [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip()]
        for p, x in lines:
            gone += [p] if any(x == y or near(x, y) for y in seen) else []
            seen.append(x)
        want.add((d, len(lines), ",".join(map(str, gone))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_lines, r.dropped) for r in line_dedup.line_report(d).collect()} == want
    assert line_dedup.deduplicate_lines(d).count() == len(rows)


def test_empty_tables(spark, odd, labels, bench):
    none = odd.where("false")
    assert quality_rules.quality_report(none, labels.where("false")).count() == simhash.near_duplicates(none).count() == 0
    assert decontam.contamination(none, bench.where("false")).count() == pii.find(none).count() == 0
    assert lm_bloom.score(none, lm_bloom.held_out(none)).count() == mixing.mixture(none).count() == pairwise_quality.score(none, labels).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path(PIECES)).count() == token_pack.packed(none, public_tokenizers.path(WORD_BPE)).count() == line_dedup.line_report(none).count() == 0


def components_of(n, linked):
    group = list(range(n))
    for i, j in linked:
        x, y = sorted((group[i], group[j]))
        group = [x if g == y else g for g in group]
    return group


def test_pipeline(spark, tmp_path):
    """run() against plain Python, stage by stage, on documents with copies, near copies, junk and benchmark passages; nulls and odd texts too."""
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(14))) for i in range(5)] + [(5, None), (6, "")]
    texts = []
    for _ in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 90, 150]))]
        if rng.random() < 0.15:
            base[30:30] = rng.choice(items[:5])[1].split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts += [None, "", " \n", "one two three " * 60, texts[0].upper()]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d"]), 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 90, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def passes(t):
        w = [x for x in re.split(BLANKS, t or "") if x]
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    # labels are too few for cutoffs: base rules alone
    kept = [r for r in rows if passes(r[1])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(r[1]) for r in kept)]
    prints = [simhash.fingerprint([w.encode() for w in words(r[1])]) for r in kept]
    near = [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = components_of(len(kept), near)
    first = [r for i, r in enumerate(kept) if group[i] == i]
    grams = {tuple(w[k : k + 10]) for _, t in items if t and (w := t.split(" ")) for k in range(len(w) - 9)}
    clean = [r for r in first if not any(tuple(w[k : k + 10]) in grams for w in [words(r[1])] for k in range(len(w) - 9))]
    assert len(rows) > len(kept) > len(first) > len(clean) > 0
    copies = plain_copies([(r[0], r[3], len(words(r[1]))) for r in clean])
    library, want, start = Tokenizer.from_file(public_tokenizers.path(WORD_BPE)), collections.Counter(), 0
    for r in clean:
        x = np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for _ in range(copies[r[0]]):
            want[(r[0], start, len(x), zlib.crc32(x.tobytes()))] += 1
            start += len(x)
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_pipeline_of_nothing(spark, tmp_path):
    """Stages on tables without rows, and with rows of nulls and columns of their own names."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
        assert stage(spark, nulls, sf).count() == {"quality rules": 0, "mixing": 0}.get(name, 3)


def test_oracle(spark):
    from oracle import differences

    for name, sql in SQL.items():
        more, less = differences(spark, QUERIES[name](spark, "/root/testdata/sf0.001"), sql, "/root/testdata/sf0.001")
        assert not more and not less
