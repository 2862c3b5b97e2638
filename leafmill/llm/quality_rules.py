"""Quality rules with controlled risk, from DataFrame operations alone.

A document fails base rules (fewer than 50 words, or more than half of them in repeated 3-word windows) or one of the
method's rules: a measure above a cutoff. Cutoffs are chosen for each rule and stratum (lang; null is one) on labelled documents that
are called good and pass the base rules, dealt into three folds by a hash of doc_id (FOLDS). The holdout alone proves cutoffs: n of its
documents have a measure and k are above a cutoff. A cutoff is valid if the exact binomial tail P(X <= k | n, risk) is at most its share of
the error level: the one-sided Clopper-Pearson upper bound of the false-rejection rate is then at most `risk`. Corrections: the error
level is divided by the number of tests and strata (Bonferroni), and a rule's cutoffs are tested from the mildest on until the first
fails (fixed sequence), which needs no further division. Half of the error level goes to rules one by one, which share the risk evenly; the
other half goes to all rules together, whose cutoffs stand in fixed proportions and have the whole risk, so a proof needs fewer labels.
The proportions are chosen on the tuning fold: for each rule the strictest cutoff that rejects at most half of `risk` of its documents. A
stratum has its cutoffs one by one if every rule has one, else those together, else what rules have one by one. All proofs hold at
once with probability 1 - delta, so whichever are taken, a stratum loses at most `risk` of its good documents. The third fold takes no
part; false_rejections() measures the loss on it. A stratum with too few labels for any proof has no cutoffs: only base rules apply.

A null text has no words and fails the base rules, as does an empty one. Rows with the same doc_id count with each label of that
doc_id; repeated rows get a row each. Labels of other values than 0 and 1, and of no document, are not used. A measure that equals a cutoff is
not above it. Empty tables give no rows, and without labels there are no cutoffs. Columns beside doc_id, lang and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, unpacked, whole

RISK, DELTA = 0.02, 0.1
MIN_WORDS = 50
RULES = ("symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio")
#: All rules together: the highest ratio of a measure to its rule's proportion.
TOGETHER = "together"
#: Cutoffs of each rule, and of all together, from the mildest to the strictest.
CUTOFFS = tuple(round(0.6 - 0.02 * i, 2) for i in range(29))
MULTIPLES = tuple(round(3 - 0.1 * i, 1) for i in range(28))
#: Remainders of the hash of doc_id: labels that set the proportions, that prove cutoffs, and that only measure.
FOLDS = TUNING, HOLDOUT, MEASURED = range(3)
BLANKS = r"\x20\x09-\x0D"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once though use names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def marked(placed: Column) -> Column:
        """placed: window and place, sorted. Places of windows that equal a neighbour, in order."""
        same = lambda i, j: F.get(placed, i)["h"] == F.get(placed, j)["h"]
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < n - 3, same(i, i + 1)).otherwise(False)), lambda i: F.get(placed, i)["i"]))

    def spans(places: Column) -> Column:
        """Words covered by windows at sorted places: three for each, less what overlaps the one before."""
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")))["n"]

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(bound(placed, marked), spans))

    return F.when(n < 3, 0).otherwise(bound(windows, count))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the rules' measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    split = F.split(text, f"[{BLANKS}]+")
    # only the first and the last piece can be empty
    words = bound(split, lambda w: F.slice(w, F.when(w[0] == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0))))
    both = bound(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    found = docs.withColumn("_w", both).withColumn("_l", bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))))
    found = found.withColumns({
        "n_words": F.col("_w.n").cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(f"[{BLANKS}]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("long"),
        "n_repeat_words": F.col("_w.r").cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_lines": F.col("_l.n").cast("long"),
    }).drop("_w", "_l")
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbol_ratio": share("n_symbols", "word_chars"), "upper_ratio": share("n_upper", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials of probability p; summed from the logarithms of its terms."""
    first = n * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))))).alias("s"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.least(F.lit(1.0), F.aggregate(terms, F.struct(first.alias("t"), F.exp(first).alias("s")), step)["s"])


def fold(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 7)
    return F.conv(digits, 16, 10).cast("long") % len(FOLDS)


def _passed(value: Column, grid: tuple[float, ...]) -> Column:
    """How many of the cutoffs, mildest first, the value passes."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: value <= c))


def _good(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, fold and measures of documents that labels call good and the base rules pass."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_labelled"))
    ratios = [v.alias(k) for k, v in _ratios().items()]
    return measured.where("not base_failed").join(good, F.col("doc_id") == F.col("_labelled")).select("lang", "doc_id", fold(measured["doc_id"]).alias("fold"), *ratios)


def _failing(long: DataFrame, grids: dict[str, tuple[float, ...]]) -> DataFrame:
    """long (lang, rule, passed: how many cutoffs a document's measure passes) to lang, rule, place, cutoff, n, and k, the number above the cutoff."""
    # a few counts for each rule and stratum
    counts = long.groupBy("lang", "rule", "passed").agg(F.count("*").alias("c"))
    sums = counts.groupBy("lang", "rule").agg(F.sum("c").alias("n"), F.collect_list(F.struct("passed", "c")).alias("by"))
    grid = F.lit(None)
    for rule, values in grids.items():
        grid = F.when(F.col("rule") == rule, F.array(*map(F.lit, values))).otherwise(grid)
    placed = sums.select("lang", "rule", "n", "by", F.posexplode(grid).alias("place", "cutoff"))
    return placed.select("lang", "rule", "place", "cutoff", "n", F.aggregate(F.filter("by", lambda x: x["passed"] <= F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("k"))


def _long(rows: DataFrame, passed: dict[str, Column]) -> DataFrame:
    return rows.select("lang", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), p.alias("passed")) for r, p in passed.items()])).alias("m")).select("lang", "m.*")


def proportions(good: DataFrame, risk: float) -> DataFrame:
    """lang and a column for each rule: the strictest cutoff that at most half of risk of the tuning fold's documents are above; else the mildest."""
    each = {r: _passed(F.col(r), CUTOFFS) for r in RULES}
    failing = _failing(_long(good.where(F.col("fold") == TUNING), each), dict.fromkeys(RULES, CUTOFFS))
    best = failing.groupBy("lang", "rule").agg(F.coalesce(F.min(F.when(F.col("k") <= F.col("n") * (risk / 2), F.col("cutoff"))), F.lit(CUTOFFS[0])).alias("cutoff"))
    return best.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest valid cutoffs. measured: doc_id, lang and what measures() adds."""
    good = _good(measured, labels)
    scales = proportions(good, risk)
    held = good.where(F.col("fold") == HOLDOUT).alias("g").join(scales.alias("s"), F.expr("g.lang <=> s.lang"), "left").select("g.*", *[f"s._{r}" for r in RULES])
    # without a tuning fold there are no proportions
    together = F.greatest(*[F.col(r) / F.col(f"_{r}") for r in RULES])
    passed = {r: _passed(F.col(r), CUTOFFS) for r in RULES} | {TOGETHER: F.when(F.col(f"_{RULES[0]}").isNull(), 0).otherwise(_passed(together, MULTIPLES))}
    tested = _failing(_long(held, passed), dict.fromkeys(RULES, CUTOFFS) | {TOGETHER: MULTIPLES})

    def tail(share: float) -> Column:
        # beyond the expected number no proof is possible, so long sums are never made
        return F.when(F.col("k") > F.col("n") * share, 1.0).otherwise(binomial_tail(F.col("k"), F.col("n"), share))

    # a row for each stratum, rule and cutoff
    tested = tested.withColumn("strata", F.size(F.collect_set(F.coalesce(F.col("lang"), F.lit("\0"))).over(W.partitionBy())))
    level = F.lit(delta / 2) / F.col("strata")
    tested = tested.withColumn("valid", F.when(F.col("rule") == TOGETHER, tail(risk) <= level).otherwise(tail(risk / len(RULES)) <= level / len(RULES)))
    first_bad = F.min(F.when(~F.col("valid"), F.col("place"))).over(W.partitionBy("lang", "rule"))
    valid = tested.withColumn("bad", first_bad).where("bad is null or place < bad")
    proved = valid.groupBy("lang").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in (*RULES, TOGETHER)])
    proved = proved.alias("p").join(scales.alias("s"), F.expr("p.lang <=> s.lang"), "left").select("p.*", *[f"s._{r}" for r in RULES])
    all_one_by_one = F.lit(True)
    for r in RULES:
        all_one_by_one = all_one_by_one & F.col(r).isNotNull()
    use_all = ~all_one_by_one & F.col(TOGETHER).isNotNull()
    cutoffs = F.array(*[F.struct(F.lit(r).alias("rule"), F.when(use_all, F.col(TOGETHER) * F.col(f"_{r}")).otherwise(F.col(r)).alias("cutoff")) for r in RULES])
    return proved.select(F.col("lang").alias("stratum"), F.explode(cutoffs).alias("c")).select("stratum", "c.*").where("cutoff is not null")


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with kept: it passes the base rules and no measure is above its stratum's cutoff."""
    per = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    joined = measured.join(per, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    fails = [F.coalesce(v > F.col(f"_{k}"), F.lit(False)) for k, v in _ratios().items()]
    failed = fails[0]
    for x in fails[1:]:
        failed = failed | x
    return joined.withColumn("kept", ~F.col("base_failed") & ~failed).drop("stratum", *[f"_{r}" for r in RULES])


_OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "base_failed")


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    measured = stored(measures(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", *_OWN), "measures")
    cutoffs = stored(calibrate(measured, labels, **options), "cutoffs")
    return judged(measured, cutoffs).select("doc_id", *_OWN[:5], "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    # measured once, beside the row
    row = docs.select(whole(docs).alias("d"), "doc_id", "lang", "text")
    measured = stored(measures(row).select("d", "doc_id", "lang", *_OWN), "measured")
    cutoffs = stored(calibrate(measured.drop("d"), labels, **options), "cutoffs")
    return unpacked(judged(measured, cutoffs).where("kept"), docs.columns)


def false_rejections(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """stratum, n, rejected: good documents of the fold that takes no part, and how many of them the cutoffs reject."""
    measured = stored(measures(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", *_OWN), "measures")
    kept = judged(measured, calibrate(measured, labels, **options))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_labelled"))
    found = kept.where("not base_failed").where(fold(kept["doc_id"]) == MEASURED).join(good, F.col("doc_id") == F.col("_labelled"))
    return found.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("rejected"))
