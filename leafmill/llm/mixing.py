"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of `share` times all words, at most `limit` times what the
source has; what is above that limit is shared anew among the others by weight until none is above. In a source, a document's expected
copies are e = min(limit, unit * w): w is its inclusion weight (by default the number of binary digits of its size, so longer documents are
likelier), and unit makes the expected words of the source its target. floor(e) whole copies are certain, and for the rest the
inclusion probability is p = e - floor(e). Documents are ranked by their random odds u / (1 - u) divided by their inclusion odds
p / (1 - p), with u a hash of doc_id in (0, 1), and come in by rank up to the place where the source's words come nearest to the target. The
sample's size is fixed in words, not in documents, as sizes differ widely.

The place is found without sorting a source in one task: words are summed by source and bin of ln(rank), and the bin that holds the place is
cut into bins again; documents of one such small bin (of BINS * FINE over the range of ranks) go in or stay out together, whichever is nearer.

Null texts and texts without words have size 0 and take 0. Documents of source null are a source, the last one. The same
doc_id gives the same u on every run; repeated rows count as documents of their own and go in or stay out together. An empty table gives no
rows. Only doc_id, source and text are read; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small, stored, unpacked, whole

WEIGHTS = (3, 1, 2)
SHARE, MAX_COPIES = 1.5, 2.0
BINS, FINE = 1 << 12, 1 << 20
#: ln of ratios of odds of 52-bit numbers lies within these.
LOW, HIGH = -80.0, 80.0


def word_count(text: Column) -> Column:
    """Runs of other characters than blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def by_length(size: Column) -> Column:
    """Binary digits of the size."""
    return F.length(F.bin(size)).cast("double")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size) to source, source_size, target. Sources are few beside documents; their table is one row each.

    The shares settle in one step for all: with sources by limit * size / weight, those up to some place are at their limit and
    the rest share what is left by weight.
    """
    named = sizes.select("source", F.col("source_size").cast("double").alias("size"), "source_size")
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("size") * limit / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = named.withColumn("weight", cases).withColumn("wanted", F.sum("size").over(everything) * share).withColumn("weights", F.sum("weight").over(everything))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # the share a weight of 1 gets if this source and those after it are below their limits
    ranked = ranked.withColumn("unit", (F.col("wanted") - F.coalesce(F.sum("size").over(before) * limit, F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("below", F.col("unit") * F.col("weight") <= F.col("size") * limit)
    level = F.min(F.when(F.col("below"), F.struct(F.col("size") * limit / F.col("weight"), F.col("source").isNull(), "source", "unit"))).over(everything)["unit"]
    target = F.least(F.coalesce(level * F.col("weight"), F.col("size") * limit), F.col("size") * limit)
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def _uniform() -> Column:
    """In (0, 1), by doc_id: 52 bits of its hash."""
    digits = F.substring(F.md5(F.concat(F.lit("pareto order "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _by_source(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with goals' columns of their source."""
    others = [f"g.{c}" for c in goals.columns if c != "source"]
    return rows.alias("r").join(small(goals).alias("g"), F.expr("r.source <=> g.source"), "left").select("r.*", *others)


def _ranked(rows: DataFrame, limit: float) -> DataFrame:
    """rows (doc_id, size, weight, unit) with certain copies and the logarithm of the rank, null where nothing is left to chance."""
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(limit)), F.coalesce(F.col("unit") * F.col("weight"), F.lit(float(limit))))).otherwise(0.0)
    rows = rows.withColumn("certain", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    u = _uniform()
    rank = F.log(u) - F.log(1 - u) + F.log(1 - F.col("p")) - F.log(F.col("p"))
    return rows.withColumn("rank", F.when(F.col("p") > 0, rank)).drop("p")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = MAX_COPIES) -> DataFrame:
    """rows (doc_id, source, size, weight) to source, source_size, target, unit and cut: documents of a rank below it come in once more.

    Inclusion weights are positive and have few distinct values, whose sums are taken by source.
    """
    levels = stored(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")), "levels")
    goals = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    # the highest weights are at the limit; unit: what a weight of 1 gets if those from this one down are below it
    order = W.partitionBy("source").orderBy(F.desc("weight"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    each = levels.alias("l").join(goals.alias("g"), F.expr("l.source <=> g.source")).select("g.*", "l.weight", "l.words")
    each = each.withColumn("unit", (F.col("target") - limit * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("words") * F.col("weight")).over(after), F.lit(0.0)))
    fits = F.when(F.col("unit") * F.col("weight") <= limit, F.struct("weight", "unit"))
    goals = stored(each.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max(fits)["unit"].alias("unit")), "targets")
    ranked = _ranked(_by_source(rows, goals), limit).select("source", "size", "certain", "rank")
    width = (HIGH - LOW) / BINS
    bins = ranked.groupBy("source", F.floor((F.col("rank") - LOW) / width).alias("bin")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("sure"))
    by_bin = W.partitionBy("source").orderBy(F.asc_nulls_first("bin"))
    bins = bins.withColumn("sure", F.sum("sure").over(W.partitionBy("source"))).withColumn("upto", F.sum(F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)).over(by_bin))
    bins = bins.alias("b").join(goals.select("source", "target").alias("g"), F.expr("b.source <=> g.source")).select("b.*", (F.col("target") - F.col("sure")).alias("goal"))
    # the first bin that reaches the goal, and the words before it
    reach = F.min(F.when(F.col("bin").isNotNull() & (F.col("upto") >= F.col("goal")), F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))))
    place = stored(bins.groupBy("source").agg(F.first("goal").alias("goal"), reach.alias("b")).select("source", "goal", "b.bin", "b.before"), "place")
    inside = _by_source(ranked, place).where("rank is not null").where(F.floor((F.col("rank") - LOW) / width) == F.col("bin"))
    low = F.lit(LOW) + F.col("bin") * width
    fine = F.least(F.floor((F.col("rank") - low) / width * FINE), F.lit(FINE - 1))
    sums = inside.groupBy("source", "goal", "bin", "before", fine.alias("fine")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("fine")))
    reach = sums.where("upto >= goal").groupBy("source", "bin").agg(F.min(F.struct("fine", (F.col("upto") - F.col("goal") <= F.col("goal") - F.col("upto") + F.col("words")).cast("int").alias("in"))).alias("f"))
    cuts = reach.select("source", (low + (F.col("f.fine") + F.col("f.in")) * (width / FINE)).alias("cut"))
    # where no bin reaches the goal, all ranks come in
    return stored(goals.alias("g").join(cuts.alias("c"), F.expr("g.source <=> c.source"), "left").select("g.*", F.coalesce("c.cut", F.lit(HIGH)).alias("cut")), "plan")


def allocate(rows: DataFrame, goals: DataFrame, limit: float = MAX_COPIES) -> DataFrame:
    """rows (doc_id, source, size, weight, ...) with source_size, target, copies and taken."""
    found = _ranked(_by_source(rows, goals), limit)
    copies = F.col("certain") + F.coalesce((F.col("rank") < F.col("cut")).cast("int"), F.lit(0))
    return found.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("unit", "cut", "certain", "rank", "weight")


def sized(docs: DataFrame, weight=by_length) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("weight", weight(F.col("size"))).drop("text")


def mixture(docs: DataFrame, weight=by_length, **options) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, copies, taken. weight: a size's inclusion weight."""
    rows = stored(sized(docs.select("doc_id", "source", "text"), weight), "sizes")
    return allocate(rows, plan(rows, **options), options.get("limit", MAX_COPIES))


def mixed(docs: DataFrame, weight=by_length, **options) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    goals = plan(stored(sized(docs.select("doc_id", "source", "text"), weight), "sizes"), **options)
    rows = sized(docs.select(whole(docs).alias("d"), "doc_id", "source", "text"), weight)
    taken = allocate(rows, goals, options.get("limit", MAX_COPIES)).where("copies > 0")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)
