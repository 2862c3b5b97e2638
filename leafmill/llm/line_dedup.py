"""Line dedup by a deletion-neighbourhood join, from DataFrame operations alone.

Lines are the \\n-split parts of texts that have a word. Two lines are equal if they are the same string, and near if one
character replaced, added or left out makes them equal and the longer has at least MIN_CHARS characters. Lines are ordered by doc_id
(null first) and place in the text. A line is dropped if an equal or near line comes before it; so the earliest stays. Lines
without words are never dropped.

Method: a line's variants within the edit bound are the line without the character at place i (for a partner with as many
or fewer) and the line split at i (for a partner with one more). Variants are hashed keys; lines with equal keys at the
same place are near. The earliest of a key is the partner of its others, found by a partial-aggregated minimum, so no pairs
within a key are made. The edit distance of a line and its partner is verified on their texts.

Variants of all places would be far more than the text. So places are narrowed first by the same join on coarser keys: the line
without one half, and then without one of about sqrt(n / 2) parts of a half. A pair that differs at one place has equal
keys for the half and the part that hold it; a half or part whose key no other line has needs no variants.

Null texts have no lines. Rows with the same doc_id and text have the same lines dropped. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored, whole

EDITS, MIN_CHARS = 1, 10
_BLANKS = r"\x20\x09-\x0D"


def _row_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), pos, line: the lines that have a word."""
    rows = docs.select("doc_id", _row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(f"[^{_BLANKS}]"))


def _key(line: Column, m: Column, lo: Column, hi: Column) -> Column:
    """Hash of a line without what stands at places lo to hi, for partners of which the longer has m characters."""
    after = m - hi
    n = F.length(line)
    return F.xxhash64(m, lo, hi, F.substring(line, F.lit(1), lo), F.substring(line, n - after + 1, after))


def _packed(longer: Column, lo: Column, hi: Column) -> Column:
    """Places lo to hi to leave out, and whether partners have a character more, in one number."""
    return F.shiftleft(lo.cast("long"), 32).bitwiseOR(F.shiftleft(hi.cast("long"), 1)).bitwiseOR(longer.cast("long"))


def _unpacked(p: Column, n: Column) -> dict[str, Column]:
    return {"m": (n + p.bitwiseAND(F.lit(1))).cast("int"), "lo": F.shiftright(p, 32).cast("int"), "hi": F.shiftright(p, 1).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")}


def _met(rows: DataFrame) -> DataFrame:
    """rows (h, p, key) whose key another line has, one of them with as many characters as the longer; without key."""
    sums = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.col("p").bitwiseAND(F.lit(1))).alias("longer"))
    return rows.join(sums.where("c > 1 and longer = 0").select("key"), "key").drop("key")


def _parts(m: Column, lo: Column, hi: Column, size: Column) -> Column:
    """Ranges of size places that make up lo to hi."""
    return F.transform(F.sequence(lo, F.greatest(lo, hi - 1), size), lambda i: F.struct(m.alias("m"), i.alias("lo"), F.least(hi, i + size).alias("hi")))


def _half(n: Column, j: Column | int) -> tuple[Column, Column, Column]:
    """The jth range to leave out, 0 to 3: m, lo, hi; both halves for partners as long or shorter, then for those longer by one."""
    j = F.lit(j) if isinstance(j, int) else j
    m = n + F.floor(j / 2).cast("int")
    mid = F.floor(m / 2).cast("int")
    return m, F.when(j % 2 == 0, 0).otherwise(mid), F.when(j % 2 == 0, mid).otherwise(m)


def _halves(line: Column) -> Column:
    """The keys of the four ranges."""
    return F.array(*[_key(line, *_half(F.length(line), j)) for j in range(4)])


def near_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, row, pos, h) and, for lines that have an earlier one, h, earliest (struct doc, pos, row), near (whether it is a near line)."""
    own = lines(docs).select("doc_id", "row", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("n"), F.when(F.length("line") >= MIN_CHARS - 1, _halves(F.col("line"))).alias("halves"))
    narrow = stored(own, "lines")
    place = F.struct(F.col("doc_id").alias("doc"), "pos", "row")
    firsts = stored(narrow.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("c"), F.max("n").alias("n")), "firsts")
    # a line's first place brings its halves: each distinct line once, but for repeated rows
    once = narrow.where("halves is not null").select("h", "n", "halves").dropDuplicates(["h"])
    each = once.select("h", "n", F.posexplode("halves").alias("j", "key"))
    m, lo, hi = _half(F.col("n"), F.col("j"))
    ranges = _met(each.where(m >= MIN_CHARS).select("h", _packed(F.floor(F.col("j") / 2), lo, hi).alias("p"), "key")).groupBy("h").agg(F.collect_set("p").alias("ranges"))
    wanted = ranges.join(firsts.select("h", "first"), "h")
    by_doc = wanted.groupBy("first.doc", "first.row").agg(F.collect_list(F.struct("h", "first.pos", "ranges")).alias("some"))
    texts = docs.select("doc_id", _row_key().alias("row"), "text").alias("t").join(by_doc.alias("b"), F.expr("t.doc_id <=> b.doc and t.row = b.row"))
    some = texts.select("t.doc_id", "t.row", F.split("t.text", "\n").alias("parts"), "b.some")
    lined = some.select("doc_id", "row", F.explode(F.transform("some", lambda s: F.struct(s["h"].alias("h"), s["pos"].alias("pos"), s["ranges"].alias("ranges"), F.get("parts", s["pos"]).alias("line")))).alias("s"))
    # repeated rows have their lines twice
    lined = lined.select("s.h", F.struct(F.col("doc_id").alias("doc"), "s.pos", "row").alias("first"), "s.ranges", "s.line", F.length("s.line").alias("n")).dropDuplicates(["h"])
    candidates = stored(lined, "candidates")
    exploded = candidates.select("h", "n", "line", F.explode("ranges").alias("p"))
    exploded = exploded.select("h", "n", "line", *[v.alias(k) for k, v in _unpacked(F.col("p"), F.col("n")).items()])
    sized = exploded.withColumn("size", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("hi") - F.col("lo"))).cast("int")))
    small = sized.select("h", "n", "line", F.explode(_parts(F.col("m"), F.col("lo"), F.col("hi"), F.col("size"))).alias("g")).select("h", "n", "line", "g.*")
    keyed = small.select("h", _packed(F.col("m") - F.col("n"), F.col("lo"), F.col("hi")).alias("p"), _key(F.col("line"), F.col("m"), F.col("lo"), F.col("hi")).alias("key"))
    left = _met(keyed).groupBy("h").agg(F.collect_set("p").alias("small")).join(candidates.drop("ranges"), "h")
    single = left.select("h", "n", "first", "line", F.explode("small").alias("p")).select("h", "n", "first", "line", *[v.alias(k) for k, v in _unpacked(F.col("p"), F.col("n")).items()])
    single = single.select("h", "n", "first", "line", F.explode(_parts(F.col("m"), F.col("lo"), F.col("hi"), F.lit(1))).alias("g")).select("h", "n", "first", "line", "g.*")
    variants = single.select("h", F.struct("first.doc", "first.pos", "first.row", "h").alias("at"), (F.col("n") == F.col("m")).alias("whole"), _key(F.col("line"), F.col("m"), F.col("lo"), F.col("hi")).alias("key"))
    variants = stored(variants, "variants")
    # the earliest of a key's lines, and of those with all m characters
    full = F.when(F.col("whole"), F.col("at"))
    shared = variants.groupBy("key").agg(F.min("at").alias("any"), F.min(full).alias("full"), F.count("*").alias("c")).where("c > 1 and full is not null").drop("c")
    links = variants.join(shared, "key").select("h", "at", F.when(F.col("whole"), F.col("any")).otherwise(F.col("full")).alias("best")).where("best < at")
    links = links.groupBy("h").agg(F.min("best").alias("best"))
    texts = candidates.select("h", "line", "n")
    found = links.join(texts, "h").join(texts.select(F.col("h").alias("_h"), F.col("line").alias("other"), F.col("n").alias("m")), F.col("best.h") == F.col("_h"))
    near = found.where(F.levenshtein("line", "other", EDITS) >= 0).select("h", F.struct("best.doc", "best.pos", "best.row").alias("partner"))
    earlier = firsts.select("h", "first", "c").join(near, "h", "left").where("c > 1 or partner is not null")
    return narrow.select("doc_id", "row", "pos", "h"), earlier.select("h", F.least("first", "partner").alias("earliest"), F.col("partner").isNotNull().alias("near"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, dropped (sorted array of places), n_near: for the texts that lose lines."""
    every, earlier = near_lines(docs)
    gone = every.join(earlier, "h").where("earliest < struct(doc_id, pos, row)")
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"), F.count_distinct(F.when(F.col("near"), F.col("pos"))).alias("n_near"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_dropped, n_near (of those, of lines whose first place has a near line before it), dropped (places, comma-joined)."""
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{_BLANKS}]"))).cast("long")
    rows = docs.select("doc_id", _row_key().alias("row"), count.alias("n_lines"))
    found = rows.alias("r").join(dropped_lines(docs).alias("d"), F.expr("r.doc_id <=> d.doc_id and r.row = d.row"), "left")
    return found.select("r.doc_id", "r.n_lines", F.coalesce(F.size("d.dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("d.n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join(F.transform("d.dropped", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, and texts without the dropped lines."""
    rows = docs.select(whole(docs).alias("d"), "doc_id", F.col("text").alias("t"), _row_key().alias("row")).alias("r")
    met = rows.join(dropped_lines(docs).alias("l"), F.expr("r.doc_id <=> l.doc_id and r.row = l.row"), "left").select("r.d", "r.t", "l.dropped")
    # an array of the lines' places but for those dropped: set difference by hash, not by search
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split("t", "\n")) - 1), "dropped")
    lines_of = F.split("t", "\n")
    rest = F.element_at(F.transform(F.array(lines_of), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), 1)
    met = met.withColumn("rest", F.when(F.col("dropped").isNull(), F.col("t")).otherwise(rest))
    return met.select(*[F.col("rest").alias(c) if c == "text" else F.col(f"d.{quoted(c)}").alias(c) for c in docs.columns])
