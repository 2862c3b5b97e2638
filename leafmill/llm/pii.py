"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Kinds of the base set: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). The method adds
iban (mod 97), ssn (three, two and four digits, none of the parts all zeros) and secret (32 to 64 letters, digits, hyphens and underscores, with
letters and digits: a key or a token). Each kind has a prior; a checksum that holds adds to it, and a context word within CONTEXT
characters before or after the span adds to it, and what reaches THRESHOLD is a span. Base spans and ibans reach it by their form and checksum
alone; an ssn or a secret, whose forms say little, needs a context word. Spans of different kinds may overlap.

All in expressions of the JVM. Positions are code points; a kind's matches are leftmost and don't overlap: between them lie
the pieces of the text split by the same expression, so positions are running sums of lengths, taken by runs of RUN matches: the work grows
with the text's length and RUN times its matches. Expressions use
possessive repeats, so that long runs neither backtrack nor use stack; they match what the plain expressions match. An iban's groups may be
followed by words or numbers in capitals: its span is the longest row of whole groups that is valid.

A null text is empty and has no spans. Repeated rows get a row each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, whole

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
#: The same matches as [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+: a match begins where a run of its first
#: characters begins, or at the end of the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
#: Runs of digits with at most one blank or hyphen between; only runs of 16 to 19 digits can count.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![A-Za-z0-9])(?: [A-Z0-9]++(?![A-Za-z0-9])){0,9}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,64}+(?![A-Za-z0-9_-])",
}
#: A character without which a text has no match; and kinds that can have one without any digit.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "ssn": "-", "secret": ""}
WITHOUT_DIGITS = ("email",)
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.7, "iban": 0.3, "ssn": 0.3, "secret": 0.3}
CHECKED, NEARBY, THRESHOLD, CONTEXT = 0.4, 0.3, 0.6, 40
#: Matches whose lengths are added one by one; runs before them are added as wholes.
RUN = 64
WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|credit|debit|amex|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax id",
    "secret": "token|secret|password|passwd|api|bearer|key|auth|credential",
}


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number of 15 to 34 characters, letters counted from A = 10 and its first four moved to the end, leaves 1."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def _valid_groups(match: Column) -> Column:
    """The longest row of an iban's groups, from the first on, that is valid; null if none is."""
    def longest(groups: Column) -> Column:
        rows = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
        return F.get(F.filter(rows, mod97), F.lit(0))

    return _bound(F.split(match, " "), longest)


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: _bound(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) <= 3) & (F.coalesce(F.when(F.length(x) <= 3, x).try_cast("int"), F.lit(999)) <= 255)))


def _form(kind: str, match: Column) -> Column:
    """What must hold of a match's form."""
    n = F.length(_digits(match))
    return {
        "ip": lambda: _octets(match),
        "card": lambda: n.between(16, 19),
        "phone": lambda: n.between(8, 15),
        "ssn": lambda: ~match.rlike("^000|-00-|0000$"),
        "secret": lambda: match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
    }.get(kind, lambda: F.lit(True))()


def _checksum(kind: str, match: Column) -> Column:
    # an iban that isn't valid is none, and is gone before
    return {"card": lambda: luhn(_digits(match)), "iban": lambda: F.lit(True)}.get(kind, lambda: F.lit(False))()


def _sum(array: str) -> str:
    return f"aggregate({array}, 0, (a, y) -> a + y)"


def _matches(text: str, kind: str) -> Column:
    """All matches of a kind in a text, an SQL expression: start, match, and what stands before and after it.

    Positions are the lengths of all pieces and matches before. It is put together as SQL, as that is much less to send than columns are.
    """
    pattern = PATTERNS[kind]
    piece, found = "get(x.pieces, i{})".format, "get(x.found, i{})".format
    lengths = f"transform(x.found, (m, i) -> length({piece('')}) + length(m))"
    runs = f"transform(sequence(0, cast(greatest((size(lengths) - 1) / {RUN}, 0) AS int)), r -> {_sum(f'slice(lengths, r * {RUN} + 1, {RUN})')})"
    ahead = f"transform(runs, (s, r) -> {_sum('slice(runs, 1, r)')})"
    start = f"get(ahead, cast(i / {RUN} AS int)) + {_sum(f'slice(lengths, i - i % {RUN} + 1, i % {RUN})')} + length({piece('')})"
    # four matches of the kinds that need a context are longer than it
    earlier = ", ".join(f"CASE WHEN i >= {k} THEN concat({piece(f' - {k}')}, {found(f' - {k}')}) ELSE '' END" for k in (4, 3, 2, 1))
    later = ", ".join(f"coalesce({found(f' + {k}')}, ''), coalesce({piece(f' + {k + 1}')}, '')" for k in (1, 2, 3, 4))
    before = f"right(CASE WHEN length({piece('')}) >= {CONTEXT} THEN {piece('')} ELSE concat({earlier}, {piece('')}) END, {CONTEXT})"
    after = f"left(CASE WHEN length({piece(' + 1')}) >= {CONTEXT} THEN {piece(' + 1')} ELSE concat({piece(' + 1')}, {later}) END, {CONTEXT})"
    out = f"transform(x.found, (m, i) -> struct({start} AS start, m AS match, {before} AS before, {after} AS after))"
    for name, value in (("ahead", ahead), ("runs", runs), ("lengths", lengths), ("x", f"struct(split({text}, r'{pattern}', -1) AS pieces, regexp_extract_all({text}, r'{pattern}', 0) AS found)")):
        out = f"element_at(transform(array({value}), {name} -> {out}), 1)"
    # most texts have no match at all
    some = (f"contains({text}, '{NEEDS[kind]}') AND " if NEEDS[kind] else "") + f"rlike({text}, r'{pattern.replace(chr(92) + 'G|', '')}')"
    return F.expr(f"CASE WHEN {some} THEN {out} ELSE cast(array() AS array<struct<start: int, match: string, before: string, after: string>>) END")


def spans(kinds: tuple[str, ...] = BASE + ADDED) -> Column:
    """Of the column text: array of kind, start, end (code points, end exclusive), score; by kind in the order of kinds, then start."""
    none = F.expr("cast(array() AS array<struct<kind: string, start: int, end: int, score: double>>)")
    # most texts have no digit, and then are read once for all kinds that need one
    digit = F.col("text").rlike("[0-9]")
    found = [(k, _scored(k)) for k in kinds]
    return F.concat(*[F.concat(*[c for _, c in part]) if free else F.when(digit, F.concat(*[c for _, c in part])).otherwise(none) for free, part in groupby(found, lambda x: x[0] in WITHOUT_DIGITS)])


def _scored(kind: str) -> Column:
    def score(m: Column) -> Column:
        words = f"(?<![a-z])(?:{WORDS[kind]})"
        near = F.lower(m["before"]).rlike(words) | F.lower(m["after"]).rlike(words)
        return F.lit(PRIOR[kind]) + F.when(_checksum(kind, m["match"]), CHECKED).otherwise(0.0) + F.when(near, NEARBY).otherwise(0.0)

    def span(m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), score(m).alias("score"))

    found = _matches("coalesce(text, '')", kind)
    if kind == "iban":
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), _valid_groups(m["match"]).alias("match"), m["before"].alias("before"), m["after"].alias("after")))
    # a card or an account number without its checksum is none, whatever words stand by
    proved = {"card": lambda m: _form(kind, m["match"]) & _checksum(kind, m["match"]), "iban": lambda m: m["match"].isNotNull()}.get(kind, lambda m: _form(kind, m["match"]))
    return F.filter(F.transform(F.filter(found, proved), span), lambda s: s["score"] >= THRESHOLD - 1e-9)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans."""
    return docs.select("doc_id", spans().alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; where spans overlap, the first that begins stays."""
    rows = docs.select(whole(docs).alias("d"), F.col("text").alias("t"), spans().alias("s"))
    by_start = F.sort_array(F.transform("s", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def cut(a: Column, s: Column) -> Column:
        skip = s["start"] < a["at"]
        piece = F.concat(F.substring(F.col("t"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(skip, a["at"]).otherwise(s["end"]).alias("at"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], piece)).alias("out"))

    done = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.length("t"))))
    rows = rows.withColumn("done", F.when(F.size("s") > 0, done).otherwise(F.col("t")))
    return rows.select(*[F.col("done").alias(c) if c == "text" else F.col(f"d.{quoted(c)}").alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and joined base spans of the four kinds, and all spans joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
