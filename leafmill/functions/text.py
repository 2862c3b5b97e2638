"""Scalar functions on titles, labels, revisions and formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of headings and of lines that are none.
HEADING_FORMS = (
    r"^\d+\s+.+$",
    r"^\d+\.\d+\s+.+$",
    r"^\d+\.\d+\.\d+\s+.+$",
    r"^\d+(\.\d+){1,5}\s+.+$",
    r"^(Chapter|Section|Part|Appendix)\s+[A-Z0-9]+",
    r"^[A-Z][A-Z\s\-\/]{5,}$",
)
NUMBERED = r"^(\d+(?:\.\d+){0,5})\s+(.+)$"
KEYWORD = r"^(Chapter|Section|Part|Appendix)\s+[A-Z0-9]+"
UPPERCASE = r"^[A-Z][A-Z\s\-\/]{5,}$"
PAGE_NUMBER = r"(?i)^(?:page\s*)?\d{1,5}(?:\s*(?:/|of)\s*\d{1,5})?$"
COPYRIGHT = r"(?i)(copyright|all rights reserved|\(c\)|©)"
URL_OR_EMAIL = r"(?i)(https?://|www\.|\S+@\S+\.\S+)"
FIGURE_OR_TABLE = r"(?i)^(figure|fig\.|table)\s+\d+"
# Aircraft types in titles, in the order of their tests.
FLEETS = ("787", "777", "737", "320", "321", "330", "350", "380")
# Words that end a section's name, and words that are no part of it.
SECTION_STOPS = (
    r"(?i)\b(?:ISSUE|REV(?:ISION)?|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC|TABLE\s+OF\s+CONTENTS|NUMBER\s+INSTALLED|"
    r"NUMBER\s+REQUIRED|CATEGORY|ITEM\s+DESCRIPTION|REMARKS\s+OR\s+EXCEPTIONS|REMARKS|PAGE)\b"
)
SECTION_NOISE = (
    r"(?i)\bMINIMUM\s+EQUIPMENT\s+LIST\s*&?\b",
    r"(?i)\bDISPATCH\s+DEVIATION\s+GUIDE\b",
    r"(?i)\bDEVIATION\s+GUIDE\b",
    r"(?i)\bDISPATCH\b",
    r"(?i)\bAI\s*/\s*ENGG\s*/\s*MEL\s*/\s*[A-Z0-9-]+\b",
    r"(?i)\bBOEING\b",
    r"(?i)\bAIRBUS\b",
)
ROMAN = "^[IVXLCDM]{1,6}$"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_text(text: Column) -> Column:
    """White space collapsed and trimmed, that of Unicode included."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def repetition_key(text: Column) -> Column:
    """Lower case, digit runs as #."""
    return F.regexp_replace(F.lower(normalize_text(text)), r"\d+", "#")


def _dashes(text: Column) -> Column:
    return F.translate(F.upper(text), " –—", " --")


def normalize_label(text: Column) -> Column:
    """X3 for item labels."""
    return normalize_text(_dashes(text))


def normalize_link_label(text: Column) -> Column:
    """X3 for links: also dashes that were decoded wrongly."""
    return normalize_text(F.regexp_replace(_dashes(text), "â€[“”]|Â€[“”]", "-"))


def normalize_revision_label(text: Column) -> Column:
    """X3 for revisions: no blanks about hyphens, TOC forms made even."""
    x = F.regexp_replace(_dashes(text), r"\s+", " ")
    x = F.regexp_replace(x, r"\bTOC\s*-\s*(\d+)\b", "TOC-$1")
    x = F.regexp_replace(x, r"\s*-\s*", "-")
    return F.trim(F.regexp_replace(x, r"\bTOC(\d{2}-)", "TOC $1"))


def normalize_title(text: Column) -> Column:
    """X4."""
    x = F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))
    x = F.regexp_replace(x, r"\bMSGS\b", "MESSAGES")
    x = F.regexp_replace(x, r"\b(?:B787|787|PDF|MEL)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^\d+\s+", ""), r"\s+", " "))


def normalize_reference(text: Column) -> Column:
    """X5."""
    x = F.translate(F.upper(text), "–—", "--")
    x = F.regexp_replace(x, r"(\d{2})\s*-\s*(\d+)", "$1-$2")
    x = F.regexp_replace(x, r"([A-Z]{2,5})\s*-\s*(\d+)", "$1-$2")
    return normalize_text(F.regexp_replace(x, r"\bTOC\s+(\d{2})-(\d+)", "TOC $1-$2"))


def reference_labels(text: Column) -> Column:
    """Labels in a text, those of contents pages first, then lettered ones, then the rest; distinct."""
    x = normalize_reference(text)
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in (r"\bTOC\s+\d{2}-\d+\b", r"\b[A-Z]{2,5}-\d+\b", r"\b\d{2}-\d+\b")]))
    rank = lambda v: F.when(v.startswith("TOC "), 0).when(v.rlike("^[A-Z]{2,5}-"), 1).otherwise(2)
    ordered = F.sort_array(F.transform(found, lambda v, i: F.struct(rank(v).alias("r"), i.alias("i"), v.alias("v"))))
    return F.transform(ordered, lambda s: s["v"])


def target_label(text: Column, chapter: Column) -> Column:
    """The first label, else the chapter's first contents page for chapters from 20 on."""
    inferred = F.when(chapter.rlike(r"^\d+$") & (chapter.try_cast("int") >= 20), F.concat(F.lit("TOC "), chapter, F.lit("-1")))
    return F.coalesce(F.get(reference_labels(text), F.lit(0)), inferred)


def ata_chapter(text: Column) -> Column:
    """X8."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bATA[ \-–—]*(\d{2})\b", 1), F.lit(""))


def is_item_label(text: Column) -> Column:
    """X9."""
    return normalize_label(text).rlike(r"^\d{2}(-\d{2}){1,6}[A-Z]?$")


def fleet(text: Column) -> Column:
    """X11: the first aircraft type that a text names."""
    out = F.lit(None).cast("string")
    for x in reversed(FLEETS):
        maker, name = ("BOEING", f"B?\\s*{x}") if x.startswith("7") else ("AIRBUS", f"A\\s*{x}")
        out = F.when(text.rlike(rf"(?i)\b(?:{maker}\s*)?{name}(?:-\d+)?\b"), x if x.startswith("7") else f"a{x}").otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Up to eight words in lower case, without Roman numerals at the start or repeated i, v, x."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    plain = lambda w: ~F.upper(w).rlike(ROMAN)
    first = lambda w: F.coalesce(F.array_position(F.transform(w, plain), True), F.lit(0))
    rest = bound(words, lambda w: F.when(first(w) > 0, F.slice(w, first(w).cast("int"), F.greatest(F.size(w), F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)")))
    once = bound(F.transform(rest, F.lower), lambda w: F.filter(w, lambda x, i: ~(x.isin("i", "v", "x") & F.coalesce(F.get(w, i - 1) == x, F.lit(False)))))
    return F.nullif(F.array_join(F.slice(once, 1, 8), "_"), F.lit(""))


def section_slug(header: Column) -> Column:
    """The section named after the chapter in a page's header."""
    x = F.regexp_extract(header, r"(?is)\bATA[ \-–—]*\d{2}\b(.*)$", 1)
    for noise in SECTION_NOISE:
        x = F.regexp_replace(x, noise, " ")
    x = F.get(F.split(x, SECTION_STOPS, 2), F.lit(0))
    x = F.regexp_replace(x, r"(?i)\b(?:B|A)?\d{3}(?:-\d+)?\b", " ")
    return slug(F.regexp_replace(x, r"(?i)[^A-Z0-9\s/&-]+", " "))


def bookmark(text: Column) -> Column:
    """Fleet, chapter and section of an outline title; null where one is missing."""
    form = r"(?i)\b(787|777|737|A\s*320|A\s*321|A\s*330|A\s*350|A\s*380)[\s_-]+(\d{2})[\s_-]+(.+)"
    x = normalize_text(F.translate(text, " –—", " --"))
    kind = F.lower(F.regexp_replace(F.regexp_extract(x, form, 1), r"\s", ""))
    name = F.concat_ws("_", kind, F.regexp_extract(x, form, 2), slug(F.regexp_extract(x, form, 3)))
    return F.when(x.rlike(form) & slug(F.regexp_extract(x, form, 3)).isNotNull(), name)


def header_bookmark(header: Column) -> Column:
    """The same from a page's header, hard spaces and long dashes as plain ones."""
    def named(x: Column) -> Column:
        found = [fleet(x), ata_chapter(x), section_slug(x)]
        return F.when(found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull(), F.concat_ws("_", *found))

    return bound(normalize_text(F.translate(header, "\u00a0–—", " --")), named)


def is_title_case(text: Column) -> Column:
    """At least 60 % of the words that don't begin with a digit begin with a capital."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d"))
    return bound(words, lambda w: (F.size(w) > 0) & (F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) / F.greatest(F.size(w), F.lit(1)) >= 0.6))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def looks_like_sentence(text: Column) -> Column:
    """At least eight words, and more than 65 % of the letters lower case."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (word_count(text) >= 8) & (letters > 0) & (F.regexp_count(text, F.lit(r"\p{Ll}")) / F.greatest(letters, F.lit(1)) > 0.65)


def clean_title(text: Column) -> Column:
    """White space collapsed, no blanks or dots at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def is_heading_form(text: Column) -> Column:
    """X16."""
    found = text.rlike(HEADING_FORMS[0])
    for form in HEADING_FORMS[1:]:
        found = found | text.rlike(form)
    return found


def normalize_revision(text: Column) -> Column:
    """X18."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(text), r"(?i)^REV\s*[-:]?\s*", ""), F.lit("")), F.trim(text))


def next_revision(current: Column, fallback: Column) -> Column:
    """3 to 4, 3A to 4A; without a current one the fallback plus one, else 1."""
    number, suffix = (F.regexp_extract(current, r"(?i)^(\d+)([A-Z]?)$", i) for i in (1, 2))
    after = F.concat((F.try_add(number.try_cast("long"), F.lit(1))).cast("string"), F.upper(suffix))
    return F.when(current.isNull(), F.coalesce((fallback + 1).cast("string"), F.lit("1"))).when(number != "", after).otherwise("1")


def chapter_of_label(label: Column) -> Column:
    """X19."""
    return F.nullif(F.regexp_extract(normalize_revision_label(label), r"\b(?:TOC\s+)?(\d{2})-", 1), F.lit(""))


def toc_label(label: Column) -> Column:
    """With the prefix of a contents page."""
    return F.when(label.startswith("TOC "), label).otherwise(F.concat(F.lit("TOC "), label))


def item_level(label: Column) -> Column:
    """Hyphened parts less two, 1 to 6."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.size(F.split(label, "-")) - 2))


def local_row_level(label: Column) -> Column:
    """Hyphened parts less one, 2 to 6."""
    return F.greatest(F.lit(2), F.least(F.lit(6), F.size(F.split(label, "-")) - 1))


def download_name(path: Column, suffix: str = "", extension: str = "") -> Column:
    """The file's stem with characters that names can't have as underscores, one for a run of them, then suffix and extension."""
    name = F.element_at(F.split(F.coalesce(F.nullif(path, F.lit("")), F.lit("document")), r"[\\/]"), -1)
    safe = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(safe, r"^[ ._]+|[ ._]+$", ""), F.lit("")), F.lit("document")), F.lit(suffix + extension))


def number_text(value: Column) -> Column:
    """Two decimals, zeros at the end cut."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), "0+$", ""), r"\.$", "")


def color_hex(value: Column) -> Column:
    """X21."""
    return F.when(value.isNotNull(), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value.cast("long"))), 6, "0"))).otherwise("")


def safe_tag(text: Column) -> Column:
    """X21."""
    x = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_-]", "_")
    return F.when(x.rlike(r"^\d") | (x == ""), F.concat(F.lit("field_"), x)).otherwise(x)


def is_bold(font: Column, flags: Column, wide: bool = True) -> Column:
    """By name or flag 16; wide: heavy and demi fonts as well, as lines count them."""
    names = ("bold", "black", "heavy", "demi") if wide else ("bold", "black")
    return F.lower(font).rlike("|".join(names)) | (flags.bitwiseAND(F.lit(16)) != 0)


def is_italic(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike("italic|oblique") | (flags.bitwiseAND(F.lit(2)) != 0)


def revision_date(text: Column) -> Column:
    """An ISO date as MON YYYY, else upper case with single blanks."""
    x = F.trim(text)
    iso = F.upper(F.date_format(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"), "MMM yyyy"))
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), F.regexp_replace(F.upper(x), r"\s+", " "))


def natural_key(text: Column) -> Column:
    """O3: an array that sorts labels with digits by value: digit runs padded, other runs as they are."""
    parts = F.regexp_extract_all(normalize_revision_label(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p))


def sort_key(text: Column) -> Column:
    """A string that sorts whatever its case and accents, runs of digits by value (their length goes first). Null sorts as an empty text."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    value = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(value(p)).cast("string"), 9, "0"), value(p))).otherwise(p))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def dumped(*columns: Column | str) -> Column:
    """Fields as a JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def loaded(json: Column, schema: str, strict: bool = False) -> Column:
    """A JSON object as fields; what isn't one gives nulls, or an error if strict."""
    return F.from_json(json, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def json_field(json: Column, name: str) -> Column:
    """A field of a JSON object as text; null if there is none."""
    return F.get_json_object(json, f"$['{name}']")
