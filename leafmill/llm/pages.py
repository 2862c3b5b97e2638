"""Main text of web pages: what a page shares with the nearest page of its host is deleted, and what its markup says is no article.

Pages are ordered by URL path within each host, and the lines (blocks) of each are aligned with those of the page before and after it,
whichever path has more of its beginning in common, by longest common subsequence. Shared lines go, unless the two pages are copies of
one article (COPY of their characters shared): then the other side decides, and if that is a copy, too, nothing goes. Where a page
has lines inside `article` or `main`, its text is just them, shared or not, for articles quote and repeat; it is still a neighbour.
Differencing can't do it alone: menus, adverts and footers often differ between neighbours, and paragraphs are often the same. So
lines that elements, roles or classes mark as menu, header, footer, sidebar, notice, advert, form, script or comment go as well.

A host may have any number of pages: they are numbered by ranges and compared in runs of RUN pages, of which the first and last are
dealt to both neighbouring runs. For that only hashes of lines are dealt. Lines are aligned in memory linear in them.

Null html is empty, an empty or unmarked page without words has an empty text. Pages without url or host are compared with none. Pages
with one path are ordered by their place in the stored table; equal rows are rows and, as copies, delete nothing of each other. Columns
beyond page_id, url and html are left out. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, tidy
from .ranks import numbered

RUN = 256
#: Pages that share so much are copies of one article, not two pages of one template.
COPY = 0.8
#: Bits of a table of the alignment that is held at once.
TABLE_BITS = 1 << 26
OPEN, ARTICLE, MARKED = range(3)

# Markup ---------------------------------------------------------------------

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not markup, and is no text of the page.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
DROPPED = set("head nav aside form button select option datalist template noscript canvas object svg math audio video dialog menu applet map".split())
MAIN = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
#: Words of class and id names that mark an element.
NAMES = set(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification
    popup popover modal overlay newsletter subscribe subscription signup paywall sidebar sidenav rail widget widgets related recommended recommendations trending comment comments
    commentlist disqus respond replies nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager toc share sharing sharebar social toolbar login search
    searchform skip hidden""".split()
)
#: Those that mark one only outside an article, whose own title may stand in a header.
OUTER = set("header masthead footer foot colophon banner topbar bottombar copyright legal".split())
#: What a class name begins with that tells of a page's form, not of the element.
ABOUT = set("has no with without is not show hide".split())
NEVER = {"html", "body"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
}
P_ENDS = {"td", "th", "table", "caption", "button", "object"}

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|[!?/])")
_PLAIN = re.compile(r"[^>\"']*+")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The lines of one page, from its first character to the last in one go."""

    def __init__(self, source: str) -> None:
        self.source, self.lines, self.parts = source, [], []
        #: open elements: name, whether it marks what is in it, whether it is an article
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.marked = self.articles = 0
        self.kind = OPEN
        self.unclosed: set[str] = set()
        self.parse()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.kind))

    def text(self, text: str) -> None:
        if not text:
            return
        kind = MARKED if self.marked else ARTICLE if self.articles else OPEN
        if kind != self.kind:
            # words inside a block that are marked are a line of their own; the block goes on after them
            if kind == MARKED or self.kind == MARKED:
                self.aside(kind)
            else:
                self.flush()
            self.kind = kind
        self.parts.append(entities.unescape(text) if "&" in text else text)

    def aside(self, kind: int) -> None:
        if kind == MARKED:
            self.held, self.parts = (self.parts, self.kind), []
            return
        self.flush()
        held, of = self.held
        if of == kind:
            self.parts = held
        elif held:
            self.parts, self.kind = held, of
            self.flush()
        self.held = ([], OPEN)

    held: tuple[list[str], int] = ([], OPEN)

    def end_block(self) -> None:
        self.flush()
        held, of = self.held
        if held:
            self.parts, self.kind = held, of
            self.flush()
        self.held = ([], OPEN)

    def pop(self) -> None:
        name, marks, article = self.stack.pop()
        self.open[name] -= 1
        self.marked -= marks
        self.articles -= article

    def close(self, names: set[str], barriers: set[str]) -> None:
        """End the nearest open element of these names, unless a barrier is nearer."""
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in barriers:
                return

    def marks(self, name: str, attributes: str) -> bool:
        if name in NEVER:
            return False
        if name in DROPPED:
            return True
        inner = bool(self.articles) or name in MAIN
        if name == "footer" or name == "header" and not inner:
            return True
        if not attributes.strip(" /"):
            return False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
                return True
            if key == "role" and value.lower() in ROLES:
                return True
            if key in ("class", "id"):
                for x in value.split():
                    found = [w.lower() for w in _NAME_WORDS.findall(x)]
                    if name in MAIN and len(found) > 1 or found and found[0] in ABOUT:
                        continue
                    if any(w in NAMES or not inner and w in OUTER for w in found):
                        return True
        return False

    def tag_end(self, at: int) -> int:
        """The place after the tag's `>`, quoted values skipped; -1 if the page ends in it."""
        while True:
            plain = _PLAIN.match(self.source, at)
            at = plain.end()
            if at >= len(self.source):
                return -1
            c = self.source[at]
            if c == ">":
                return at + 1
            if plain[0].rstrip().endswith("=") and c not in self.unclosed:
                end = self.source.find(c, at + 1)
                if end < 0:
                    self.unclosed.add(c)
                at = max(end, at)
            at += 1

    def parse(self) -> None:
        source, at = self.source, 0
        while True:
            m = _TAG.search(source, at)
            self.text(source[at : m.start() if m else len(source)])
            if not m:
                break
            if m[2] is None:
                end = source.find("-->", m.end()) + 3 if m[0] == "<!--" else source.find(">", m.end()) + 1
                at = end if end > 2 or m[0] != "<!--" and end else len(source)
                continue
            at = self.tag_end(m.end())
            if at < 0:
                break
            name = m[2].lower()
            if m[1]:
                self.end(name)
            else:
                self.start(name, source[m.end() : at - 1])
                if name in RAW:
                    at = self.skip(name, at)
        self.end_block()

    def skip(self, name: str, at: int) -> int:
        ends = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.source, at)
        self.end(name)
        if not ends:
            return len(self.source)
        at = self.tag_end(ends.end())
        return len(self.source) if at < 0 else at

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
        if name not in INLINE:
            self.end_block()
            self.close({"p"}, P_ENDS)
            if name in CLOSES:
                self.close(*CLOSES[name])
        if name in VOID:
            return
        marks = self.marks(name, attributes)
        # what an article of a list or of a sidebar holds is marked anyway
        article = name in MAIN
        self.stack.append((name, marks, article))
        self.open[name] += 1
        self.marked += marks
        self.articles += article

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        if self.open[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()


def lines(source: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, white space joined, with OPEN, ARTICLE or MARKED for where they stand."""
    return Page(source).lines


# Alignment -------------------------------------------------------------------


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit vectors after 0 to len(b) of b: where bit j is 0, one more of a's first j + 1 is matched than of its first j."""
    places: dict[int, int] = {}
    for j, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(a)) - 1
    out = [full]
    for x in b:
        v = out[-1]
        u = v & places.get(x, 0)
        out.append((v + u | v - u) & full)
    return out


def _matched(v: int, n: int) -> list[int]:
    """Lengths of the longest common subsequence with the first 0 to n."""
    out = [0]
    for j in range(n):
        out.append(out[-1] + 1 - (v >> j & 1))
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    known = set(a) & set(b)
    at = [j for j, x in enumerate(a) if x in known]
    return [at[j] for j in _common([a[j] for j in at], [x for x in b if x in known])]


def _common(a: list[int], b: list[int]) -> list[int]:
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    edges = [*range(lo)], [*range(len(a) - hi, len(a))]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inner: list[int] = []
    if a and b and len(a) * len(b) > TABLE_BITS and len(b) > 1:
        # by halves of b: a is cut where the two halves match most together
        half = len(b) // 2
        front = _matched(_last(a, b[:half]), len(a))
        rear = _matched(_last(a[::-1], b[half:][::-1]), len(a))
        cut = max(range(len(a) + 1), key=lambda j: front[j] + rear[len(a) - j])
        inner = _common(a[:cut], b[:half]) + [cut + j for j in _common(a[cut:], b[half:])]
    elif a and b:
        rows, row, j = _rows(a, b), len(b), len(a)
        while row and j:
            if rows[row] >> j - 1 & 1:
                j -= 1
                continue
            row -= 1
            if rows[row] >> j - 1 & 1:
                j -= 1
                inner.append(j)
        inner.reverse()
    return edges[0] + [lo + j for j in inner] + edges[1]


def _last(a: list[int], b: list[int]) -> int:
    places: dict[int, int] = {}
    for j, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return v


def beginning(a: str, b: str) -> int:
    """Characters that two paths begin with alike."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def template(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """Places of the lines that a page shares with its nearest neighbour that is no copy of it."""
    near = [x for x in (before, after) if x]
    near.sort(key=lambda x: -beginning(page["path"], x["path"]))
    for other in near:
        places = common(page["hashes"], other["hashes"])
        # of the text that may be the page's own
        own = [j for j in range(len(page["hashes"])) if page["kinds"][j] != MARKED]
        shared = sum(page["sizes"][j] for j in set(places) & set(own))
        most = max(sum(page["sizes"][j] for j in own), sum(n for n, k in zip(other["sizes"], other["kinds"], strict=True) if k != MARKED))
        if shared < COPY * most or not most:
            return places
    return []


# The operator ----------------------------------------------------------------


_LINES = "array<struct<text:string,kind:int,hash:long,size:int>>"
_LINE = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for x in batch["html"]:
            # a reference to half a pair of code units has no UTF-8 form
            clean = [(t.encode("utf-8", "replace").decode(), k) for t, k in lines(x.as_py() or "")]
            found.append([{"text": t, "kind": k, "hash": _hash(t), "size": len(t)} for t, k in clean])
        columns = {**{c: batch[c] for c in batch.schema.names if c != "html"}, "lines": pa.array(found, _LINE)}
        columns["article"] = pa.array([any(x["kind"] == ARTICLE for x in page) for page in found], pa.bool_())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    tidy()


def _compared(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    out = []
    for i, r in enumerate(rows):
        if r["place"] // RUN != r["run"] or r["article"]:
            continue
        before = rows[i - 1] if i and rows[i - 1]["place"] == r["place"] - 1 else None
        after = rows[i + 1] if i + 1 < len(rows) and rows[i + 1]["place"] == r["place"] + 1 else None
        goes = [False] * len(r["hashes"])
        for j in template(r, before, after):
            goes[j] = True
        out.append({"rid": r["rid"], "goes": goes})
    return pa.Table.from_pylist(out, pa.schema([("rid", pa.int64()), ("goes", pa.list_(pa.bool_()))]))


def parsed(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, host, path, lines (text, kind, hash, size) and article (whether it has lines of one) of each page, stored."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(_parsed, f"page_id {kinds['page_id']}, url {kinds['url']}, lines {_LINES}, article boolean")
    url = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(.*)$"
    host = F.lower(F.regexp_extract("url", url, 1))
    out = out.withColumns({"host": F.when(host != "", host), "path": F.regexp_extract("url", url, 2), "rid": F.monotonically_increasing_id()})
    return stored(out, "page-lines")


def shared_lines(parsed: DataFrame) -> DataFrame:
    """rid and goes (a boolean for each line, true if it is deleted) for each page that has a host and no article."""
    keys = parsed.where("host IS NOT NULL").selectExpr("rid", "host", "path", "article", "lines.hash AS hashes", "lines.kind AS kinds", "lines.size AS sizes")
    rows = numbered(keys, ["host"], [F.col("path").asc(), F.col("rid").asc()], "page-order")
    runs = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor((F.col("place") + i) / RUN).cast("long")))
    dealt = rows.withColumn("run", F.explode(runs)).where("run >= 0")
    return dealt.groupBy("host", "run").applyInArrow(_compared, "rid long, goes array<boolean>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_lines (of the text) of each page.

    Only pages without an article wait for their neighbours; the texts of the others are not dealt.
    """
    found = parsed(pages)
    marked = found.where("article").withColumn("kept", F.filter("lines", lambda x: x["kind"] == ARTICLE))
    goes = lambda i: F.coalesce(F.get("goes", i), F.lit(False))
    compared = found.where("NOT article").join(shared_lines(found), "rid", "left")
    compared = compared.withColumn("kept", F.filter("lines", lambda x, i: (x["kind"] == OPEN) & ~goes(i)))
    out = marked.select("page_id", "url", "kept").unionByName(compared.select("page_id", "url", "kept"))
    out = out.select("page_id", "url", F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("text"), F.size("kept").cast("long").alias("n_lines"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines")
