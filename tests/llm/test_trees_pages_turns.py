"""The manifest, the text of pages and the repair of conversations against plain Python."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import pytest
from oracle import differences

from leafmill.llm import conversations, merkle, pages
from leafmill.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place long, grp string, root string"
TURNS = "conv_id long, turn long, role string, text string, fault int, low long, present_ string"
PAGES = "page_id long, url string, html string, text string, rid long, lines string, host string"


@pytest.mark.parametrize("name", ["op11_merkle", "op13_conversation_repair"])
def test_sql(spark, name):
    more, less = differences(spark, QUERIES[name](spark, SMALL), SQL[name], SMALL)
    assert not more and not less


# Manifest ---------------------------------------------------------------------


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc):
    return hashed(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in doc])


def plain_tree(nodes):
    """The root, and for each node what stands beside it, upwards."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, path in enumerate(paths):
            run, i = runs[at[k] // 8], at[k] % 8
            path.append((run[:i], run[i + 1 :]))
            at[k] //= 8
        nodes = [hashed(*run) for run in runs]
    return nodes[0], paths


def plain_manifest(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    trees, out = {}, []
    for lang, rows in groups.items():
        rows.sort(key=lambda d: (d[0] is not None, d[0] or 0, plain_leaf(d)))
        trees[lang] = plain_tree([plain_leaf(d) for d in rows])
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = plain_tree([trees[x][0] for x in langs])
    for k, lang in enumerate(langs):
        for d, path in zip(groups[lang], trees[lang][1], strict=True):
            path = path + tops[k]
            tampered = zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 3 == 0
            lower = None if d[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), d[4])
            node = plain_leaf((*d[:4], lower)) if tampered else plain_leaf(d)
            for before, after in path:
                node = hashed(*before, node, *after)
            proof = hashed(*[x for before, after in path for x in before + after])
            out.append((d[0], plain_leaf(d), trees[lang][0], root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 70, "de": 9, "fr": 8, None: 3, "": 1, "é": 2}, {None: 1}, {"en": 1, "de": 1}, {f"l{i}": 1 + i % 3 for i in range(75)}])
def test_manifest(spark, sizes):
    rng, docs = random.Random(1), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "lower only", "Äpfel Und €", "UP " * rng.randint(1, 30)])
            docs.append((rng.choice([rng.randint(-5, 500), rng.randint(-5, 500), None]), rng.choice(["a", "", None]), lang, rng.choice([None, 3, -12]), text))
    docs += docs[:2]
    rows = [(d[0], d[4], d[2], d[1], d[3], "leaf", 3, "grp", "root") for d in docs]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(docs)


def test_manifest_of_no_rows_and_of_a_long_text(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    text = "Ab € " * 1_000_000
    got = merkle.manifest(spark.createDataFrame([(2, text, "en", "s", 1, "", 0, "", "")], DOCS)).first()
    assert got.leaf == got.subroot == got.root == plain_leaf((2, "s", "en", 1, text)) and got.proof_sha256 == hashed()


# Conversations ------------------------------------------------------------------


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faulty(rows):
    out, seen = [], set()
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        words = re.sub("[\x20\x09-\x0d]+$", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


GRAMMAR = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Cost, least audit and texts by trying all edits whose costs are within a limit that rises; short conversations only."""
    for limit in itertools.count():
        found = []

        def walk(i, left, audit, written, rows=rows, found=found):
            initials = "".join(r[:1] or "-" for r, _ in written)
            if i == len(rows) and GRAMMAR.fullmatch(initials):
                found.append((audit, written))
            if not GRAMMAR.fullmatch(initials + "a") and not GRAMMAR.fullmatch(initials + "ua") and not GRAMMAR.fullmatch(initials):
                return
            if left >= 2:
                for role in ("user", "assistant"):
                    walk(i, left - 2, audit + "I", [*written, (role, "")])
            if i == len(rows):
                return
            _, role, text, fault = rows[i]
            if left >= 3:
                walk(i + 1, left - 3, audit + "D", written)
            if fault in ("blank", "duplicate"):
                return
            more = fault == "truncated"
            if left >= more:
                walk(i + 1, left - more, audit + "K", [*written, (role, text)])
            if left >= 2 + more:
                for to in ("user", "assistant"):
                    walk(i + 1, left - 2 - more, audit + "R", [*written, (to, text)])

        walk(0, limit, "", [])
        if found:
            audit, written = min(found)
            return limit, audit, hashed("\n".join(f"{r}:{t}" for r, t in written))


def plain_repair(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    out = []
    for c, own in by.items():
        own = faulty(own)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == k for *_, f in own) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((c, gaps, *counts, illegal, *search(own)))
    return sorted(out, key=repr)


def test_repair(spark):
    rng = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "ua", "", None]
    texts = ["Yes.", "No!", "cut", "cut", "", " \n", None, "A?\n", "ends. ", "é", "same."]
    rows = [(c, rng.choice([*range(6), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randint(1, 4))]
    rows += rows[:9]
    table = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], TURNS).repartition(5)
    got = conversations.repaired(conversations.damaged(table))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_repair(rows)


def test_layers_of_a_long_conversation_are_a_band(spark):
    # every way to the end is found though only some layers are kept: hundreds of turns against the same search by all costs
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice("suax"), rng.randint(0, 3)) for _ in range(rng.randint(1, 200))]
        layers, best = conversations.END, {1: 0, 2: 4, 4: 2, 8: 0}
        for initial, fault in reversed(turns):
            layers = conversations.back(layers, initial, fault)
            by_row = {}
            for s, cost in best.items():
                ways = [cost + 3]
                if fault not in (conversations.BLANK, conversations.DUPLICATE):
                    more = fault == conversations.CUT
                    to = conversations.NEXT.get(initial, {}).get(s)
                    ways += [best[x] + more for x in [to] if x] + [best[conversations.FOLLOWS[s]] + 2 + more]
                by_row[s] = min(ways)
            for _ in range(2):
                by_row = {s: min(c, by_row[conversations.FOLLOWS[s]] + 2) for s, c in by_row.items()}
            best = by_row
            assert {s: conversations.cost_from(layers, s) for s in best} == best and layers[1][-1] == conversations.ALL
            assert conversations.unpacked(layers[0], conversations.packed(layers)) == layers


def test_repair_of_no_rows_of_rows_that_all_go_and_of_many(spark):
    assert conversations.repaired(conversations.damaged(spark.createDataFrame([], TURNS))).count() == 0
    gone = next((c, 0) for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repaired(conversations.damaged(spark.createDataFrame([(*gone, "user", "Hm.", 0, 0, "")], TURNS))).first()
    assert tuple(got) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashed())
    many = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.', repeat(' ', 200)) AS text")
    began = time.time()
    got = conversations.repaired(many).first()
    want = "\n".join(f"{('user', 'assistant')[i % 2]}:Turn {i}.{' ' * 200}" for i in range(30_000))
    assert (got.cost, got.audit, got.repaired_sha256) == (0, "K" * 30_000, hashed(want)) and time.time() - began < 60


# Pages -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<p>a &amp b &eacute;&#8217;&nbsp;c<br>d\n\te</p>", "a & b é’ c d e"),
        ("<nav><ul><li>Menu</nav><header>Top</header><p>one<p>two<footer>F</footer>", "one\ntwo"),
        ("<article><header><h1>Title</h1></header><p><b>x<p>y<footer>tags</footer></article><p>beside", "Title\nx\ny"),
        ('<div class="post-body">a<div class="cookie-notice">b</div><p class="has-sidebar">c <span class="ad">d</span> e</p></div>', "a\nc e"),
        ('<body class="sidebar"><main class="with-sidebar"><p>a<div id="comments"><article><p>reader</article></div></main><aside>b</aside>', "a"),
        ('<script>if (a<b) "</p>"</script><style>p{}</style><p>x<!-- <p>no --><template>t</template>y<form>f</form>', "x\ny"),
        ("<p title='a>b' it's>x</p><p a=\"open>y</p>", "x\ny"),
        ("<p>1 < 2 <3</p><p>cut <a hre", "1 < 2 <3\ncut"),
        ("<div hidden>a</div><div style='display: none'>b</div><div role=navigation>c</div><p>d", "d"),
        ("<script>never ends <p>x", ""),
        ("<ul><li>a<li class=ad>b<li>c</ul><table><tr><td>d<td>e</table>", "a\nc\nd\ne"),
        ("</p></div>x</article>", "x"),
        ("<p>&am &quo &lt;b&gt;", "&am &quo <b>"),
    ],
)
def test_text_of_a_page(spark, source, want):
    got = pages.lines(source)
    kind = pages.ARTICLE if any(k == pages.ARTICLE for _, k in got) else pages.OPEN
    assert "\n".join(t for t, k in got if k == kind) == want


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 4])
def test_alignment(spark, monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in "ab")
        places = pages.common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[i] in rest for i in places) and len(places) == longest(a, b)


def plain_texts(rows):
    """Texts and the number of lines deleted, each page held against its neighbours by path with the plain alignment's lengths."""
    hosts, out = {}, {}
    for place, (page_id, url, source) in enumerate(rows):
        m = re.match(r"https?://([^/]+)(.*)", url or "")
        found = pages.lines(source or "")
        if m:
            hosts.setdefault(m[1].lower(), []).append((m[2], place, page_id, found))
        out[page_id] = found, 0
    for own in hosts.values():
        own.sort(key=lambda x: x[:2])
        for i, (path, _, page_id, found) in enumerate(own):
            near = [own[j] for j in (i - 1, i + 1) if 0 <= j < len(own)]
            near.sort(key=lambda x: -pages.beginning(path, x[0]))
            for other in near:
                a, b = [t for t, _ in found], [t for t, _ in other[3]]
                places = pages.common(a, b)
                assert len(places) == longest(a, b)
                mine, theirs = ([t for t, k in x if k != pages.MARKED] for x in (found, other[3]))
                shared = sum(len(a[j]) for j in places if found[j][1] != pages.MARKED)
                most = max(sum(map(len, mine)), sum(map(len, theirs)))
                if shared < pages.COPY * most or not most:
                    go = set() if any(k == pages.ARTICLE for _, k in found) else set(places)
                    out[page_id] = [x for j, x in enumerate(found) if j not in go], len(go)
                    break
    texts = {p: "\n".join(t for t, k in found if k == (pages.ARTICLE if any(k == pages.ARTICLE for _, k in found) else pages.OPEN)) for p, (found, _) in out.items()}
    return texts, sum(n for _, n in out.values())


def test_pages_against_their_neighbours(spark):
    rng, rows = random.Random(5), []
    for i in range(700):
        host = rng.choice(["http://big.example", "http://big.example", "https://A.example", "http://b.example"])
        own = [f"page {i} says {j} things" for j in range(rng.randint(0, 4))] + ["all say this"] * rng.randint(0, 1)
        menu = "".join(f"<div>{x}</div>" for x in (host, "Home", "About", rng.choice(["Login", "Imprint"])))
        body = "".join(f"<p>{x}" for x in own)
        wrapped = f"<article>{body}</article>" if i % 5 == 0 else f"<nav>Top</nav>{body}"
        rows.append((i, f"{host}/{rng.choice('abc')}/{i % 40}", f"<body>{menu}{wrapped}<div>All rights reserved</div>"))
    copy = (700, "http://big.example/a/copy", "<p>a long line that both pages have as their only own text, without template<p>end")
    rows += [copy, (701, "http://big.example/a/copy?x", copy[2]), (702, None, "<p>no host"), (703, "http://a.example/", None), (704, "mailto:x", "")]
    table = spark.createDataFrame([(*r, "t", 5, "l", "h") for r in rows], PAGES).coalesce(1)
    got = {r.page_id: r.text for r in pages.main_texts(table).collect()}
    want, deleted = plain_texts(rows)
    assert got == want and deleted > 1000
    assert got[700] == pages.lines(copy[2])[0][0] + "\nend" and got[702] == "no host" and got[703] == got[704] == ""


def test_no_pages_and_very_long_ones(spark):
    assert pages.main_texts(spark.createDataFrame([], PAGES)).count() == 0
    long = "".join(f"<p>line {i} &amp; more</p>" for i in range(60_000))
    odd = "<p a=\"'" * 100_000 + "<b>" * 100_000 + "</i>" * 100_000
    began = time.time()
    rows = [(1, "http://a.b/1", long), (2, "http://a.b/2", long.replace("line 7 ", "row 7 ")), (3, "http://a.b/3", odd), (4, "http://c.d/4", "<div>" * 200_000 + "deep")]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame([(*r, "", 0, "", "") for r in rows], PAGES)).collect()}
    assert got[1] == "\n".join(f"line {i} & more" for i in range(60_000)) and got[4] == "deep" and time.time() - began < 100


def test_pages_of_the_table(spark):
    """The table's pages have one article each, whose blocks are found here by patterns."""
    got = {r.page_id: r for r in QUERIES["op12_html_text"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in blocks]
        want = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
