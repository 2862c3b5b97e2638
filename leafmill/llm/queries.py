"""The operators' queries: each over its whole tables, with the parameters that production uses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontam, line_dedup, lm_bloom, merkle, mixing, pages, pairwise_quality, pii, quality_rules, simhash, token_counts, token_pack
from .common import read

PIECES, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op4_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_bloom.score(docs, lm_bloom.held_out(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(read(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_pii, op4_lm_bloom, op5_mixing, op6_pairwise_quality, op7_token_pack, op8_line_dedup, op9_decontam, op10_token_counts, op11_merkle, op12_html_text, op13_conversation_repair)}

# Words of a text in DuckDB: blank-separated, and of letters, digits and all beyond ASCII.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_B = r"[\x20\x09-\x0D]"
_RULES = quality_rules.RULES


def _per_rule(form: str, between: str = ", ") -> str:
    return between.join(form.format(r=r) for r in _RULES)


def _tail(p: float) -> str:
    """P(X <= k) of n trials, as the sum of its terms; 1 beyond the expected number."""
    return f"CASE WHEN k > n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END"


_MEASURED = rf"""
        texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
        parts AS (
            SELECT rid, doc_id, lang, text, list_filter(string_split_regex(text, '{_B}+'), lambda x: x <> '') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
        windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM parts, unnest(range(1, len(w) - 1)) AS r(i)),
        again AS (SELECT rid, gram FROM windows GROUP BY ALL HAVING count(*) > 1),
        covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM windows JOIN again USING (rid, gram), unnest(range(0, 3)) AS r(j) GROUP BY rid),
        counted AS (
            SELECT p.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_B}+', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines
            FROM parts AS p LEFT JOIN covered AS c USING (rid)),
        measured AS (
            SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0) AS upper_ratio,
                coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio
            FROM counted)"""
_CUTOFFS = f"""
        good AS (
            SELECT m.*, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % 3 AS fold
            FROM measured AS m JOIN labels AS b USING (doc_id) WHERE NOT base_failed AND b.quality = 1),
        grid AS (SELECT c::DOUBLE AS cutoff FROM unnest({list(quality_rules.CUTOFFS)}) AS t(c)),
        multiples AS (SELECT c::DOUBLE AS cutoff FROM unnest({list(quality_rules.MULTIPLES)}) AS t(c)),
        tuned AS (
            SELECT lang, r.rule, cutoff, count(*) AS n, count(*) FILTER (WHERE r.value > cutoff) AS k
            FROM (SELECT lang, unnest([{_per_rule("{{'rule': '{r}', 'value': {r}}}")}]) AS r FROM good WHERE fold = 0), grid GROUP BY ALL),
        best AS (SELECT lang, rule, coalesce(min(cutoff) FILTER (WHERE k <= n * {quality_rules.RISK / 2}), {quality_rules.CUTOFFS[0]}::DOUBLE) AS cutoff FROM tuned GROUP BY ALL),
        scales AS (SELECT lang, {_per_rule("max(cutoff) FILTER (WHERE rule = '{r}') AS {r}_scale")} FROM best GROUP BY lang),
        held AS (
            SELECT g.*, greatest({_per_rule("g.{r} / s.{r}_scale")}) AS together
            FROM good AS g LEFT JOIN scales AS s ON g.lang IS NOT DISTINCT FROM s.lang WHERE fold = 1),
        tested AS (
            SELECT lang, r.rule, cutoff, count(*) AS n, count(*) FILTER (WHERE r.value > cutoff) AS k
            FROM (SELECT lang, unnest([{_per_rule("{{'rule': '{r}', 'value': {r}}}")}]) AS r FROM held), grid GROUP BY ALL
            UNION ALL
            SELECT lang, 'together', cutoff, count(*), count(*) FILTER (WHERE together > cutoff OR together IS NULL) FROM held, multiples GROUP BY ALL),
        proofs AS (
            SELECT *, CASE WHEN rule = 'together' THEN {_tail(quality_rules.RISK)} <= level
                ELSE {_tail(quality_rules.RISK / len(_RULES))} <= level / {len(_RULES)} END AS valid
            FROM tested, (SELECT {quality_rules.DELTA / 2} / count(DISTINCT coalesce(lang, chr(0)))::DOUBLE AS level FROM held)),
        reached AS (SELECT *, bool_and(valid) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS proved FROM proofs),
        proved AS (SELECT lang, {_per_rule("min(cutoff) FILTER (WHERE rule = '{r}' AND proved) AS {r}_own")}, min(cutoff) FILTER (WHERE rule = 'together' AND proved) AS together FROM reached GROUP BY lang),
        cutoffs AS (
            SELECT p.lang, {_per_rule("CASE WHEN together IS NULL OR (" + _per_rule("{r}_own IS NOT NULL", " AND ") + ") THEN {r}_own ELSE together * {r}_scale END AS {r}_cutoff")}
            FROM proved AS p LEFT JOIN scales AS s ON p.lang IS NOT DISTINCT FROM s.lang)"""

_MIXED = rf"""
        WITH RECURSIVE sizes AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_B}+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sizes GROUP BY source),
        -- shares of what is left among those below their limit, until none is above
        shares(round, source, source_size, weight, target, done) AS (
            SELECT 0, source, source_size, weight, 0::DOUBLE, false FROM sources
            UNION ALL
            SELECT round + 1, source, source_size, weight, CASE WHEN done OR share > 2.0 * source_size THEN 2.0 * source_size ELSE share END::DOUBLE, done OR share > 2.0 * source_size
            FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (WHERE done) OVER (), 0)) * weight / nullif(sum(weight) FILTER (WHERE NOT done) OVER (), 0) AS share
                  FROM shares WHERE round < (SELECT count(*) FROM sources))),
        targets AS (SELECT source, source_size, target FROM shares WHERE round = (SELECT count(*) FROM sources)),
        weighed AS (
            SELECT doc_id, source, size, source_size, target, length(bin(size))::DOUBLE AS w,
                (('0x' || substr(md5('pareto order ' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
            FROM sizes JOIN targets USING (source)),
        levels AS (SELECT source, target, w, sum(size) AS words FROM weighed GROUP BY ALL),
        -- expected copies are min(2, unit * w); the highest weights are at 2
        units AS (
            SELECT source, w, (target - 2.0 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(words * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM levels),
        unit AS (SELECT source, arg_max(unit, w) FILTER (WHERE unit * w <= 2) AS unit FROM units GROUP BY source),
        expected AS (SELECT x.*, CASE WHEN size = 0 THEN 0 ELSE least(2.0, coalesce(unit * w, 2.0)) END::DOUBLE AS e FROM weighed AS x JOIN unit USING (source)),
        ranked AS (SELECT *, floor(e) AS sure, CASE WHEN e > floor(e) THEN ln(u) - ln(1 - u) + ln(1 - (e - floor(e))) - ln(e - floor(e)) END AS rank FROM expected),
        goals AS (SELECT source, any_value(target) - sum(sure * size) AS goal FROM ranked GROUP BY source),
        ends AS (SELECT source, rank, sum(words) OVER (PARTITION BY source ORDER BY rank) AS upto FROM (SELECT source, rank, sum(size) AS words FROM ranked WHERE rank IS NOT NULL GROUP BY ALL)),
        -- of all places to end, the nearest to the goal; none at all is one
        cuts AS (
            SELECT source, arg_min(rank, (abs(upto - goal), -upto)) AS cut
            FROM (SELECT source, rank, upto FROM ends UNION ALL SELECT source, -1e9, 0 FROM sources) JOIN goals USING (source) GROUP BY source)
        SELECT r.doc_id, r.source, r.size, r.source_size, r.target, (sure + coalesce((rank <= cut)::INT, 0))::BIGINT AS copies, ((sure + coalesce((rank <= cut)::INT, 0)) * size)::BIGINT AS taken
        FROM ranked AS r JOIN cuts AS c USING (source)"""

_LINES_LEFT = rf"""
        WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        every AS (SELECT doc_id, pos - 1 AS pos, parts[pos] AS line FROM texts, unnest(range(1, len(parts) + 1)) AS r(pos)),
        lines AS (SELECT * FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        firsts AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM lines GROUP BY line),
        -- a line without the character at place i, for partners of m characters at most; or cut there, for those with one more
        variants AS (
            SELECT line, first, n = m AS whole, m, i, left(line, i) || chr(0) || substr(line, CASE WHEN n = m THEN i + 2 ELSE i + 1 END) AS rest
            FROM (SELECT *, n AS m FROM firsts UNION ALL SELECT *, n + 1 FROM firsts), unnest(range(0, m)) AS r(i) WHERE m >= {line_dedup.MIN_CHARS}),
        keys AS (SELECT m, i, rest, min(first) AS any_first, min(first) FILTER (whole) AS whole_first FROM variants GROUP BY ALL),
        near AS (
            SELECT line, min(CASE WHEN whole THEN any_first ELSE whole_first END) AS partner
            FROM variants JOIN keys USING (m, i, rest) WHERE CASE WHEN whole THEN any_first ELSE whole_first END < first GROUP BY line),
        dropped AS (
            SELECT doc_id, pos, partner IS NOT NULL AS near
            FROM lines JOIN firsts USING (line) LEFT JOIN near USING (line) WHERE least(first, coalesce(partner, first)) < (doc_id, pos)),
        by_doc AS (SELECT doc_id, count(*) AS n, count(*) FILTER (near) AS n_near, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM dropped GROUP BY doc_id)
        SELECT t.doc_id, coalesce(len(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_lines,
            coalesce(n, 0)::BIGINT AS n_dropped, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(places, '') AS dropped
        FROM texts AS t LEFT JOIN by_doc USING (doc_id)"""



def crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters: the bits of one byte after the other."""
    byte = "list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"


_FIELD = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"


def _levels(name: str, first: str, group: str) -> str:
    """A recursive table of all levels of the groups' trees: nodes is a level's list of digests."""
    return f"""{name} AS (
            {first} UNION ALL
            SELECT {group}, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))
            FROM {name} WHERE len(nodes) > 1)"""


_RUN = "nodes[place // (8 ** level)::BIGINT // 8 * 8 + {a}:{b}]"
_BESIDE = f"""array_to_string({_RUN.format(a=1, b="place // (8 ** level)::BIGINT")}, '') AS before,
            array_to_string(nodes[place // (8 ** level)::BIGINT + 2:place // (8 ** level)::BIGINT // 8 * 8 + 8], '') AS after"""
_MERKLE = f"""
        WITH RECURSIVE rows AS (
            SELECT doc_id, lang, {_LEAF.format(c="text")} AS leaf,
                CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {_LEAF.format(c="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown
            FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows),
        {_levels("levels", "SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang", "lang")},
        subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
        {_levels("tops", "SELECT 0 AS one, 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots", "one")},
        depths AS (SELECT lang, max(level) AS depth FROM levels GROUP BY lang),
        steps AS (
            SELECT p.doc_id, p.leaf, level, {_BESIDE} FROM placed AS p JOIN levels AS v ON p.lang IS NOT DISTINCT FROM v.lang WHERE len(nodes) > 1
            UNION ALL
            SELECT p.doc_id, p.leaf, s.level + depth, before, after
            FROM placed AS p JOIN (SELECT s.lang, level, {_BESIDE} FROM subroots AS s, tops WHERE len(nodes) > 1) AS s ON p.lang IS NOT DISTINCT FROM s.lang
            JOIN depths AS d ON p.lang IS NOT DISTINCT FROM d.lang),
        folds AS (
            SELECT doc_id, leaf, 0 AS level, coalesce(shown, leaf) AS node FROM placed
            UNION ALL
            SELECT f.doc_id, f.leaf, f.level + 1, sha256(before || node || after)
            FROM folds AS f JOIN steps AS s ON f.doc_id IS NOT DISTINCT FROM s.doc_id AND f.leaf = s.leaf AND f.level = s.level),
        proofs AS (SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY ALL),
        ends AS (SELECT doc_id, leaf, arg_max(node, level) AS folded_root FROM folds GROUP BY ALL)
        SELECT p.doc_id, p.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed AS p JOIN subroots AS s ON p.lang IS NOT DISTINCT FROM s.lang, (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
        LEFT JOIN proofs AS f ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.leaf = f.leaf
        JOIN ends AS e ON p.doc_id IS NOT DISTINCT FROM e.doc_id AND p.leaf = e.leaf"""


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(cost: str, letter: str, state: int, when: str = "") -> str:
    struct = f"{{'c': f[{state}].c + {cost}, 'a': '{letter}' || f[{state}].a}}"
    return f"CASE WHEN {when} THEN {struct} END" if when else struct


_KEEP = "fault IN ('', 't') AND r = '{}'"
#: Of each state (start, after system, user, assistant) the cheapest rest: by deleting, keeping or giving the row a role, then by inserting.
_BY_ROW = ", ".join(
    _least(_edit("3", "D", state), *[_edit("m", "K", to, _KEEP.format(r)) for r, to in kept], _edit("2 + m", "R", follows, "fault IN ('', 't')"))
    for state, kept, follows in ((1, (("s", 2), ("u", 3)), 3), (2, (("u", 3),), 3), (3, (("a", 4),), 4), (4, (("u", 3),), 3)))
_BY_INSERT = ", ".join(
    _least(f"f[{state}]", *[_edit(str(2 * n), "I" * n, to) for n, to in more])
    for state, more in ((1, ((1, 3), (2, 4))), (2, ((1, 3), (2, 4))), (3, ((1, 4),)), (4, ((1, 3),))))
_REPAIR = rf"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
        after AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM src, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE kind <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, substr(role, 1, 1) AS r FROM after),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM numbered),
        faulty AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
                lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ordered),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
        walk(conv_id, i, f) AS (
            SELECT conv_id, n + 1, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM counts
            UNION ALL
            SELECT conv_id, i, [{_BY_INSERT}] FROM (
                SELECT conv_id, i, [{_BY_ROW}] AS f FROM (
                    SELECT w.conv_id, o.i, f, fault, r, (fault = 't')::BIGINT AS m FROM walk AS w JOIN faulty AS o ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = w.i - 1))),
        best AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit FROM walk WHERE i = 1),
        letters AS (
            SELECT conv_id, p, audit[p] AS letter, len(replace(left(audit, p), 'I', '')) AS i, len(replace(left(audit, p), 'D', '')) AS o
            FROM best, unnest(range(1, len(audit) + 1)) AS t(p)),
        written AS (
            SELECT x.conv_id, p, o, letter, role, text, max(CASE WHEN o = 1 AND letter = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS has_s
            FROM letters AS x LEFT JOIN faulty AS y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i AND letter <> 'I' WHERE letter <> 'D'),
        texts AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole
            FROM written GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN counts AS n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
        LEFT JOIN best AS b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts AS t ON c.conv_id IS NOT DISTINCT FROM t.conv_id"""

SQL = {
    "op13_conversation_repair": _REPAIR,
    "op11_merkle": _MERKLE,
    "op5_mixing": _MIXED,
    "op8_line_dedup": _LINES_LEFT,
    "op1_quality_rules": f"""
        WITH {_MEASURED}, {_CUTOFFS}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce({_per_rule("{r} > {r}_cutoff", ", false) AND NOT coalesce(")}, false) AS kept
        FROM measured AS m LEFT JOIN cutoffs AS c ON m.lang IS NOT DISTINCT FROM c.lang""",
    "op9_decontam": f"""
        WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS n
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
        docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        grams AS (
            SELECT doc_id, k.n, i, array_to_string(w[i:i + k.n - 1], ' ') AS gram
            FROM docs, (SELECT DISTINCT n FROM windows) AS k, unnest(range(1, len(w) - k.n + 2)) AS r(i)),
        hits AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams AS g JOIN windows AS v ON g.gram = v.gram AND g.n = v.n),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS r(j) GROUP BY doc_id),
        items_of AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs AS d LEFT JOIN covered USING (doc_id) LEFT JOIN items_of USING (doc_id)""",
}
