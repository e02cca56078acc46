"""SQL (DuckDB) for the queries of this subpackage that SQL can express.

op1, op3, op4, op7, op8, op10 and op13 have none: tests hold them against brute force, a round trip or held-out labels.
"""

from __future__ import annotations

from .queries import MIX_SEED, MIX_WEIGHTS, URL_RULES
from .urlfilter import ENTITIES, RAW

_OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
f AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i+7], ' ')) AS n FROM f),
c AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100)) AS fresh FROM g WHERE n > 1),
r AS (SELECT rid, CAST(sum(fresh) AS BIGINT) AS n_repeat_words FROM c GROUP BY 1),
b AS (SELECT doc_id, x, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 10 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 4 * word_chars OR 10 * (length(x) - length(replace(x, '!', ''))) > 5 * n_words OR NOT regexp_matches(x, '\p{L}')) AS kept FROM k
"""


def _host_path(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _rule(what: str, host: str = "host", path: str = "path") -> str:
    cases = ""
    for verdict, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2])):
        cases += f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else verdict}'"
    return f"CASE{cases} END"


def _node(url: str) -> str:
    host, path = _host_path(url)
    query = f"regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^?#]*(\\?[^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN regexp_replace({host}, ':(80|443)$', '') || CASE {path} WHEN '' THEN '/' ELSE {path} END || {query} END"


def _resolved(base: str, ref: str) -> str:
    """The address that ref names on a page at base; null for other schemes and where base is not absolute."""
    site, scheme = f"regexp_extract({base}, '^[^:/?#]+://[^/?#]*')", f"regexp_extract({base}, '^([^:/?#]+):', 1)"
    path, own, tail = f"regexp_extract({base}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)", f"regexp_extract({ref}, '^[^?#]*')", f"regexp_extract({ref}, '(?s)^[^?#]*(.*)$', 1)"
    joined = f"CASE WHEN {own} = '' THEN {path} WHEN starts_with({own}, '/') THEN {own} ELSE regexp_replace({path}, '[^/]*$', '') || {own} END"
    kept = f"list_reduce(list_prepend('', list_filter(string_split({joined}, '/'), lambda x: x <> '')), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/?[^/]*$', '') ELSE a || '/' || x END)"
    dotted = f"CASE {kept} WHEN '' THEN '/' ELSE {kept} || CASE WHEN regexp_matches({joined}, '(^|/)\\.{{0,2}}$') THEN '/' ELSE '' END END"
    within = f"{site} || CASE WHEN regexp_matches({joined}, '(^|/)\\.{{1,2}}(/|$)') THEN {dotted} WHEN regexp_matches({joined}, '^[^/]') THEN '/' || {joined} ELSE {joined} END || {tail}"
    return f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {ref} WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {site} = '' THEN NULL WHEN starts_with({ref}, '//') THEN {scheme} || ':' || {ref} ELSE {within} END"


def _op5() -> str:
    h, p = _host_path("url")
    a, b = _host_path("u")
    in_tag = """(?:[^>"\'\']|"[^"]*"|\'\'[^\'\']*\'\')*>"""
    no_page = "|".join(["<!--.*?(?:-->|\\z)", *(rf"<{x}\b{in_tag}.*?(?:</{x}\b[^>]*>|\z)" for x in RAW)])
    pair = """([^\\s"\'\'<>/=]+)\\s*=\\s*("[^"]*"|\'\'[^\'\']*\'\'|[^\\s"\'\'>]+)"""
    entity = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
    number = "CASE WHEN starts_with(lower(z[2]), '&#x') THEN CAST('0x' || z[2][4:-2] AS BIGINT) ELSE CAST(z[2][3:-2] AS BIGINT) END"
    named = " ".join(f"WHEN z[2] = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ENTITIES.items())
    character = f"CASE WHEN z[2] IS NULL THEN '' {named} WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) ELSE z[2] END"

    def value(name: str) -> str:
        """The first value that the tag gives an attribute, without quotes."""
        found = f"list_filter(list_zip(regexp_extract_all(tag, '{pair}', 1), regexp_extract_all(tag, '{pair}', 2)), lambda x: lower(x[1]) = '{name}')[1][2]"
        return f"CASE WHEN regexp_matches({found}, '^[\"'']') THEN {found}[2:-2] ELSE {found} END AS {name.replace('-', '_')}"

    def decoded(c: str) -> str:
        """What stands between entities, joined with what they stand for."""
        return f"trim(array_to_string(list_transform(list_zip(string_split_regex({c}, '{entity}'), regexp_extract_all({c}, '{entity}')), lambda z: z[1] || {character}), ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12))"

    raw = ", ".join(map(value, ("rel", "href", "http-equiv", "content")))
    told = f"regexp_extract({decoded('content')}, '(?is)^[^;,]*[;,]\\s*url\\s*=\\s*(.*)$', 1)"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce({h}, '') AS host, coalesce({p}, '') AS path, url, html FROM pages),
q AS (SELECT page_id, host, path, {_rule("rule")} AS rule, {_rule("verdict")} AS own, {_node("url")} AS node FROM p),
t AS (SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?is){no_page}', ' ', 'g'), '(?is)<(?:link|meta)\b{in_tag}')) AS tag FROM pages WHERE url IS NOT NULL),
v AS (SELECT src, lower(tag[2:5]) AS kind, {raw} FROM t),
d AS (SELECT src, CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower({decoded("rel")}), '\s+'), 'canonical') THEN {decoded("href")}
   WHEN kind = 'meta' AND lower({decoded("http_equiv")}) = 'refresh' THEN CASE WHEN regexp_matches({told}, '^["'']') THEN regexp_extract({told}, '(?s)^["'']([^"'']*)', 1) ELSE trim({told}) END END AS ref FROM v),
l AS (SELECT * FROM (SELECT src, {_resolved("src", "ref")} AS dst FROM d WHERE ref <> '') WHERE dst IS NOT NULL),
e AS (SELECT {_node("src")} AS u, {_node("dst")} AS v FROM l),
s AS (SELECT u, v FROM e WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM e WHERE u IS NOT NULL AND v IS NOT NULL),
reach AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, reach.root FROM reach JOIN s ON s.u = reach.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
named AS (SELECT DISTINCT u FROM (SELECT src AS u FROM l UNION ALL SELECT dst FROM l)),
known AS (SELECT node, own FROM q WHERE node IS NOT NULL UNION ALL SELECT node, {_rule("verdict")} FROM (SELECT {_node("u")} AS node, {a} AS host, {b} AS path FROM named) WHERE node IS NOT NULL),
verdicts AS (SELECT coalesce(component, known.node) AS c, coalesce(bool_or(own = 'block'), false) AND NOT coalesce(bool_or(own = 'allow'), false) AS blocked FROM known LEFT JOIN comp USING (node) GROUP BY 1)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN comp USING (node) LEFT JOIN verdicts ON c = coalesce(component, q.node)
"""


def _op6() -> str:
    values = ", ".join(f"({'NULL' if k == '*' else repr(k)}, {w!r}, {i})" for i, (k, w) in enumerate(MIX_WEIGHTS.items()))
    named = ", ".join(repr(k) for k in MIX_WEIGHTS if k != "*")
    return f"""
WITH RECURSIVE w AS (SELECT CAST(g AS VARCHAR) AS g, CAST(wt AS DOUBLE) AS wt, o FROM (VALUES {values}) t(g, wt, o)),
d AS (SELECT *, CASE WHEN source IN ({named}) THEN source END AS g FROM documents),
n AS (SELECT g, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT w.g, (SELECT CAST(sum(n) AS DOUBLE) FROM n) * (wt / sum(wt) OVER ()) / n AS rate FROM w JOIN n ON n.g IS NOT DISTINCT FROM w.g),
c AS (SELECT g, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM r UNION ALL SELECT g, rate, k + 1, p * (rate / (k + 1)), total + p * (rate / (k + 1)) FROM c WHERE k < 60),
u AS (SELECT *, CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS x, row_number() OVER () AS rid FROM d),
m AS (SELECT rid, count(*) AS copies FROM u JOIN c ON c.g IS NOT DISTINCT FROM u.g AND c.total <= u.x GROUP BY 1)
SELECT doc_id, unnest(range(1, copies + 1)) AS copy, source, lang, text FROM u JOIN m USING (rid)
"""


_OP9 = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a string of ASCII characters."""
    bits = "list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT)), lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _op11() -> str:
    """The cheapest repair by states: e nothing yet, s after the system, u after a user, a after an assistant; k is cost and audit, t the repaired rows."""
    letters = {"u": "user", "a": "assistant"}

    def then(state: str, cost: str, letter: str, said: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad(CAST(CAST({state}.k[1:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || {state}.k[9:] || '{letter}', 't': {state}.t || {said}}} END"

    def taken(state: str, to: str) -> str:
        keep, change = then(state, "extra", "K", "chr(10) || role || ':' || text"), then(state, "(3 + extra)", "R", f"chr(10) || '{letters.get(to)}:' || text")
        return f"CASE WHEN fault IN (1, 2) THEN NULL WHEN starts_with(role, '{to}') THEN {keep} " + (f"ELSE {change} END" if to in letters else "END")

    insert = lambda state, to: then(state, "3", "I", f"chr(10) || '{letters[to]}:'")
    closed = lambda src: f"""SELECT conv_id, i, e, s, u, least(a, {insert("u", "a")}) AS a FROM (SELECT conv_id, i, e, s, least(u, {insert("e", "u")}, {insert("s", "u")}, {insert("a", "u")}) AS u, a FROM ({src}))"""
    none = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR))"
    start = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '00000000', 't': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM conversations"
    scan = f"""SELECT w.conv_id, w.i + 1 AS i, {then("e", "4", "D")} AS e, least({then("s", "4", "D")}, {taken("e", "s")}) AS s,
  least({then("u", "4", "D")}, {taken("e", "u")}, {taken("s", "u")}, {taken("a", "u")}) AS u, least({then("a", "4", "D")}, {taken("u", "a")}) AS a
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1"""
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, {_crc32("name")} % 20 AS how FROM c),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
f AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM (SELECT *, CASE WHEN said = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n)),
w AS ({closed(start)} UNION ALL {closed(scan)}),
g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, least(e, a) AS best
  FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id WHERE i = coalesce(rows, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.k[1:8] AS BIGINT) AS cost, best.k[9:] AS audit, sha256(substr(best.t, 2)) AS repaired_sha256 FROM r
"""


def _op12() -> str:
    """Levels by grouping three by three; a leaf's path is its run's others at each level."""

    def field(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, leaves: str) -> str:
        """Nodes, the others of each node's run, and the last node by tree; leaves: tree, i from 0, n, value."""
        run, others = "PARTITION BY level, tree, i // 3 ORDER BY i", "coalesce(string_agg(value, '') OVER ({run} ROWS BETWEEN {a} AND {b}), '')"
        left, right = others.format(run=run, a="UNBOUNDED PRECEDING", b="1 PRECEDING"), others.format(run=run, a="1 FOLLOWING", b="UNBOUNDED FOLLOWING")
        return f"""{name} AS (SELECT 0 AS level, tree, i, n, value FROM {leaves} UNION ALL SELECT level + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(value, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, tree, i // 3, n),
{name}_links AS (SELECT level, tree, i, {left} AS l, {right} AS r FROM {name} WHERE n > 1),
{name}_roots AS (SELECT tree, value FROM {name} WHERE n = 1),
{name}_paths AS (SELECT x.tree, x.i, list(l || ':' || r ORDER BY level) AS path FROM {leaves} x JOIN {name}_links k ON k.tree IS NOT DISTINCT FROM x.tree AND k.i = x.i // CAST(pow(3, level) AS BIGINT) GROUP BY x.tree, x.i)"""

    return f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, doc_id, source, {leaf("text")} AS value, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AND text IS NOT NULL THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed FROM documents),
leaves AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, value) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, value, doc_id, changed FROM rows),
{tree("low", "leaves")},
tops AS (SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, value FROM low_roots),
{tree("high", "tops")},
whole AS (SELECT doc_id, v.value AS leaf, s.value AS subroot, changed, coalesce(p.path, []) || coalesce(q.path, []) AS path FROM leaves v JOIN tops s ON s.source IS NOT DISTINCT FROM v.tree
  LEFT JOIN low_paths p ON p.tree IS NOT DISTINCT FROM v.tree AND p.i = v.i LEFT JOIN high_paths q ON q.i = s.i)
SELECT doc_id, leaf, subroot, value AS root, sha256(replace(array_to_string(path, ''), ':', '')) AS proof_sha256, list_reduce(list_prepend(changed, path), lambda v, x: sha256(split_part(x, ':', 1) || v || split_part(x, ':', 2))) AS folded_root, folded_root = root AS verified
FROM whole, high_roots
"""


SQL: dict[str, str] = {"op2_quality_rules": _OP2, "op5_url_filters": _op5(), "op6_mixing": _op6(), "op9_chat": _OP9, "op11_conversation_repair": _op11(), "op12_merkle_manifest": _op12()}
