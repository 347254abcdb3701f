"""DuckDB SQL for the operators whose results SQL can state.

Written from the contracts, not from the Spark plans: all windows against all
windows, all pairs that share a shingle, matches by splitting at them.
"""

from __future__ import annotations

import string

FOLD = f"translate({{x}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
TERM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str, fold: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({FOLD.format(x=text) if fold else text}, '{pattern}')"


OP1 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_words('text', SPACE_WORD, True)} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM pos),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

OP8 = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_words('text', SPACE_WORD, False)} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM pos),
first AS (SELECT win, min(doc_id) AS f FROM win GROUP BY win),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (win) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)"""

OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', TERM_WORD, True)} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_words('text', TERM_WORD, True)} AS w FROM benchmark) WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT k FROM g),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM pos),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, i, k, item_id FROM win JOIN g USING (k, gram)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN item USING (doc_id)"""


# (kind, pattern, group of the value, least length); a run of n or more characters starts where its maximal run does.
SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def _op6() -> str:
    parts = []
    for no, (kind, pattern, group, least) in enumerate(SECRETS):
        rx = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, source, {no} AS no, '{kind}' AS kind, {least} AS least,
  unnest(range(1, len(hits) + 1)) AS i, string_split_regex(t, {rx}) AS gaps, hits, regexp_extract_all(t, {rx}, {group}) AS vals
FROM (SELECT doc_id, source, t, regexp_extract_all(t, {rx}) AS hits FROM t)""")
    base = "no < 3"
    span = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
hit AS ({' UNION ALL '.join(parts)}),
found AS MATERIALIZED (SELECT doc_id, source, no, kind, vals[i] AS val, CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i], '')) AS BIGINT) AS e,
  CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i], '')) - length(hits[i]) AS BIGINT) AS s
  FROM hit WHERE length(vals[i]) >= least),
own AS (SELECT val, count(DISTINCT struct_pack(s := source)) AS n_owners, count(DISTINCT struct_pack(s := source, d := doc_id)) AS n_repositories FROM found GROUP BY val),
per AS (SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  count(*) FILTER (WHERE NOT {base}) AS n_added, count(*) FILTER (WHERE n_owners < 3) AS n_live, count(*) FILTER (WHERE n_owners >= 3) AS n_example,
  max(n_owners) AS max_owners, max(n_repositories) AS max_repositories,
  string_agg({span}, ',' ORDER BY s, no) FILTER (WHERE {base}) AS base, string_agg({span}, ',' ORDER BY s, no) AS spans
  FROM found JOIN own USING (val) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories
FROM t LEFT JOIN per USING (doc_id)"""


# The stop words of the operator's table, written out.
STOPS = ("a al als and are as at au auf avec be by con dans das de del dem den der des die du ein eine el en es est et for from have im in is ist it la las le les lo los "
         "mit nicht no of on par para pas por pour que qui se sich su sur that the this to un una und une von was with y zu").split()
OP13 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_words('text', SPACE_WORD, False)} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM pos),
twice AS (SELECT doc_id, win FROM win GROUP BY doc_id, win HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, win)) GROUP BY doc_id),
line AS (SELECT doc_id, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS y FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (WHERE regexp_matches(y, '^[-*•‣●▪]')) AS bullet,
  count(*) FILTER (WHERE y LIKE '%...' OR y LIKE '%…') AS cut FROM line WHERE y <> '' GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  len(list_filter(regexp_extract_all({FOLD.format(x='t')}, '\p{{L}}+'), lambda x: x IN ({", ".join(f"'{w}'" for w in STOPS)}))) AS n_stop_words,
  coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.bullet, 0) AS n_bullet_lines, coalesce(l.cut, 0) AS n_cut_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN rep r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', CASE WHEN n_words < 50 THEN 'few_words' END,
  CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END, CASE WHEN n_words > 100000 THEN 'many_words' END, CASE WHEN word_chars < 3 * n_words THEN 'short_words' END,
  CASE WHEN word_chars > 10 * n_words THEN 'long_words' END, CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END, CASE WHEN 100 * n_letter_words < 80 * n_words THEN 'few_letters' END,
  CASE WHEN 100 * n_stop_words < 6 * n_words THEN 'few_stop_words' END, CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 'repeated_lines' END,
  CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullet_lines' END, CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 'cut_lines' END) AS failed FROM m)
SELECT *, failed = '' AS kept FROM f"""

# CRC-32 of a number's decimal text, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
OP12 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
own AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY i) AS l FROM t GROUP BY conv_id),
c AS (SELECT conv_id, l, {CRC.format(x='conv_id')} % 6 AS h FROM own),
re AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS p FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM re)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
own_sum AS (SELECT node.p, node.d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * length(node.p[node.d].t) END AS saved FROM node LEFT JOIN kid ON kid.p = node.p),
tree AS (SELECT p[1:k] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS k FROM own_sum) GROUP BY 1)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN tree ON tree.p = node.p LEFT JOIN kid ON kid.p = node.p LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]"""

ORACLE_SQL = {"op1_minhash_dedup": OP1, "op6_secret_scans": _op6(), "op8_substring_dedup": OP8, "op9_decontamination": OP9, "op12_conversation_trie": OP12, "op13_quality_rules": OP13}
