"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each query is built from named CTE fragments over the driver's views
(``orders``, ``customer``, ``nation``, ``conversations`` ...).  Rule tables
come from ``tixflow.config`` so both sides read the same values; the logic
is written out again in SQL, not generated from the Spark plans.
"""

from __future__ import annotations

from tixflow.config import (CATEGORY_KEYWORDS, CLASSIFIER_MIN_LABELED,
                            CLASSIFIER_MIN_SIMILARITY, MTTR_SLA_HOURS,
                            OPEN_STATES, PRIORITY_MAP, STATE_MAP, STOP_WORDS,
                            TFIDF_MAX_FEATURES)
from tixflow.plans.fixtures import AS_OF, TEMPLATES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def case_map(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


STRIP = "regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', ' ', 'g'), "
            f"' +', ' ', 'g'))")


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\pL+|[^\\pL]+)'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def tokens_clean(x: str, stop: bool = True) -> str:
    toks = f"list_filter(string_split({clean(x)}, ' '), lambda w: length(w) >= 2)"
    if stop:
        toks = f"list_filter({toks}, lambda w: NOT list_contains({sql_list(STOP_WORDS)}, w))"
    return toks


def tokens_unicode(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\pL\\pN_]{{2,}}')"


def ngrams(toks: str) -> str:
    # Neighbours are zipped outside any lambda: inside one the token list would be computed per token.
    return (f"list_concat({toks}, list_transform(list_zip(({toks})[1:len({toks}) - 1], ({toks})[2:len({toks})]), "
            f"lambda p: p[1] || ' ' || p[2]))")


HOURS = "(date_diff('microsecond', {a}, {b}) / 3600000000.0)"


def hours(a: str, b: str) -> str:
    return HOURS.format(a=a, b=b)


class Sql:
    """Ordered set of CTEs plus a final SELECT."""

    def __init__(self):
        self.ctes: dict[str, str] = {}
        self.recursive = False

    def add(self, name: str, body: str) -> "Sql":
        if name not in self.ctes:
            self.ctes[name] = body
        return self

    def select(self, final: str) -> str:
        # Text tables that several later tables read are computed once.
        once = ("_toks", "_terms", "_tf", "_vocab", "_w", "_mem", "_vec", "_vw", "_pairs", "_core")
        withs = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith(once) else ''}(\n{b}\n)" for n, b in self.ctes.items())
        rec = "RECURSIVE " if self.recursive else ""
        return f"WITH {rec}{withs}\n{final}"


# ---------------------------------------------------------------------------
# Fixtures
# ---------------------------------------------------------------------------

def templates_values() -> str:
    rows = ", ".join(f"({tid}, {q(s)}, {q(c)}, {q(f)}, {q(k)})" for tid, s, c, f, k in TEMPLATES)
    return f"(VALUES {rows}) AS tpl(tid, short, cat, fix, cause)"


def tk_raw_sql(variant: str = "base") -> str:
    number = "concat('INC', lpad(CAST(o.o_orderkey AS VARCHAR), 8, '0'))"
    body = f"""SELECT {number} AS number,
       concat(CASE o.o_orderkey % 5 WHEN 0 THEN 'URGENT: ' ELSE '' END, tpl.short,
              CASE o.o_orderkey % 3 WHEN 0 THEN ' - raised by service desk'
                                    WHEN 1 THEN ' (seen in monitoring)' ELSE '' END) AS short_description,
       concat('Customer in ', n.n_name, ' reports ', tpl.short) AS description,
       tpl.cat AS category,
       o.o_orderpriority AS priority_raw,
       substr(o.o_orderpriority, 1, 1) AS priority,
       CASE o.o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN ' New ' ELSE 'wip' END AS state,
       o.o_orderdate AS opened_at,
       CASE WHEN o.o_orderstatus = 'F'
            THEN o.o_orderdate + (o.o_orderkey * 37 % 101) * INTERVAL '1' HOUR END AS resolved_at,
       n.n_name AS assignment_group,
       c.c_mktsegment AS business_service,
       concat('ci-', CAST(o.o_custkey % 10 AS VARCHAR)) AS cmdb_ci,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 10 < 7 THEN tpl.fix ELSE '' END AS close_notes,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 < 4 THEN tpl.cause ELSE '' END AS root_cause,
       CAST(NULL AS VARCHAR) AS record_type,
       o.o_orderkey AS ingest_ord
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN {templates_values()} ON tpl.tid = o.o_orderkey % 12"""
    if variant == "base":
        return body
    if variant == "dup":
        return (f"SELECT * FROM ({body}) b UNION ALL "
                f"SELECT * REPLACE ('closed' AS state, ingest_ord + {1 << 40} AS ingest_ord) "
                f"FROM ({body}) b2 WHERE b2.state = 'resolved'")
    if variant == "prefix":
        return (f"SELECT * REPLACE (concat(CASE ingest_ord % 4 WHEN 1 THEN 'CHG' WHEN 2 THEN 'PRB' "
                f"WHEN 3 THEN 'REQ' ELSE 'INC' END, substr(number, 4)) AS number, '' AS record_type) "
                f"FROM ({body}) b")
    raise ValueError(variant)


def normalized_sql(src: str, as_of: str = AS_OF, record_type_present: bool = False) -> str:
    prio_key = f"lower({strip('priority')})"
    state_key = f"lower({strip('state')})"
    state = case_map(state_key, STATE_MAP, f"CASE WHEN {state_key} = '' THEN 'Unknown' ELSE {title(state_key)} END")
    rt = strip("record_type")
    record_type = (f"CASE WHEN {rt} <> '' THEN {rt} WHEN starts_with(number, 'INC') THEN 'Incident' "
                   f"WHEN starts_with(number, 'CHG') THEN 'Change' WHEN starts_with(number, 'PRB') THEN 'Problem' "
                   f"ELSE 'Incident' END")
    resolution = "coalesce(resolved_at, CAST(NULL AS TIMESTAMP))"
    mttr = hours("opened_at", resolution)
    return f"""SELECT number,
       {strip('short_description')} AS short_description,
       {strip('description')} AS description,
       category, '' AS subcategory,
       {case_map(prio_key, PRIORITY_MAP, "'Unknown'")} AS priority,
       'Unknown' AS impact, 'Unknown' AS urgency,
       {state} AS state,
       'Unassigned' AS assigned_to,
       assignment_group,
       opened_at, resolved_at, CAST(NULL AS TIMESTAMP) AS closed_at,
       cmdb_ci, business_service,
       {strip('close_notes')} AS close_notes,
       {strip('root_cause')} AS root_cause,
       {record_type} AS record_type,
       '' AS type, '' AS caller,
       {strip("concat_ws(' ', " + strip('short_description') + ', ' + strip('description') + ')')} AS full_text,
       CASE WHEN {mttr} > 0 THEN {mttr} END AS mttr_hours,
       {hours('opened_at', f"TIMESTAMP '{as_of}'")} AS age_hours,
       priority_raw, ingest_ord
FROM {src}"""


def dedupe_sql(src: str) -> str:
    return (f"SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY number ORDER BY ingest_ord DESC) AS _rn FROM {src}) WHERE _rn = 1")


def tickets(s: Sql, variant: str = "base") -> str:
    """Register raw -> normalised -> deduped tickets; returns the CTE name."""
    raw = {"base": "tk_raw", "dup": "tk_dup_raw", "prefix": "tk_prefix_raw"}[variant]
    norm = {"base": "tk_norm", "dup": "tk_dup_norm", "prefix": "tk_prefix_norm"}[variant]
    out = {"base": "tk", "dup": "tk_dup", "prefix": "tk_prefix"}[variant]
    s.add(raw, tk_raw_sql(variant))
    s.add(norm, normalized_sql(raw))
    s.add(out, dedupe_sql(norm))
    return out


# ---------------------------------------------------------------------------
# Text features
# ---------------------------------------------------------------------------

def tfidf_ctes(s: Sql, prefix: str, docs: str, id_cols: list[str], toks_expr: str,
               max_features: int | None, min_df: int, sublinear: bool = True) -> None:
    """Registers {prefix}_tf, {prefix}_vocab, {prefix}_w (id..., term, w)."""
    ids = ", ".join(id_cols)
    s.add(f"{prefix}_toks", f"SELECT {ids}, {toks_expr} AS toks FROM {docs}")
    s.add(f"{prefix}_terms", f"SELECT {ids}, {ngrams('toks')} AS terms FROM {prefix}_toks")
    s.add(f"{prefix}_tf", f"SELECT {ids}, term, count(*) AS tf FROM "
                          f"(SELECT {ids}, unnest(terms) AS term FROM {prefix}_terms) GROUP BY ALL")
    s.add(f"{prefix}_n", f"SELECT count(*) AS n_docs FROM {docs}")
    limit = f"ORDER BY total DESC, term ASC LIMIT {max_features}" if max_features else ""
    s.add(f"{prefix}_vstats", f"SELECT term, sum(tf) AS total, count(*) AS df FROM {prefix}_tf "
                              f"GROUP BY term HAVING count(*) >= {min_df} {limit}")
    s.add(f"{prefix}_vocab", f"SELECT term, total, df, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf "
                             f"FROM {prefix}_vstats, {prefix}_n")
    tfw = "(1.0 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    s.add(f"{prefix}_w0", f"SELECT {ids}, term, {tfw} * idf AS w0 FROM {prefix}_tf JOIN {prefix}_vocab USING (term)")
    s.add(f"{prefix}_w", f"SELECT {ids}, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {ids})) AS w "
                         f"FROM {prefix}_w0")


def transform_ctes(s: Sql, prefix: str, vocab: str, docs: str, id_cols: list[str], toks_expr: str,
                   sublinear: bool = True) -> None:
    ids = ", ".join(id_cols)
    s.add(f"{prefix}_toks", f"SELECT {ids}, {toks_expr} AS toks FROM {docs}")
    s.add(f"{prefix}_terms", f"SELECT {ids}, {ngrams('toks')} AS terms FROM {prefix}_toks")
    s.add(f"{prefix}_tf", f"SELECT {ids}, term, count(*) AS tf FROM "
                          f"(SELECT {ids}, unnest(terms) AS term FROM {prefix}_terms) GROUP BY ALL")
    tfw = "(1.0 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    s.add(f"{prefix}_w0", f"SELECT {ids}, term, {tfw} * idf AS w0 FROM {prefix}_tf JOIN {vocab} USING (term)")
    s.add(f"{prefix}_w", f"SELECT {ids}, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {ids})) AS w "
                         f"FROM {prefix}_w0")


def pattern_tokens(x: str) -> str:
    return tokens_clean(x, stop=True)


def pattern_terms(x: str) -> str:
    return ngrams(pattern_tokens(x))


def classifier_tokens(x: str) -> str:
    return tokens_unicode(x)


# ---------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------

def categories_values() -> str:
    rows = []
    for i, (category, words) in enumerate(CATEGORY_KEYWORDS.items()):
        # Each keyword as a literal between word boundaries.
        literal = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in w.lower()) for w in words]
        rows.append(f"({i}, {q(category)}, {q('\\b(' + '|'.join(literal) + ')\\b')})")
    return f"(VALUES {', '.join(rows)}) AS cats(pos, category, pattern)"


def rule_ctes(s: Sql, t: str) -> str:
    s.add("kw_hits", f"SELECT {t}.number, cats.category, cats.pos, "
                     f"CAST(len(regexp_extract_all({clean(t + '.full_text')}, cats.pattern)) AS BIGINT) AS hits "
                     f"FROM {t} CROSS JOIN {categories_values()}")
    s.add("rule_best", "SELECT number, category AS rule_category FROM (SELECT *, row_number() OVER "
                       "(PARTITION BY number ORDER BY hits DESC, pos ASC) AS rn FROM kw_hits WHERE hits > 0) "
                       "WHERE rn = 1")
    return "rule_best"


def classify_ctes(s: Sql, t: str) -> str:
    """Registers the classifier chain over tickets ``t``; returns 'classified'."""
    tax = sql_in(CATEGORY_KEYWORDS)
    rule_ctes(s, t)
    s.add("needs", f"SELECT number, {strip('category')} NOT IN {tax} AS needs FROM {t}")
    s.add("lab0", f"SELECT number, ingest_ord, {strip('category')} AS category, full_text FROM {t} "
                  f"WHERE {strip('category')} IN {tax}")
    s.add("lab", f"SELECT lab0.* FROM lab0, (SELECT count(*) AS n FROM lab0) g WHERE g.n >= {CLASSIFIER_MIN_LABELED}")
    tfidf_ctes(s, "cl", "lab", ["number"], classifier_tokens("full_text"), TFIDF_MAX_FEATURES, 2)
    s.add("labels", "SELECT category, min(ingest_ord) AS label_ord, count(*) AS n_cat FROM lab GROUP BY category")
    s.add("centroids", "SELECT l.category, w.term, sum(w.w) / any_value(lb.n_cat) AS c "
                       "FROM cl_w w JOIN lab l USING (number) JOIN labels lb USING (category) "
                       "GROUP BY l.category, w.term")
    s.add("cnorm", "SELECT category, sqrt(sum(c * c)) AS cn FROM centroids GROUP BY category")
    s.add("pending", f"SELECT {t}.number, {t}.full_text FROM {t} JOIN needs USING (number) "
                     f"LEFT JOIN rule_best USING (number) WHERE needs.needs AND rule_best.rule_category IS NULL")
    transform_ctes(s, "pd", "cl_vocab", "pending", ["number"], classifier_tokens("full_text"))
    s.add("sims", "SELECT w.number, ce.category, sum(w.w * ce.c) / any_value(cn.cn) AS sim "
                  "FROM pd_w w JOIN centroids ce USING (term) JOIN cnorm cn USING (category) "
                  "GROUP BY w.number, ce.category")
    s.add("best_ml", "SELECT number, category, sim FROM (SELECT sims.*, row_number() OVER (PARTITION BY number "
                     "ORDER BY sim DESC, label_ord ASC) AS rn FROM sims JOIN labels USING (category)) WHERE rn = 1")
    s.add("ml_pred", f"SELECT p.number, CASE WHEN coalesce(b.sim, 0.0) >= {CLASSIFIER_MIN_SIMILARITY} "
                     f"THEN b.category ELSE 'Other' END AS ml_category, coalesce(b.sim, 0.0) AS ml_similarity "
                     f"FROM pending p LEFT JOIN best_ml b USING (number)")
    s.add("ml_ready", "SELECT count(*) > 0 AS ready FROM labels")
    s.add("classified", f"""SELECT {t}.* REPLACE (
    CASE WHEN NOT n.needs THEN {strip(t + '.category')}
         WHEN r.rule_category IS NOT NULL THEN r.rule_category
         WHEN mr.ready THEN m.ml_category ELSE 'Other' END AS category),
  CASE WHEN NOT n.needs THEN 'original' WHEN r.rule_category IS NOT NULL THEN 'rule'
       WHEN mr.ready THEN 'ml' ELSE 'uncategorized' END AS category_source
FROM {t} JOIN needs n USING (number) LEFT JOIN rule_best r USING (number)
LEFT JOIN ml_pred m USING (number) CROSS JOIN ml_ready mr""")
    return "classified"


OPEN_IN = sql_in(OPEN_STATES)
SLA_CASE = case_map("priority", {k: str(v) for k, v in MTTR_SLA_HOURS.items()}, "NULL")


# ---------------------------------------------------------------------------
# Density clustering (brute-force pairs, recursive-CTE components)
# ---------------------------------------------------------------------------

def density_ctes(s: Sql, docs: str, id_cols: list[str], ord_expr: str, text_col: str = "full_text",
                 prefix: str = "dc", eps: float = 0.35, min_samples: int = 3,
                 min_cluster_size: int = 3) -> str:
    """Registers {prefix}_labels (ids..., cluster_id) and helpers; returns the labels CTE."""
    ids = ", ".join(id_cols)
    s.add(f"{prefix}_docs", f"SELECT {ids}, {ord_expr} AS ord, {text_col} AS txt FROM {docs}")
    tfidf_ctes(s, f"{prefix}t", f"{prefix}_docs", id_cols, pattern_tokens("txt"), TFIDF_MAX_FEATURES, 2)
    s.add(f"{prefix}_key", f"SELECT {ids}, string_agg(term || ':' || CAST(tf AS VARCHAR), ',' ORDER BY term) AS vkey "
                           f"FROM {prefix}t_tf JOIN {prefix}t_vocab USING (term) GROUP BY ALL")
    s.add(f"{prefix}_mem", f"SELECT k.*, d.ord FROM {prefix}_key k JOIN {prefix}_docs d USING ({ids})")
    s.add(f"{prefix}_vec", f"SELECT vkey, min(ord) AS vid, count(*) AS mult FROM {prefix}_mem GROUP BY vkey")
    s.add(f"{prefix}_vw", f"SELECT v.vid, w.term, w.w FROM {prefix}_vec v JOIN {prefix}_mem m "
                          f"ON m.vkey = v.vkey AND m.ord = v.vid JOIN {prefix}t_w w USING ({ids})")
    thr = round(1.0 - eps, 9)
    s.add(f"{prefix}_pairs", f"SELECT a, b, sim FROM (SELECT x.vid AS a, y.vid AS b, round(sum(x.w * y.w), 9) AS sim "
                             f"FROM {prefix}_vw x JOIN {prefix}_vw y ON x.term = y.term AND x.vid < y.vid "
                             f"GROUP BY x.vid, y.vid) WHERE sim >= {thr}")
    s.add(f"{prefix}_both", f"SELECT a AS v, b AS u FROM {prefix}_pairs UNION ALL SELECT b AS v, a AS u FROM {prefix}_pairs")
    s.add(f"{prefix}_core", f"SELECT v.vid, v.mult, v.mult + coalesce(sum(u.mult), 0) AS mass, "
                            f"v.mult + coalesce(sum(u.mult), 0) >= {min_samples} AS is_core "
                            f"FROM {prefix}_vec v LEFT JOIN {prefix}_both b ON b.v = v.vid "
                            f"LEFT JOIN {prefix}_vec u ON u.vid = b.u GROUP BY v.vid, v.mult")
    s.add(f"{prefix}_cce", f"SELECT b.v AS src, b.u AS dst FROM {prefix}_both b "
                           f"JOIN {prefix}_core c1 ON c1.vid = b.v AND c1.is_core "
                           f"JOIN {prefix}_core c2 ON c2.vid = b.u AND c2.is_core")
    s.recursive = True
    s.add(f"{prefix}_reach", f"SELECT vid AS node, vid AS comp FROM {prefix}_core WHERE is_core "
                             f"UNION SELECT e.dst AS node, r.comp FROM {prefix}_reach r "
                             f"JOIN {prefix}_cce e ON r.node = e.src")
    s.add(f"{prefix}_comp", f"SELECT node, min(comp) AS comp FROM {prefix}_reach GROUP BY node")
    s.add(f"{prefix}_border", f"SELECT b.v AS vid, min(c.comp) AS comp FROM {prefix}_both b "
                              f"JOIN {prefix}_core nc ON nc.vid = b.v AND NOT nc.is_core "
                              f"JOIN {prefix}_comp c ON c.node = b.u GROUP BY b.v")
    s.add(f"{prefix}_member", f"SELECT node AS vid, comp FROM {prefix}_comp UNION ALL SELECT vid, comp FROM {prefix}_border")
    s.add(f"{prefix}_num", f"SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster_id "
                           f"FROM (SELECT DISTINCT comp FROM {prefix}_comp)")
    s.add(f"{prefix}_size", f"SELECT m.comp, sum(v.mult) AS size FROM {prefix}_member m JOIN {prefix}_vec v USING (vid) "
                            f"GROUP BY m.comp HAVING sum(v.mult) >= {min_cluster_size}")
    s.add(f"{prefix}_vc", f"SELECT m.vid, n.cluster_id FROM {prefix}_member m JOIN {prefix}_size USING (comp) "
                          f"JOIN {prefix}_num n USING (comp)")
    s.add(f"{prefix}_labels", f"SELECT {', '.join('d.' + c for c in id_cols)}, coalesce(vc.cluster_id, -1) AS cluster_id "
                              f"FROM {prefix}_docs d LEFT JOIN {prefix}_mem m USING ({ids}) "
                              f"LEFT JOIN {prefix}_vec v ON v.vkey = m.vkey LEFT JOIN {prefix}_vc vc ON vc.vid = v.vid")
    return f"{prefix}_labels"


# ---------------------------------------------------------------------------
# Cluster summaries over tickets with cluster ids (CTE ``ct``)
# ---------------------------------------------------------------------------

def clustered_tickets(s: Sql) -> str:
    t = tickets(s)
    c = classify_ctes(s, t)
    lab = density_ctes(s, t, ["number"], "ingest_ord", "full_text", prefix="dc")
    s.add("ct", f"SELECT c.*, l.cluster_id FROM {c} c JOIN {lab} l USING (number)")
    return "ct"


def cluster_keyword_ctes(s: Sql, ct: str, key: str = "cluster_id", text: str = "full_text",
                         id_col: str = "number", n: int = 6, prefix: str = "ck") -> str:
    s.add(f"{prefix}_d", f"SELECT {key}, {id_col}, {pattern_terms(text)} AS terms FROM {ct} WHERE {key} >= 0")
    s.add(f"{prefix}_n", f"SELECT {key}, count(*) AS n_c FROM {ct} WHERE {key} >= 0 GROUP BY {key}")
    s.add(f"{prefix}_tf", f"SELECT {key}, {id_col}, term, count(*) AS tf FROM "
                          f"(SELECT {key}, {id_col}, unnest(terms) AS term FROM {prefix}_d) GROUP BY ALL")
    s.add(f"{prefix}_stats", f"SELECT {key}, term, sum(tf) AS total, count(*) AS df FROM {prefix}_tf GROUP BY ALL")
    s.add(f"{prefix}_vocab", f"SELECT x.{key}, x.term, ln((1.0 + n.n_c) / (1.0 + x.df)) + 1.0 AS idf, n.n_c FROM "
                             f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY total DESC, term ASC) AS r "
                             f"FROM {prefix}_stats) x JOIN {prefix}_n n USING ({key}) WHERE x.r <= 200")
    s.add(f"{prefix}_w0", f"SELECT {key}, {id_col}, term, n_c, tf * idf AS w0 FROM {prefix}_tf "
                          f"JOIN {prefix}_vocab USING ({key}, term)")
    s.add(f"{prefix}_w", f"SELECT {key}, term, n_c, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {key}, {id_col})) AS w "
                         f"FROM {prefix}_w0")
    s.add(f"{prefix}_score", f"SELECT {key}, term, round(sum(w) / any_value(n_c), 9) AS score FROM {prefix}_w "
                             f"GROUP BY {key}, term")
    s.add(f"{prefix}_top", f"SELECT * FROM (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, "
                           f"term DESC) AS rank, term AS keyword, score FROM {prefix}_score WHERE score > 0) "
                           f"WHERE rank <= {n}")
    return f"{prefix}_top"


def label_sql(top: str, key: str, suffix: str, empty: str, prefix: str) -> str:
    """(key, label) from ranked keywords; keys with no keyword are absent."""
    k1 = title("max(keyword) FILTER (WHERE rank = 1)")
    k2 = title("max(keyword) FILTER (WHERE rank = 2)")
    return (f"SELECT {key}, CASE WHEN count(*) = 1 THEN {k1} || {q(suffix)} "
            f"ELSE {k1} || ' / ' || {k2} || {q(suffix)} END AS label FROM {top} GROUP BY {key}")


def top_values_sql(ct: str, col: str, n: int, key: str = "cluster_id") -> str:
    return (f"SELECT {key}, string_agg(v, '|' ORDER BY rank) AS vals FROM (SELECT {key}, {col} AS v, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(ingest_ord) ASC) AS rank "
            f"FROM {ct} WHERE {key} >= 0 AND {col} IS NOT NULL AND {col} <> '' GROUP BY {key}, {col}) "
            f"WHERE rank <= {n} GROUP BY {key}")
