"""DuckDB forms of the fixture views, used by ``oracle_sql()``.

Each view is a CTE over the driver's pre-registered tables, mirroring
``scoreplane.sources.fixtures`` expression by expression.
"""

from __future__ import annotations

from scoreplane import fixed_values as FV
from scoreplane import rules as R
from scoreplane.sources import fixtures as FX


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, idx_sql: str) -> str:
    return f"({lst(values)})[({idx_sql}) + 1]"


VIEWS = {
    "candidates": f"""
  SELECT event_id AS id,
         'resume_' || CAST(event_id AS VARCHAR) || '.pdf' AS resume_name,
         'user_' || CAST(user_id AS VARCHAR) AS candidate_name,
         CAST(CAST(floor(value * 100) AS BIGINT) % 101 AS INTEGER) AS ats_score,
         CAST((event_id * 37) % 101 AS INTEGER) AS edu_score,
         CAST((event_id * 53 + user_id) % 101 AS INTEGER) AS exp_score,
         CAST((event_id * 71 + 13) % 101 AS INTEGER) AS skills_score,
         CAST((event_id * 29 + user_id * 3) % 101 AS INTEGER) AS lang_score,
         CAST((event_id * 17 + 5) % 101 AS INTEGER) AS keyword_score,
         CAST((event_id * 11) % 101 AS INTEGER) AS format_score,
         CAST(CAST((CAST(floor(value * 100) AS BIGINT) * 7) % 101 AS DOUBLE) / 100 AS FLOAT) AS bias_score,
         {pick(FV.DOMAIN_LABELS, 'user_id % 33')} AS domain,
         ts + to_days(CAST((user_id % 14) * 30 AS INTEGER)) AS timestamp
  FROM events""",
    "user_logs": """
  SELECT event_id AS id, 'user_' || CAST(user_id AS VARCHAR) AS username,
         CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'view' THEN 'login'
              ELSE event_type END AS action,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
  FROM events""",
    "call_log": f"""
  SELECT event_id AS call_id, 'key_' || CAST(user_id % 8 AS VARCHAR) AS api_key,
         (user_id % 8) = 0 AS own_key, ts,
         'm' || CAST(event_id % 2 AS VARCHAR) AS model,
         CAST(event_id % 500 AS VARCHAR) AS prompt,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS response,
         CASE WHEN event_type = 'error' THEN {pick(FX.MODEL_ERRORS, 'event_id % 4')} END AS error
  FROM events""",
    "accounts": """
  SELECT c_custkey AS id, c_name AS username,
         CASE WHEN c_custkey % 10 = 0 THEN NULL
              WHEN c_custkey % 13 = 0 THEN 'user' || CAST(c_custkey AS VARCHAR) || '@invalid'
              ELSE 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email
  FROM customer""",
    "registrations": """
  SELECT event_id AS req_id,
         'Customer#' || lpad(CAST(user_id * 13 AS VARCHAR), 9, '0') AS username,
         CASE WHEN user_id % 9 = 0 THEN NULL
              ELSE 'user' || CAST(user_id * 17 AS VARCHAR) || '@example.com' END AS email,
         ts
  FROM events WHERE event_type = 'signup'""",
    "postings": f"""
  SELECT doc_id AS id,
         {pick(R.SAMPLE_TITLES, f'doc_id % {len(R.SAMPLE_TITLES)}')} AS job_title,
         {pick(R.SAMPLE_PHRASES, f'(doc_id * 7) % {len(R.SAMPLE_PHRASES)}')} AS job_description,
         text AS resume_text
  FROM documents""",
    "model_labels": f"""
  SELECT doc_id AS id,
         CASE WHEN toxic = 1 THEN {q(FX.INVALID_LABEL)}
              WHEN quality = 1 THEN {pick(FX.TITLE_LABELS, f'doc_id % {len(R.SAMPLE_TITLES)}')}
              ELSE {pick(FV.DOMAIN_LABELS, 'doc_id % 33')} END AS label
  FROM labels""",
    "code_events": """
  SELECT event_id, user_id,
         CASE WHEN event_type = 'signup' THEN 'issue' ELSE 'attempt' END AS kind,
         CASE WHEN event_type = 'signup' OR event_id % 4 <> 0
              THEN lpad(CAST((user_id * 7919 + dayofyear(ts) * 104729) % 1000000 AS VARCHAR), 6, '0')
              ELSE '999999' END AS code,
         ts
  FROM events WHERE event_type IN ('signup', 'click')""",
}

VIEWS["label_pairs"] = f"""
  SELECT event_id AS id, {pick(FV.DOMAIN_LABELS, 'user_id % 33')} AS resume_domain,
         {pick(FX.SIM_PROBES, f'event_id % {len(FX.SIM_PROBES)}')} AS job_domain
  FROM events"""

VIEWS["login_attempts"] = """
  SELECT event_id AS req_id,
         CASE WHEN event_id % 3 = 0 THEN 'user' || CAST(user_id * 10 AS VARCHAR) || '@example.com'
              WHEN event_id % 3 = 1 THEN 'Customer#' || lpad(CAST(user_id * 10 AS VARCHAR), 9, '0')
              ELSE 'nobody' || CAST(user_id AS VARCHAR) END AS identifier
  FROM events WHERE event_type = 'view'"""

VIEWS["submissions"] = f"""
  SELECT doc_id AS sub_id, 'cv_' || CAST(doc_id AS VARCHAR) || '.pdf' AS resume_name,
         'person_' || CAST(doc_id % 997 AS VARCHAR) AS candidate_name,
         CAST((doc_id * 13) % 103 - 1 AS DOUBLE) AS ats_score,
         CASE WHEN doc_id % 11 = 0 THEN (doc_id * 7) % 100 + 0.5 ELSE CAST((doc_id * 7) % 100 AS DOUBLE) END
           AS edu_score,
         CAST((doc_id * 3) % 101 AS DOUBLE) AS exp_score,
         CASE WHEN doc_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST((doc_id * 5) % 101 AS DOUBLE) END
           AS skills_score,
         CAST((doc_id * 9) % 101 AS DOUBLE) AS lang_score,
         CAST((doc_id * 19) % 101 AS DOUBLE) AS keyword_score,
         CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 1001) / 10.0 END AS format_score,
         ((doc_id * 7) % 102) / 100.0 AS bias_score,
         {pick(R.SAMPLE_TITLES, f'doc_id % {len(R.SAMPLE_TITLES)}')} AS job_title,
         {pick(R.SAMPLE_PHRASES, f'(doc_id * 7) % {len(R.SAMPLE_PHRASES)}')} AS job_description,
         text AS resume_text
  FROM documents"""


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """Prefix a query with the CTEs it names (in dependency order) plus extra CTEs."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    if extra:
        ctes = f"{ctes},{extra}" if ctes else extra
    return f"WITH {ctes}\n{sql}"


# ---------------------------------------------------------------- classifier
from scoreplane.functions.text import WS, phrase_pattern_portable  # noqa: E402


def strip_lower_sql(x: str) -> str:
    return f"lower(regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g'))"


def fold_replace_sql(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def classify_ctes(rs, src: str, id_col: str, title_sql: str, desc_sql: str) -> str:
    """CTEs ending in ``kwres(id, kw_domain)``: the J1 rule written relationally."""
    from scoreplane.plans.classify import dictionary_for

    d = dictionary_for(rs)
    doms = rs.domains
    rank = {dm: i + 1 for i, dm in enumerate(doms)}
    terms = ", ".join(f"({i}, {q(t)}, {q(phrase_pattern_portable(t))})" for i, t in enumerate(d.terms))
    kw = ", ".join(f"({rank[dm]}, {d.tid(k)})" for dm, k in rs.keywords)
    dm_rows = ", ".join(f"({rank[dm]}, {q(dm)}, {float(rs.weights.get(dm, 0))})" for dm in doms)
    bst_rows = [f"({rank[dm]}, {d.tid(t)})" for dm, ts in rs.boosts.items() for t in ts]
    bst = ", ".join(bst_rows) if bst_rows else "(0, -1)"
    fs = ", ".join(str(i) for i in d.tids(FV.FULLSTACK_TERMS))
    strong = ", ".join(str(i) for i in d.tids(FV.STRONG_PHRASES))
    fe, be = (rank.get(x, -1) for x in FV.COMBO_DOMAINS)
    t_norm = fold_replace_sql(strip_lower_sql(title_sql), rs.replacements)
    d_norm = fold_replace_sql(strip_lower_sql(desc_sql), rs.replacements)
    nws = WS.replace("[", "[^", 1)

    def combo(r):
        return (f"(SELECT count(*) FROM kw WHERE kw.rank = {r} AND kw.tid IN "
                f"(SELECT tid FROM th WHERE th.id = n.id UNION SELECT tid FROM dh WHERE dh.id = n.id))")

    def has(tbl, ids):
        return f"EXISTS (SELECT 1 FROM {tbl} WHERE {tbl}.id = n.id AND {tbl}.tid IN ({ids}))"

    overrides = " ".join(
        f"WHEN EXISTS (SELECT 1 FROM th WHERE th.id = b.id AND th.tid = {d.tid(p)}) THEN {q(lbl)}"
        for p, lbl in FV.TITLE_OVERRIDES)
    return f"""
norm AS (SELECT {id_col} AS id, {t_norm} AS t, {d_norm} AS d FROM {src}),
terms(tid, term, pat) AS (VALUES {terms}),
th AS (SELECT n.id, tm.tid FROM norm n, terms tm WHERE contains(n.t, tm.term) AND regexp_matches(n.t, tm.pat)),
dh AS (SELECT n.id, tm.tid FROM norm n, terms tm WHERE contains(n.d, tm.term) AND regexp_matches(n.d, tm.pat)),
kw(rank, tid) AS (VALUES {kw}),
doms(rank, domain, weight) AS (VALUES {dm_rows}),
bst(rank, tid) AS (VALUES {bst}),
tc AS (SELECT th.id, kw.rank, count(*) AS n FROM th JOIN kw ON th.tid = kw.tid GROUP BY 1, 2),
dc AS (SELECT dh.id, kw.rank, count(*) AS n FROM dh JOIN kw ON dh.tid = kw.tid GROUP BY 1, 2),
bt AS (SELECT DISTINCT th.id, bst.rank FROM th JOIN bst ON th.tid = bst.tid),
bd AS (SELECT DISTINCT dh.id, bst.rank FROM dh JOIN bst ON dh.tid = bst.tid),
flags AS (
  SELECT n.id,
         ({has('th', fs)} OR {has('dh', fs)}) AS fs,
         ({combo(fe)} >= {FV.COMBO_MIN_HITS} AND {combo(be)} >= {FV.COMBO_MIN_HITS}) AS combo,
         (NOT ({has('th', strong)} OR {has('dh', strong)})
          AND NOT regexp_matches(n.d, '^{WS}*(?:{nws}+{WS}+){{{FV.SHORT_DESC_WORDS - 1}}}{nws}')) AS pen
  FROM norm n),
sc AS (
  SELECT n.id, dm.rank, dm.domain, dm.weight, f.pen, COALESCE(dc.n, 0) AS dn,
         CAST((({FV.TITLE_FACTOR} * COALESCE(tc.n, 0) + {FV.DESC_FACTOR} * COALESCE(dc.n, 0)) * dm.weight)
              + CASE WHEN dm.domain = {q(FV.FULLSTACK_DOMAIN)}
                     THEN (CASE WHEN f.fs THEN {FV.FULLSTACK_BONUS} ELSE 0 END)
                        + (CASE WHEN f.combo THEN {FV.COMBO_BONUS} ELSE 0 END) ELSE 0 END
              + CASE WHEN bt.id IS NOT NULL THEN {FV.BOOST_TITLE} ELSE 0 END
              + CASE WHEN bd.id IS NOT NULL THEN {FV.BOOST_DESC} ELSE 0 END AS DOUBLE) AS raw
  FROM norm n CROSS JOIN doms dm JOIN flags f ON f.id = n.id
  LEFT JOIN tc ON tc.id = n.id AND tc.rank = dm.rank
  LEFT JOIN dc ON dc.id = n.id AND dc.rank = dm.rank
  LEFT JOIN bt ON bt.id = n.id AND bt.rank = dm.rank
  LEFT JOIN bd ON bd.id = n.id AND bd.rank = dm.rank),
fin AS (
  SELECT id, rank, domain,
         CASE WHEN pen THEN greatest(0.0, raw - dn * weight * {FV.SHORT_DESC_PENALTY}) ELSE raw END AS score
  FROM sc),
best AS (
  SELECT id, domain, score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank ASC) AS rn FROM fin) WHERE rn = 1),
kwres AS (
  SELECT b.id, CASE WHEN b.score >= {FV.MIN_SCORE}
                    THEN (CASE {overrides} ELSE b.domain END)
                    ELSE {q(FV.UNCLASSIFIED)} END AS kw_domain
  FROM best b)"""


def compose_sql(desc: str, resume: str) -> str:
    """H5 in DuckDB."""
    return (f"CASE WHEN COALESCE({resume}, '') <> '' "
            f"THEN regexp_replace(COALESCE({desc}, '') || chr(10) || chr(10) || {resume}, '^{WS}+|{WS}+$', '', 'g') "
            f"ELSE {desc} END")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def similarity_ctes(src: str, a: str, b: str) -> str:
    """CTEs ending in ``sim(id, similarity)`` over ``src(id, a, b)``."""
    al = ", ".join(f"({q(k)}, {q(v)})" for k, v in FV.SIMILARITY_ALIASES.items())
    pr = ", ".join(f"({q(x)}, {q(y)}, CAST({s} AS DOUBLE))" for (x, y), s in FV.SIMILARITY_PAIRS.items())
    gr = ", ".join(f"({q(lbl)}, {q(g)})" for g, ls in FV.SIMILARITY_GROUPS.items() for lbl in ls)
    cross = " ".join(
        f"WHEN EXISTS (SELECT 1 FROM grp x, grp y WHERE x.label = n.ra AND y.label = n.rb AND "
        f"((x.g = {q(g1)} AND y.g = {q(g2)}) OR (x.g = {q(g2)} AND y.g = {q(g1)}))) THEN {s}"
        for g1, g2, s in FV.CROSS_GROUP_SCORES)
    return f"""
alias(k, v) AS (VALUES {al}),
pairs(a, b, s) AS (VALUES {pr}),
grp(label, g) AS (VALUES {gr}),
n0 AS (SELECT id, lower({strip_sql(a)}) AS na, lower({strip_sql(b)}) AS nb FROM {src}),
n AS (SELECT n0.id, COALESCE(x.v, n0.na) AS ra, COALESCE(y.v, n0.nb) AS rb
      FROM n0 LEFT JOIN alias x ON x.k = n0.na LEFT JOIN alias y ON y.k = n0.nb),
sim AS (
  SELECT n.id, CAST(CASE
      WHEN n.ra = n.rb THEN {FV.SAME_LABEL_SCORE}
      WHEN f.s IS NOT NULL THEN f.s
      WHEN r.s IS NOT NULL THEN r.s
      WHEN EXISTS (SELECT 1 FROM grp x, grp y WHERE x.label = n.ra AND y.label = n.rb AND x.g = y.g)
        THEN {FV.SAME_GROUP_SCORE}
      {cross}
      ELSE {FV.DEFAULT_SIMILARITY} END AS DOUBLE) AS similarity
  FROM n LEFT JOIN pairs f ON f.a = n.ra AND f.b = n.rb
         LEFT JOIN pairs r ON r.a = n.rb AND r.b = n.ra)"""


def labels_cte(src: str = "model_labels") -> str:
    lst_ = ", ".join(q(x) for x in FV.DOMAIN_LABELS)
    return f"""
lbl AS (SELECT id, min(CASE WHEN {strip_sql('label')} IN ({lst_}) THEN {strip_sql('label')} END) AS llm_domain
        FROM {src} GROUP BY id)"""


# ---------------------------------------------------------------- call log
def reason_sql(err: str) -> str:
    cond = " OR ".join(f"contains(lower({err}), {q(w)})" for w in FV.QUOTA_WORDS)
    return f"CASE WHEN {cond} THEN {q(FV.REASON_QUOTA)} ELSE {q(FV.REASON_ERROR)} END"


def hash_sql(model: str = "model", prompt: str = "prompt") -> str:
    return f"sha256({model} || '|' || {prompt})"


def cache_cte(name: str, src: str) -> str:
    return f"""
{name} AS (SELECT prompt_hash, response, ts AS timestamp FROM (
    SELECT *, {hash_sql()} AS prompt_hash,
           row_number() OVER (PARTITION BY {hash_sql()} ORDER BY ts DESC, call_id DESC) AS rn
    FROM {src} WHERE error IS NULL) WHERE rn = 1)"""


def usage_cte(name: str, src: str) -> str:
    return f"""
{name} AS (SELECT api_key, CAST(arg_max(n, day) AS BIGINT) AS usage_count, max(day) AS last_reset
    FROM (SELECT api_key, CAST(ts AS DATE) AS day, count(*) AS n FROM {src} WHERE error IS NULL GROUP BY 1, 2)
    GROUP BY api_key)"""


def failures_cte(name: str, src: str) -> str:
    return f"""
{name} AS (SELECT api_key, ts AS fail_time, reason FROM (
    SELECT api_key, ts, error IS NOT NULL AS failed,
           CASE WHEN error IS NOT NULL THEN {reason_sql('error')} END AS reason,
           row_number() OVER (PARTITION BY api_key ORDER BY ts DESC, call_id DESC) AS rn
    FROM {src} WHERE error IS NOT NULL OR NOT own_key) WHERE rn = 1 AND failed)"""


def permuted_sql(x: str, half: str, keys: list[int], multiplier: int, shift: int) -> str:
    """One pass of the keyed permutation over the number ``x`` of 2 * ``half`` bits."""
    mask = f"((1::BIGINT << {half}) - 1)"
    left, right = f"({x} >> {half})", f"({x} & {mask})"
    for k in keys:
        left, right = right, f"xor({left}, (((({right} + {k}) * {multiplier}) >> {shift}) & {mask}))"
    return f"(({left} << {half}) | {right})"
